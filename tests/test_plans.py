"""Plans stay free of pair searches, and scans read only what is needed."""

import pytest
from pyspark.sql import functions as F

from ramify.operators import correct, fragments, neighbors, profile
from ramify.sources import adapters as ad

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_pair_search(text):
    return "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("make", [
    lambda s: neighbors.branch_neighbors(ad.branch(s, SF)),
    lambda s: fragments.connect_candidates(ad.fragment(s, SF)),
    lambda s: correct.correct_tertiary(ad.fragment(s, SF)),
    lambda s: correct.correct_primary(correct.spans(ad.fragment(s, SF))),
    lambda s: correct.y_overlap_exists(correct.spans(ad.fragment(s, SF))),
    lambda s: fragments.local_density(ad.fragment(s, SF), ad.skeleton(s, SF), ad.image(s, SF)),
], ids=["neighbors", "candidates", "tertiary", "primary", "overlap", "density"])
def test_no_pair_search(spark, make):
    assert no_pair_search(plan(make(spark)))


def test_class_profile_is_one_aggregation(spark, tmp_path):
    ad.branch(spark, SF).write.parquet(str(tmp_path / "b"))
    text = plan(profile.class_profile(spark.read.parquet(str(tmp_path / "b"))))
    assert text.count("Exchange ") == 1 and "partial_count" in text
    schema = text[text.index("ReadSchema"):]
    assert "branch" not in schema.split("\n")[0] and "mean_y" not in schema.split("\n")[0]


def test_class_filter_reaches_the_scan(spark, tmp_path):
    ad.branch(spark, SF).write.parquet(str(tmp_path / "b"))
    text = plan(profile.of_class(spark.read.parquet(str(tmp_path / "b")), 3).select("id"))
    assert "EqualTo(dendrite_type,3)" in text


def test_one_image_with_a_third_of_all_branches(spark):
    """Ids and medians of a hot image agree with a plain ranking."""
    from ramify.functions.patterns import exact_quantiles, two_level_rank

    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("long").alias("image_id"),
        (F.col("id") * 7919 % 30011).alias("o"))
    got = two_level_rank(rows, ["image_id"], F.floor(F.col("o") / 100), ["o"], "place")
    from pyspark.sql import Window
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("o")) - 1)
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == 30000
    med = exact_quantiles(rows, ["image_id"], "o", [0.5]).select("image_id", F.col("q0").alias("m"))
    assert med.exceptAll(rows.groupBy("image_id").agg(F.median("o").alias("m"))).isEmpty()
