"""Scoring by sets of leaves against the forest's own walk."""

import random

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ramify.operators import ml


def test_votes_are_those_of_the_walk(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(1, 5), *[rnd.choice([rnd.random(), 0.5]) for _ in range(9)]) for i in range(600)]
    df = spark.createDataFrame(rows, ["id", "label", *ml.CLASSIFIER_FEATURES])
    df = ml.feature_vector(df.withColumn("label", F.col("label") % 3 + F.col("tortuosity").cast("int") + 1))
    model = ml.forest_train(df, trees=15, depth=12)
    assert ml._leaf_sets(model, spark) is not None
    keep = lambda d: {r["id"]: tuple(r) for r in d.select("id", vector_to_array("rawPrediction"), vector_to_array("probability"), "prediction").collect()}
    got = ml.forest_predict(model, df)
    assert got.columns == [*model.transform(df).columns, "dendrite_type"]
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert keep(got) == keep(model.transform(df))
