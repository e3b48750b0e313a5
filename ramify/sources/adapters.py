"""The engine's tables derived from the driver's star-schema tables by column formulas."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.functions.boards import first_of, gathered, line_boards, pixels_of
from ramify.functions.patterns import two_level_rank
from ramify.functions.scalars import idiv

LENGTH_PX, WIDTH_PX = 2000, 320


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measures():
    """The columns of a branch, from those of its row."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    way = F.col("l_partkey") % 4
    return [
        F.col("l_suppkey").alias("image_id"),
        (1 + (F.col("l_linenumber") - 1) % 4).cast("int").alias("dendrite_type"),
        (F.col("l_quantity").cast("int") + 9).alias("length"),
        ((cents % 18000) / 100.0).alias("orientation"),
        (F.col("l_discount") * 100).alias("curvature"),
        F.col("l_tax").alias("tortuosity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("intensity"),
        ((F.col("l_orderkey") * 7) % 1900).cast("int").alias("y0"),
        (60 + F.col("l_partkey") % 180).cast("int").alias("x0"),
        F.when(way == 1, 0).otherwise(1).alias("dy"),
        F.when(way == 0, 0).when(way == 3, -1).otherwise(1).alias("dx"),
        "l_partkey",
    ]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_measures())


def branch_keys(spark, sf_dir):
    """One row per branch: measures plus start point and direction of its line. Rows are numbered before they are measured."""
    kind = (1 + (F.col("l_linenumber") - 1) % 4).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return two_level_rank(
        rows, ["l_suppkey"],
        F.struct(kind.alias("dendrite_type"), idiv(F.col("l_orderkey"), 100000).alias("o")),
        [kind, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"],
        "id",
    ).select(*_measures(), "id")


def polyline():
    """The branch's points as an array, from its start, direction and length."""
    return F.transform(
        F.sequence(F.lit(0), F.col("length") - 1),
        lambda i: F.struct((F.col("y0") + i * F.col("dy")).cast("int").alias("y"),
                           (F.col("x0") + i * F.col("dx")).cast("int").alias("x")),
    )


def branch(spark, sf_dir):
    return branch_of(branch_keys(spark, sf_dir))


def branch_of(keys, *more):
    """Branches from their keys; columns joined to the keys (`more`) are joined before there are points to carry."""
    half = (F.col("length") - 1) / 2.0
    return keys.select(
        *more, "image_id", "id", "dendrite_type", "length", "orientation",
        (F.col("x0") + F.col("dx") * half).alias("mean_x"),
        (F.col("y0") + F.col("dy") * half).alias("mean_y"),
        "curvature", "tortuosity", "intensity", polyline().alias("branch"), "l_partkey",
    )


def branch_pt(spark, sf_dir):
    """(image_id, id, dendrite_type, i, y, x): the points of all branches."""
    return (
        branch_keys(spark, sf_dir)
        .select("image_id", "id", "dendrite_type", "y0", "x0", "dy", "dx",
                F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i"))
        .select("image_id", "id", "dendrite_type", "i",
                (F.col("y0") + F.col("i") * F.col("dy")).cast("int").alias("y"),
                (F.col("x0") + F.col("i") * F.col("dx")).cast("int").alias("x"))
    )


def image(spark, sf_dir):
    s = F.col("image_id")
    return (
        table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id")).distinct()
        .select(
            s, F.concat(F.lit("img"), s.cast("string")).alias("image"),
            F.concat(F.when(s % 2 == 0, "wt").otherwise("mut"), F.lit("-day"),
                     (3 * (1 + s % 3)).cast("string")).alias("genotype"),
            F.lit(LENGTH_PX).alias("length_px"), F.lit(WIDTH_PX).alias("width_px"),
            (800 + s % 400).cast("int").alias("cellbody_px"),
        )
    )


def fragment(spark, sf_dir):
    """Branches read as unmerged fragments, with the position of their middle point."""
    mid = F.floor(F.col("length") / 2)
    return branch_keys(spark, sf_dir).select(
        "image_id", "id", "dendrite_type", "length",
        ((F.col("y0") + mid * F.col("dy")) / float(LENGTH_PX)).alias("relative_y"),
        ((F.col("x0") + mid * F.col("dx")) / float(WIDTH_PX)).alias("relative_x"),
        polyline().alias("segment"), "l_partkey",
    )


def fragment_features(spark, sf_dir):
    """Fragments with the nine classifier inputs, straight from columns of the source rows."""
    return fragment_features_of(branch_keys(spark, sf_dir))


def fragment_features_of(keys, *more):
    """Fragments with the nine classifier inputs from their keys, and columns `more` of the keys."""
    k = F.col("l_partkey")
    mid_x = F.col("x0") + F.floor(F.col("length") / 2) * F.col("dx")
    rel_x = mid_x / float(WIDTH_PX)
    return keys.select(
        "image_id", "id", "dendrite_type",
        (F.col("orientation") - 90.0).alias("orientation"),
        (k % 4 == 1).alias("horizontal_likely"),
        (F.col("y0") / float(LENGTH_PX)).alias("relative_y"),
        rel_x.alias("relative_x"),
        (F.lit(0.2) * F.sin(F.lit(3.0) * F.pi() * rel_x) + 0.5).alias("quat_filter"),
        "curvature", (1.0 + F.col("tortuosity") + F.col("dendrite_type") * 0.05).alias("tortuosity"),
        (F.col("length") / 100.0).alias("local_density"),
        (F.col("intensity") + 200.0 * F.col("dendrite_type")).alias("average_intensity"),
        "length", *more,
    )


def prediction(spark, sf_dir):
    true = F.col("dendrite_type")
    wrong = F.col("l_partkey") % 5 == 0
    return branch_keys(spark, sf_dir).select(
        "image_id", "id", "length", true.alias("true_type"),
        F.when(wrong, 1 + true % 4).otherwise(true).alias("predicted_type"),
    )


def _embedding_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("x", "e"))


def pixel(spark, sf_dir):
    return _embedding_rows(spark, sf_dir).select(
        idiv(F.col("vec_id"), 250).alias("image_id"),
        (F.col("vec_id") % 250).cast("int").alias("y"), "x",
        F.floor((F.col("e").cast("double") + 1) * 1000).cast("int").alias("v"),
    )


PIXEL_H, PIXEL_W = 250, 64


def pixel_image(spark, sf_dir):
    return pixel(spark, sf_dir).groupBy("image_id").agg(
        (F.max("y") + 1).alias("length_px"), (F.max("x") + 1).alias("width_px"))


def voxel(spark, sf_dir):
    n = F.col("vec_id") % 100
    return _embedding_rows(spark, sf_dir).select(
        idiv(F.col("vec_id"), 100).alias("image_id"),
        F.lit(0).alias("resolution"), F.lit(0).alias("time_point"),
        F.col("label").alias("channel"),
        (n % 4).cast("int").alias("z"), idiv(n, 4).cast("int").alias("y"), "x",
        F.floor((F.col("e").cast("double") + 1) * 1000).cast("int").alias("v"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("e").cast("double"))).alias("p"),
    )


def mask(spark, sf_dir, level=1050):
    return pixel(spark, sf_dir).filter(F.col("v") >= level).select("image_id", "y", "x")


def _drawn(spark, sf_dir):
    """Lines of branches with an image: (those with a start point, points of those without y or x of it)."""
    rows = _lines(spark, sf_dir).filter("image_id is not null").select(
        "image_id", "dendrite_type", "y0", "x0", polyline().alias("line"))
    placed = F.col("y0").isNotNull() & F.col("x0").isNotNull()
    odd = rows.filter(~placed).select("image_id", "dendrite_type", F.explode("line").alias("p"))
    return rows.filter(placed), odd.select("image_id", "dendrite_type", "p.y", "p.x")


def skeleton(spark, sf_dir):
    """Every pixel under a branch once; the lines meet as boards of cells."""
    lines, odd = _drawn(spark, sf_dir)
    cells = gathered(line_boards(lines, "line", ["image_id"]))
    return pixels_of(cells, "image_id").select("image_id", "y", "x").unionByName(odd.select("image_id", "y", "x").distinct())


def label_pixel(spark, sf_dir):
    """The class of the lowest branch on every pixel. Branches are numbered by class first, one without a class before all."""
    lines, odd = _drawn(spark, sf_dir)
    lowest = F.when(F.bool_or(F.col("dendrite_type").isNull()), F.lit(None)).otherwise(F.min("dendrite_type")).cast("int").alias("label")
    boards = line_boards(lines, "line", ["image_id", "dendrite_type"])
    # sets of boards in order of class: no class first, as structs are sorted
    cells = gathered(boards, F.array_sort(F.collect_set(F.struct(F.col("dendrite_type").alias("label"), "bits"))).alias("b"))
    cells = cells.select("image_id", "cell", F.explode(first_of(F.col("b"))).alias("b")).select("image_id", "cell", "b.label", "b.bits")
    lowest = pixels_of(cells, "image_id", "label").select("image_id", "y", "x", "label").unionByName(
        odd.groupBy("image_id", "y", "x").agg(lowest))
    return lowest.withColumn(
        "label", F.when((F.col("y") + F.col("x")) % 11 == 0, 0).otherwise(F.col("label")))


def intensity_pixel(spark, sf_dir):
    """An intensity for every pixel under a branch."""
    return skeleton(spark, sf_dir).withColumn(
        "v", ((F.col("y") * 31 + F.col("x") * 17 + F.col("image_id")) % 4096).cast("int"))


def centre(spark, sf_dir):
    return (
        two_level_rank(
            table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), "ts", "event_id", "value"),
            ["image_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "i")
        .select("image_id", "i", (F.col("i") * 2.0).alias("y"), F.col("value").alias("x"), "ts")
    )


def timepoint(spark, sf_dir):
    return centre(spark, sf_dir).select("image_id", (F.col("i") + 1).alias("n"), "ts")


def matrix(spark, sf_dir):
    """64 numeric features per vector, grouped by label."""
    cols = [F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(64)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image"), F.col("label").cast("string").alias("genotype"), *cols)
