"""Comparing groups of images: means with intervals, histograms and densities of position."""

import math

from pyspark.sql import functions as F

from ramify.functions.patterns import salted_join
from ramify.functions.scalars import UM_PER_PX  # noqa: F401  (re-exported for callers)
from ramify.operators.profile import FEATURE_COLUMNS

# Trait code, feature column as saved, title, axis label.
TRAITS = [
    ("ln", "length", "Worm Length", "Length ($\\mu$m)"),
    ("cb", "cellbody", "Cell Body Position Along the Anterior-Posterior Axis", "Position (%)"),
    ("ct1", "prim-ct", "Number of Primary Dendrites", "Count"),
    ("ct2", "sec-ct", "Number of 2º Dendrites", "Count"),
    ("ct3", "tert-ct", "Number of 3º Dendrites", "Count"),
    ("ct4", "quat-ct", "Number of 4º Dendrites", "Count"),
    ("ol", "overlap-count", "Number of Menorah Overlaps", "Count"),
    ("md4", "quat-median", "Medians of 4º Distribution", "Median (%)"),
    ("sk4", "quat-skew", "Skewness of 4º Distribution", "Skewness"),
    ("pt4", "post-quat", "Number of Posterior 4º Dendrites", "Count"),
    ("at4", "ant-quat", "Number of Anterior 4º Dendrites", "Count"),
    ("pt3", "post-tert", "Number of Posterior 3º Dendrites", "Count"),
    ("at3", "ant-tert", "Number of Anterior 3º Dendrites", "Count"),
    ("md2", "sec-median", "Medians of 2º Distribution", "Median (%)"),
    ("sk2", "sec-skew", "Skewness of 2º Distribution", "Skewness"),
    ("pt2", "post-sec", "Number of Posterior 2º Dendrites", "Count"),
    ("at2", "ant-sec", "Number of Anterior 2º Dendrites", "Count"),
    ("cv1", "prim-curve", "Curvature of 1º Dendrites", "Degrees (º)"),
    ("cv2", "sec-curve", "Curvature of 2º Dendrites", "Degrees (º)"),
    ("cv3", "tert-curve", "Curvature of 3º Dendrites", "Degrees (º)"),
    ("cv4", "quat-curve", "Curvature of 4º Dendrites", "Degrees (º)"),
    ("wv1", "prim-wavy", "Waviness of 1º Dendrites", "Sign Changes * º/$\\mu$m"),
    ("wv2", "sec-wavy", "Waviness of 2º Dendrites", "Sign Changes * º/$\\mu$m"),
    ("wv3", "tert-wavy", "Waviness of 3º Dendrites", "Sign Changes * º/$\\mu$m"),
    ("wv4", "quat-wavy", "Waviness of 4º Dendrites", "Sign Changes * º/$\\mu$m"),
    ("ag1", "prim-angle", "Mean Orientation of 1º Dendrites", "Degrees (º)"),
    ("ag2", "sec-angle", "Mean Orientation of 2º Dendrites", "Degrees (º)"),
    ("ag3", "tert-angle", "Mean Orientation of 3º Dendrites", "Degrees (º)"),
    ("ag4", "quat-angle", "Mean Orientation of 4º Dendrites", "Degrees (º)"),
    ("as1", "prim-angle-sd", "SD of Orientations of 1º Dendrites", "Degrees (º)"),
    ("as2", "sec-angle-sd", "SD of Orientations of 2º Dendrites", "Degrees (º)"),
    ("as3", "tert-angle-sd", "SD of Orientations of 3º Dendrites", "Degrees (º)"),
    ("as4", "quat-angle-sd", "SD of Orientations of 4º Dendrites", "Degrees (º)"),
    ("im", "iba-mean", "Mean Interbranch Angle", "Degrees (º)"),
    ("is", "iba-sd", "SD of Interbranch Angles", "Degrees (º)"),
    ("ik", "iba-skew", "Skewness of Interbranch Angle Distribution", "Skewness"),
    ("cr23", "23-ct-ratio", "Ratio of 2º to 3º Dendrites", "No. 2º / No. 3º"),
    ("cn34", "34-contacts", "Number of 3º/4º Contacts", "Count"),
    ("lr14", "14-len-ratio", "Ratio of 1º to 4º Dendrite Length", "1º Length / 4º Length"),
]


def trait_table(spark):
    """The trait catalogue as a 39-row dimension."""
    return spark.createDataFrame(TRAITS, "code string, feature string, title string, label string")


def trait_select(features, *, codes=None):
    """Long form (image, genotype, code, title, label, value) of the catalogued features.

    A code whose column the profile does not produce yields no rows.
    """
    engine = {saved: name for name, saved in FEATURE_COLUMNS}
    wanted = [(c, engine[f]) for c, f, _, _ in TRAITS if f in engine and (codes is None or c in codes)]
    long = features.unpivot(
        ["image", "genotype"],
        [F.col(name).alias(code) for code, name in wanted], "code", "value")
    traits = trait_table(features.sparkSession)
    return long.join(F.broadcast(traits.select("code", "title", "label")), "code")  # 39 fixed rows


def group_ci(long):
    """Mean and half-width of the normal 95 % interval per group and trait (population SD)."""
    return long.groupBy("genotype", "code").agg(
        F.avg("value").alias("mean"),
        (F.lit(1.96) * F.stddev_pop("value") / F.sqrt(F.count("value").cast("double"))).alias("err"),
        F.count("value").alias("n"))


def strain_order():
    """Sort expressions for `<strain>-day<N>`: by N, wild type first."""
    return [F.regexp_extract("genotype", r"day(\d+)", 1).cast("int"),
            F.when(F.split("genotype", "-")[0] == "wt", 0).otherwise(1)]


def image_groups(df):
    return df.select("genotype").distinct()


def ap_histogram(position, keys, *, step=5, top=100):
    """Density histogram of position per group; the last bin is closed.

    `n` is the number of all values of the group, the density counts those inside 0..top.
    """
    v = F.col("ap_pct")
    k = F.least(F.floor(v / step), F.lit(top // step - 1))
    inside = (v >= 0) & (v <= top)
    counts = (
        position.groupBy(*keys, F.when(inside, k).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    )
    totals = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("bin").isNotNull(), F.col("c"))).alias("inside"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top // step - 1).cast("long"))))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, (F.col("bin") * step).alias("lo"),
        F.try_divide(F.coalesce("c", F.lit(0)), F.col("inside") * step).alias("density"), "n")


def ap_kde(position, keys, *, top=100):
    """Gaussian kernel density at 0, 1, .. top with Scott's bandwidth, per group."""
    counts = position.groupBy(*keys, "ap_pct").agg(F.count(F.lit(1)).alias("c"))
    stats = position.groupBy(*keys).agg(F.count("ap_pct").alias("n"), F.stddev_samp("ap_pct").alias("sd"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    u = (F.col("grid") - F.col("ap_pct")) / h
    return (
        salted_join(counts, stats, keys, F.col("ap_pct")).withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(top))))
        .groupBy(*keys, "grid")
        .agg(F.sum(F.col("c") * F.exp(-u * u / 2) / (F.col("n") * h * math.sqrt(2 * math.pi))).alias("density"))
    )
