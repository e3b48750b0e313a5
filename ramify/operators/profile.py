"""One row of features per image, and the pieces it is made of."""

from pyspark.sql import functions as F

from ramify.functions.patterns import cut, exact_quantiles, salted_join
from ramify.functions.scalars import UM_PER_PX, axial, mean_coord, um, wrapped_diff
from ramify.operators.neighbors import pair_lookup

CLASSES = {1: "prim", 2: "sec", 3: "tert", 4: "quat"}
AXIAL_CLASSES = (2, 4)
SPREAD_CLASSES = (2, 4)  # classes with a median and a skewness of position
SPLIT_CLASSES = (2, 3, 4)  # classes counted separately before and behind the cell body
CONTACT_PAIRS = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
N_BINS, BIN_DEG = 18, 10.0


def _columns():
    """(engine name, name in saved files) of all feature columns, in the order they are saved."""
    out = [("image", "image"), ("genotype", "genotype"), ("length", "length"), ("cellbody", "cellbody")]
    for c, name in CLASSES.items():
        parts = ["ct", "length", "wavy", "curve", "intensity", "angle", "angle-sd"]
        if c in SPREAD_CLASSES:
            parts += ["median", "skew"]
        saved = [f"{name}-{p}" for p in parts]
        if c in SPLIT_CLASSES:
            saved += [f"post-{name}", f"ant-{name}"]
        out += [(s.replace("-", "_"), s) for s in saved]
    out += [(f"contacts_{a}{b}", f"{a}{b}-contacts") for a, b in CONTACT_PAIRS]
    out += [(f"iba_{p}", f"iba-{p}") for p in ("mean", "sd", "skew")]
    out += [(f"angle_dist_bin{k}", f"angle-dist-bin{k}") for k in range(1, N_BINS + 1)]
    out += [(f"len_ratio_{a}{b}", f"{a}{b}-len-ratio") for a, b in CONTACT_PAIRS]
    out += [(f"ct_ratio_{a}{b}", f"{a}{b}-ct-ratio") for a, b in ((2, 3), (4, 2), (4, 3))]
    return out


FEATURE_COLUMNS = _columns()
NUMERIC_FEATURES = [n for n, _ in FEATURE_COLUMNS[2:]]


def of_class(df, c):
    return df.filter(F.col("dendrite_type") == c)


def wrapped_orientation():
    """Orientation, folded for the classes that are measured against the axis."""
    return F.when(F.col("dendrite_type").isin(*AXIAL_CLASSES), axial(F.col("orientation"))).otherwise(
        F.col("orientation"))


def image_lengths(image, um_per_px=UM_PER_PX):
    """Whole-micrometre lengths of the image, in front of and behind the cell body."""
    total, ant = um(F.col("length_px"), um_per_px), um(F.col("cellbody_px"), um_per_px)
    return image.select(
        "image_id", "image", "genotype", "length_px",
        total.alias("length"), ant.alias("ant_length"), (total - ant).alias("post_length"),
        (100.0 * F.col("cellbody_px") / F.col("length_px")).alias("cellbody"),
    )


def with_mean_y(branch):
    return branch if "mean_y" in branch.columns else branch.withColumn("mean_y", mean_coord(F.col("branch"), "y"))


def companion_join(branch, image):
    """Each branch row with the size and cell body of its image."""
    return salted_join(branch, image, ["image_id"], F.col("id"))


def class_profile(branch, *, um_per_px=UM_PER_PX):
    """Counts, lengths and means per image and class."""
    o = wrapped_orientation()
    return branch.groupBy("image_id", "dendrite_type").agg(
        F.count(F.lit(1)).alias("ct"), um(F.sum("length"), um_per_px).alias("length_um"),
        F.avg("tortuosity").alias("wavy"), F.avg("curvature").alias("curve"),
        F.avg("intensity").alias("intensity"), F.avg(o).alias("angle"), F.stddev_pop(o).alias("angle_sd"),
    )


def length_normalized(profile, image, *, um_per_px=UM_PER_PX):
    """Class lengths, and the primary count, per micrometre of image."""
    return (
        profile.join(image_lengths(image, um_per_px).select("image_id", F.col("length").alias("image_um")), "image_id")
        .select(
            "image_id", "dendrite_type",
            F.try_divide("length_um", "image_um").alias("length_per_um"),
            F.when(F.col("dendrite_type") == 1, F.try_divide("ct", "image_um"))
            .otherwise(F.col("ct").cast("double")).alias("ct"),
        )
    )


def ap_position(branch, image, *, adjust=True):
    """Mean y of a branch as % of image length, measured from the cell body if `adjust`."""
    pct = F.col("mean_y") * 100 / F.col("length_px")
    if adjust:
        pct = pct - 100.0 * F.col("cellbody_px") / F.col("length_px")
    return companion_join(
        with_mean_y(branch).select("image_id", "id", "dendrite_type", "mean_y"),
        image.select("image_id", "length_px", "cellbody_px"),
    ).select("image_id", "id", "dendrite_type", pct.alias("ap_pct"))


def ap_median_skew(position):
    """Median and population skewness of position, classes 2 and 4."""
    keys = ["image_id", "dendrite_type"]
    rows = cut(position.filter(F.col("dendrite_type").isin(*SPREAD_CLASSES)).select(*keys, "ap_pct"))
    median = exact_quantiles(rows, keys, "ap_pct", [0.5])
    skew = rows.groupBy(*keys).agg(F.skewness("ap_pct").alias("ap_skew"))
    return median.select(*keys, F.col("q0").alias("ap_median")).join(skew, keys)


def ap_counts(position, image, *, um_per_px=UM_PER_PX):
    """Branches behind and in front of the cell body per micrometre, classes 2 to 4."""
    counts = (
        position.filter(F.col("dendrite_type").isin(*SPLIT_CLASSES)).groupBy("image_id", "dendrite_type")
        .agg(F.count_if(F.col("ap_pct") > 0).alias("post"), F.count(F.lit(1)).alias("n"))
    )
    return counts.join(image_lengths(image, um_per_px), "image_id").select(
        "image_id", "dendrite_type",
        F.try_divide("post", "post_length").alias("post"),
        F.try_divide(F.col("n") - F.col("post"), F.col("ant_length")).alias("ant"),
    )


def _contact_counts():
    lo, hi = F.least("type_a", "type_b"), F.greatest("type_a", "type_b")
    return [F.count_if((lo == a) & (hi == b)).alias(f"_c{a}{b}") for a, b in CONTACT_PAIRS]


def _contact_shares():
    total = sum((F.col(f"_c{a}{b}") for a, b in CONTACT_PAIRS), F.lit(0))
    return [F.try_divide(100 * F.col(f"_c{a}{b}"), total).alias(f"contacts_{a}{b}") for a, b in CONTACT_PAIRS]


def _angle_stats():
    d = wrapped_diff(F.col("orientation_a"), F.col("orientation_b"))
    return [F.avg(d).alias("iba_mean"), F.stddev_pop(d).alias("iba_sd"), F.skewness(d).alias("iba_skew")]


def contact_matrix(looked_up):
    """Contacts between different classes as % of all such contacts, per image."""
    return looked_up.groupBy("image_id").agg(*_contact_counts()).select("image_id", *_contact_shares())


def interbranch_angle(looked_up):
    """Mean, SD and skewness of the angle between touching branches, per image."""
    return looked_up.groupBy("image_id").agg(*_angle_stats())


def length_ratios(*, compat=False):
    """Ratio columns from prim_um .. quat_um and prim_n .. quat_n."""
    length = lambda c: F.col(f"_{CLASSES[c]}_um")
    count = lambda c: F.col(f"_{CLASSES[c]}_n")
    out = []
    for a, b in CONTACT_PAIRS:
        top, low = (1, 2) if compat and (a, b) == (3, 4) else (a, b)
        out.append(F.try_divide(length(top), length(low)).alias(f"len_ratio_{a}{b}"))
    out += [F.try_divide(count(a), count(b)).alias(f"ct_ratio_{a}{b}") for a, b in ((2, 3), (4, 2), (4, 3))]
    return out


def _class_totals(um_per_px):
    out = []
    for c, name in CLASSES.items():
        mine = F.col("dendrite_type") == c
        out += [F.count_if(mine).alias(f"_{name}_n"),
                um(F.coalesce(F.sum(F.when(mine, F.col("length"))), F.lit(0)), um_per_px).alias(f"_{name}_um")]
    return out


def ratios(branch, *, um_per_px=UM_PER_PX, compat=False):
    """Length and count ratios between classes; NULL where the lower class is absent."""
    return branch.groupBy("image_id").agg(*_class_totals(um_per_px)).select(
        "image_id", *length_ratios(compat=compat))


def _bin_counts():
    o = F.col("orientation")
    k = F.least(F.floor(o / BIN_DEG), F.lit(N_BINS - 1))
    inside = (o >= 0) & (o <= N_BINS * BIN_DEG)
    return [F.count_if(inside & (k == b)).alias(f"_bin{b + 1}") for b in range(N_BINS)]


def _bin_shares(total):
    return [F.try_divide(f"_bin{b}", total).alias(f"angle_dist_bin{b}") for b in range(1, N_BINS + 1)]


def orientation_hist(branch):
    """Share of branches per 10-degree orientation bin, per image; the last bin is closed."""
    total = F.count_if(F.col("dendrite_type").between(1, 4)).alias("_total")
    return branch.groupBy("image_id").agg(total, *_bin_counts()).select("image_id", *_bin_shares(F.col("_total")))


def feature_table(branch, links, image, *, um_per_px=UM_PER_PX, adjust=True, compat=False):
    """All features of every image: 2 keys and 76 numbers.

    One aggregation over the branches carries every class block and the histogram; medians and
    contacts are aggregated apart and joined on image_id.
    """
    lengths = image_lengths(image, um_per_px)
    rows = salted_join(with_mean_y(branch), lengths.select("image_id", "length_px", "cellbody"), ["image_id"], F.col("id"))
    position = F.col("mean_y") * 100 / F.col("length_px")
    rows = rows.withColumn("ap_pct", position - F.col("cellbody") if adjust else position)
    o = wrapped_orientation()
    aggs = _class_totals(um_per_px) + _bin_counts()
    for c, name in CLASSES.items():
        mine = lambda value, c=c: F.when(F.col("dendrite_type") == c, value)
        aggs += [
            F.avg(mine(F.col("tortuosity"))).alias(f"{name}_wavy"),
            F.avg(mine(F.col("curvature"))).alias(f"{name}_curve"),
            F.avg(mine(F.col("intensity"))).alias(f"{name}_intensity"),
            F.avg(mine(o)).alias(f"{name}_angle"), F.stddev_pop(mine(o)).alias(f"{name}_angle_sd"),
        ]
        if c in SPREAD_CLASSES:
            aggs.append(F.skewness(mine(F.col("ap_pct"))).alias(f"{name}_skew"))
        if c in SPLIT_CLASSES:
            aggs.append(F.count_if((F.col("dendrite_type") == c) & (F.col("ap_pct") > 0)).alias(f"_{name}_post"))
    blocks = rows.groupBy("image_id").agg(*aggs)

    medians = exact_quantiles(
        rows.filter(F.col("dendrite_type").isin(*SPREAD_CLASSES)), ["image_id", "dendrite_type"],
        "ap_pct", [0.5],
    ).groupBy("image_id").agg(*[
        F.max(F.when(F.col("dendrite_type") == c, F.col("q0"))).alias(f"{CLASSES[c]}_median")
        for c in SPREAD_CLASSES])

    looked_up = pair_lookup(links.filter(F.col("a") < F.col("b")), branch)
    contacts = looked_up.groupBy("image_id").agg(*_contact_counts(), *_angle_stats()).select(
        "image_id", *_contact_shares(), "iba_mean", "iba_sd", "iba_skew")

    total = sum((F.col(f"_{n}_n") for n in CLASSES.values()), F.lit(0))
    derived = [F.try_divide("_prim_n", "length").alias("prim_ct")]
    derived += [F.col(f"_{n}_n").cast("double").alias(f"{n}_ct") for n in ("sec", "tert", "quat")]
    derived += [F.try_divide(f"_{n}_um", "length").alias(f"{n}_length") for n in CLASSES.values()]
    for c in SPLIT_CLASSES:
        n = CLASSES[c]
        derived += [F.try_divide(f"_{n}_post", "post_length").alias(f"post_{n}"),
                    F.try_divide(F.col(f"_{n}_n") - F.col(f"_{n}_post"), F.col("ant_length")).alias(f"ant_{n}")]
    derived += _bin_shares(total) + length_ratios(compat=compat)
    done = {c for c in blocks.columns if not c.startswith("_")}
    wide = (
        blocks.join(lengths, "image_id").join(medians, "image_id", "left").join(contacts, "image_id", "left")
        .select("image", "genotype", "length", "cellbody",
                *[c for c in done if c != "image_id"],
                *[f"{CLASSES[c]}_median" for c in SPREAD_CLASSES],
                *[c for c in contacts.columns if c != "image_id"], *derived)
    )
    return wide.select("image", "genotype", *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES])
