"""Paths and polylines: lengths, frames, sampling grids, resampling, branch shape."""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.functions.patterns import blocked, halo_tiles, salted_join
from ramify.functions.scalars import angle_deg, distance, idiv, safe_acos, wrapped_diff

BLOCK = 4096
NO_POINTS = "array<struct<y:int,x:int>>"


# ---- centre lines ----------------------------------------------------------

def _ordered(path, before=0, after=0):
    return blocked(path, "i", BLOCK, before, after), W.partitionBy("image_id", "blk").orderBy("i")


def path_length(path):
    """Sum of |dy| + |dx| along each path, rounded half to even: the number of samples."""
    rows, order = _ordered(path, before=1)
    step = (F.abs(F.col("y") - F.lag("y").over(order)) + F.abs(F.col("x") - F.lag("x").over(order)))
    return (
        rows.withColumn("step", step).filter("own").groupBy("image_id")
        .agg(F.bround(F.coalesce(F.sum("step"), F.lit(0.0))).cast("long").alias("n_samples"))
    )


def flip_path(path):
    """Reverse the order of each path."""
    n = path.groupBy("image_id").agg((F.max("i") + 1).alias("_n"))
    return path.join(n, "image_id").withColumn("i", F.col("_n") - 1 - F.col("i")).drop("_n")


def subsample_path(path, k=10):
    return path.filter(F.col("i") % k == 0)


def interpolate_path(path, k):
    """k points a step on the straight way between consecutive points; the last point stays as it is."""
    rows, order = _ordered(path, after=1)
    rows = rows.withColumn("_ny", F.lead("y").over(order)).withColumn("_nx", F.lead("x").over(order)).filter("own")
    rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.when(F.col("_ny").isNull(), 0).otherwise(k - 1))))
    between = lambda a, b: F.col(a) + (F.coalesce(F.col(b), F.col(a)) - F.col(a)) * (F.col("_s") / float(k))
    return rows.select("image_id", (F.col("i") * k + F.col("_s")).cast("int").alias("i"), between("y", "_ny").alias("y"),
                       between("x", "_nx").alias("x"))


def path_frames(path):
    """Unit tangents (forward difference; the last repeats the one before) and normals."""
    rows, order = _ordered(path, before=1, after=1)
    ahead = lambda c: F.coalesce(F.lead(c).over(order) - F.col(c), F.col(c) - F.lag(c).over(order))
    rows = rows.withColumn("_ty", ahead("y")).withColumn("_tx", ahead("x")).filter("own")
    norm = F.hypot("_ty", "_tx")
    ty, tx = F.try_divide("_ty", norm), F.try_divide("_tx", norm)
    return rows.select("image_id", "i", "y", "x", ty.alias("ty"), tx.alias("tx"),
                       (-tx).alias("ny"), ty.alias("nx"))


def sampling_grid(frames, width=100):
    """`width` points across each path point, evenly from -width/2 to width/2 inclusive."""
    d = F.lit(-width / 2.0) + F.col("j") * (float(width) / (width - 1))
    return (
        frames.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .withColumn("y", F.col("y") + d * F.col("ny")).withColumn("x", F.col("x") + d * F.col("nx"))
        .drop("ty", "tx", "ny", "nx")
    )


def _weights(t):
    """Quadratic B-spline weights of the cells before, at and after a point `t` from the cell's middle."""
    return np.stack([0.5 * (0.5 - t) ** 2, 0.75 - t ** 2, 0.5 * (0.5 + t) ** 2])


def _sample_tile(at, pixel, keys, planes):
    """Values of one tile's samples in each of its planes; a sample without any pixel around it gives no row."""
    columns = {"image_id": at["image_id"].iloc[:0], **{c: pixel[c].iloc[:0] for c in planes}, **{c: at[c].iloc[:0] for c in keys},
               "v": np.zeros(0)}
    if not len(at) or not len(pixel):
        return pd.DataFrame(columns)
    taps = []
    for axis, size in (("y", "length_px"), ("x", "width_px")):
        base = np.floor(at[axis].to_numpy() + 0.5)
        cell = np.abs(base + np.arange(-1, 2)[:, None])
        n = at[size].to_numpy()
        taps.append((np.where(cell > n - 1, 2 * n - 2 - cell, cell).astype(np.int64), _weights(at[axis].to_numpy() - base)))
    (cy, wy), (cx, wx) = taps
    y0, x0 = int(min(cy.min(), pixel["y"].min())), int(min(cx.min(), pixel["x"].min()))
    shape = int(max(cy.max(), pixel["y"].max())) - y0 + 1, int(max(cx.max(), pixel["x"].max())) - x0 + 1
    out = []
    for plane, part in pixel.groupby(list(planes), sort=False) if planes else [((), pixel)]:
        value, known = np.zeros(shape), np.zeros(shape, bool)
        where = part["y"].to_numpy() - y0, part["x"].to_numpy() - x0
        value[where], known[where] = part["v"].to_numpy(), True
        total, seen = np.zeros(len(at)), np.zeros(len(at), bool)
        for j in range(3):
            for i in range(3):
                cell = cy[j] - y0, cx[i] - x0
                total += wy[j] * wx[i] * value[cell]
                seen |= known[cell]
        found = at.loc[seen, ["image_id", *keys]].copy()
        for name, v in zip(planes, plane):
            found[name] = v
        found["v"] = total[seen]
        out.append(found)
    return pd.concat(out)[list(columns)]


def resample_grid(grid, pixel, image, *, keys=("i", "j"), planes=(), tile=64):
    """Value of the image at fractional coordinates (3 x 3 stencil); 0 outside the image.

    `keys` name a sample within its image, `planes` are extra columns shared with `pixel` (z for stacks), matched exactly.
    Samples and pixels of one tile meet in one task, pixels with a rim of one; a task holds all planes of its tile.
    """
    dims = image.select("image_id", "length_px", "width_px")
    at = salted_join(grid, dims, ["image_id"], F.struct(*keys))
    inside = (F.col("y").between(0, F.col("length_px") - 1)) & (F.col("x").between(0, F.col("width_px") - 1))
    home = lambda axis: idiv(F.floor(F.col(axis) + 0.5), tile)
    samples = at.filter(inside).select("image_id", *keys, "y", "x", "length_px", "width_px", home("y").alias("ty"), home("x").alias("tx"))
    cells = halo_tiles(pixel.select("image_id", *planes, "y", "x", "v"), 1, tile=tile)
    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(grid, "image_id"), *[kind(pixel, c) for c in planes], *[kind(grid, c) for c in keys], "v double"])
    place = ["image_id", "ty", "tx"]
    hit = samples.groupBy(*place).cogroup(cells.groupBy(*place)).applyInPandas(
        lambda a, p: _sample_tile(a, p, list(keys), list(planes)), schema)
    outside = at.filter(~inside).select("image_id", *keys, F.lit(0.0).alias("v"))
    if planes:
        of_image = pixel.select("image_id", *planes).distinct()  # combined in the tasks that scan; a row per image and plane
        outside = salted_join(outside, of_image, ["image_id"], F.struct(*keys))
    return hit.unionByName(outside)


def straighten_stack(grid, voxel, image, *, keys=("i", "j")):
    """Every slice of a stack sampled on the grid, cut to whole numbers."""
    return resample_grid(grid, voxel, image, keys=keys, planes=("z",)).withColumn(
        "v", F.floor(F.greatest(F.lit(0.0), F.round("v", 9))).cast("int"))


# ---- shape of branches and fragments ---------------------------------------

def branch_geometry(branch, *, line="branch", interval=7):
    """orientation, curvature and waviness from blocks of `interval` points.

    Row-wise array expressions: the polyline never leaves its row.
    """
    pts = F.col(line)
    n = F.size(pts)
    blocks = F.floor(n / interval).cast("int")
    vec = F.transform(
        F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(
            (F.element_at(pts, k * interval + 1)["y"] - F.element_at(pts, k * interval + interval)["y"]).alias("dy"),
            (F.element_at(pts, k * interval + interval)["x"] - F.element_at(pts, k * interval + 1)["x"]).alias("dx")))
    rows = branch.withColumn("_vec", vec)
    rows = rows.withColumn("_angle", F.transform("_vec", lambda v: angle_deg(v["dy"], v["dx"])))
    a = F.col("_angle")
    turns = F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))),
                        lambda v, k: F.struct((v - F.element_at(a, k + 1)).alias("d"),
                                              wrapped_diff(v, F.element_at(a, k + 1)).alias("w")))
    rows = rows.withColumn("_turn", turns)
    t = F.col("_turn")
    switches = F.size(F.filter(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                               lambda v, k: (v["d"] >= 0) != (F.element_at(t, k + 1)["d"] >= 0)))
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + f(v))
    mean_dy = F.try_divide(total(F.col("_vec"), lambda v: v["dy"]), F.size("_vec"))
    mean_dx = F.try_divide(total(F.col("_vec"), lambda v: v["dx"]), F.size("_vec"))
    o = angle_deg(mean_dy, mean_dx)
    long_enough = n >= 2 * interval
    curvature = F.when(long_enough, F.try_divide(total(t, lambda v: v["w"]), F.size(t))).otherwise(0.0)
    return (
        rows.withColumn("orientation", F.when(o < 0, o + 180).otherwise(o))
        .withColumn("curvature", curvature)
        .withColumn("tortuosity", F.when(long_enough, F.col("curvature") * switches / n).otherwise(0.0))
        .drop("_vec", "_angle", "_turn")
    )


def menger_curvature(line, window=20):
    """Mean of 2 sin(angle) / chord over points with neighbours at +-window/2; 0 for short lines."""
    half = window // 2
    n = F.size(line)

    def at(i):
        a, p, b = F.element_at(line, i - half), F.element_at(line, i), F.element_at(line, i + half)
        ay, ax, by, bx = a["y"] - p["y"], a["x"] - p["x"], b["y"] - p["y"], b["x"] - p["x"]
        chord = distance(a["y"], a["x"], b["y"], b["x"])
        # Each vector is normalised before the product; the order of operations shows near +-1.
        la, lb = F.hypot(ay.cast("double"), ax.cast("double")), F.hypot(by.cast("double"), bx.cast("double"))
        dot = F.try_divide(ay, la) * F.try_divide(by, lb) + F.try_divide(ax, la) * F.try_divide(bx, lb)
        return F.try_divide(2 * F.sin(safe_acos(dot)), chord)

    inner = F.transform(F.sequence(F.lit(half + 1), n - half), at)
    kept = F.filter(inner, lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v), F.size(kept))
    return F.when(n <= window, 0.0).otherwise(mean)


def avg_step(line):
    """Mean Euclidean step of a polyline; 1 for fewer than two points."""
    n = F.size(line)
    total = F.aggregate(
        F.slice(line, 2, F.greatest(n - 1, F.lit(0))),
        F.struct(F.lit(0.0).alias("s"), F.element_at(line, 1).alias("p")),
        lambda acc, q: F.struct((acc["s"] + distance(acc["p"]["y"], acc["p"]["x"], q["y"], q["x"])).alias("s"),
                                q.alias("p")))["s"]
    return F.when(n < 2, 1.0).otherwise(total / (n - 1))


PLACE = 1 << 33  # ranks of an INT, null included


def _place(*cols):
    """INT columns as one number that orders like a struct of them, nulls first."""
    digit = lambda c: F.coalesce(F.col(c).cast("long") + (1 << 31) + 1, F.lit(0).cast("long"))
    low = digit(cols[1]).cast("decimal(38,0)") * F.lit(PLACE).cast("decimal(10,0)") + digit(cols[2])
    return (digit(cols[0]).cast("decimal(11,0)") * F.lit(str(PLACE * PLACE)).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _placed(number, names):
    """The INTs that `_place` made a number of."""
    base, square = F.lit(PLACE).cast("decimal(38,0)"), F.lit(str(PLACE * PLACE)).cast("decimal(38,0)")
    low = number % square
    whole = lambda high, part: F.call_function("div", high, part)
    digits = [whole(number, square), whole(low, base), (low % base).cast("long")]
    return F.struct(*[F.when(d > 0, d - (1 << 31) - 1).cast("int").alias(n) for d, n in zip(digits, names)])


def branch_summary(points):
    """Points, mean position, first and last point per branch, from exploded points.

    The first and the last point are the least and the greatest number of a fixed width, which Spark combines by hash in the
    tasks that make the points; structs would have all points sorted before any are combined.
    """
    names = ["i", "y", "x"]
    flat = all(points.schema[c].dataType.simpleString() == "int" for c in names)
    key = _place(*names) if flat else F.struct(*names)
    rows = points.select("image_id", "id", "y", "x", key.alias("_at")).groupBy("image_id", "id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    point = lambda c: _placed(F.col(c), names) if flat else F.col(c)
    first, last = point("_first"), point("_last")
    return rows.select(
        "image_id", "id", "n", "mean_x", "mean_y", first["y"].alias("y_first"), first["x"].alias("x_first"),
        last["y"].alias("y_last"), last["x"].alias("x_last"))


# ---- time points -----------------------------------------------------------

def mean_interval(timepoint):
    """Mean gap between consecutive time points in seconds, 3 decimals; NULL for fewer than two.

    Gaps telescope, so the first and the last point decide; no window is needed.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = timepoint.filter(F.col("ts").isNotNull())
    span = F.max_by(micros, F.col("n")) - F.min_by(micros, F.col("n"))
    return rows.groupBy("image_id").agg(
        F.round(F.try_divide(span / 1e6, F.count(F.lit(1)) - 1), 3).alias("interval"))
