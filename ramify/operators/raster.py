"""Raster preparation on pixel and voxel tables: sampling, projections, thresholds, filters."""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.functions.patterns import TILE, blocked, exact_quantiles, halo_tiles, salted_join
from ramify.functions.scalars import idiv

BAND = (0.375, 0.655)


# ---- sampling and projection -----------------------------------------------

def stride_downsample(df, k):
    """Keep every k-th row and column."""
    return (
        df.filter((F.col("y") % k == 0) & (F.col("x") % k == 0))
        .withColumn("y", idiv(F.col("y"), k).cast("int")).withColumn("x", idiv(F.col("x"), k).cast("int"))
    )


def max_projection(voxel):
    return voxel.groupBy("image_id", "y", "x").agg(F.max("v").alias("v"))


def pairwise_z_max(voxel):
    """Maximum of slices 2i and 2i + 1; a last slice without a partner is dropped."""
    return (
        voxel.groupBy("image_id", idiv(F.col("z"), 2).cast("int").alias("z"), "y", "x")
        .agg(F.max("v").alias("v"), F.max(F.col("z") % 2).alias("odd"))
        .filter("odd = 1").drop("odd")
    )


def make_small(voxel, k=8):
    """Downsampled projection of whole stacks."""
    return cast_uint(max_projection(stride_downsample(voxel, k)))


def make_squished(voxel, k=2):
    """Downsampled stack with slices merged in pairs."""
    return cast_uint(pairwise_z_max(stride_downsample(voxel, k)))


def cast_uint(df, col="v"):
    return df.withColumn(col, F.floor(col).cast("int"))


def mask_union_z(prob, threshold=None):
    """Largest probability over z, or the sparse union of the thresholded slices."""
    if threshold is None:
        return prob.groupBy("image_id", "y", "x").agg(F.max("p").alias("p"))
    return prob.filter(F.col("p") > threshold).select("image_id", "y", "x").distinct()


def threshold_mask(df, level, *, value="p", strict=True):
    """Sparse mask of the cells above (or, not strict, at and above) a level."""
    hit = F.col(value) > level if strict else F.col(value) >= level
    return df.filter(hit).drop(value)


def percentile_normalize(voxel, *, tile_rows, low=0.01, high=0.99):
    """(v - p1) / (p99 - p1) within each tile of each slice."""
    rows = voxel.withColumn("tile", idiv(F.col("y"), tile_rows).cast("int"))
    keys = ["image_id", "tile", "z"]
    q = exact_quantiles(rows, keys, "v", [low, high])
    joined = salted_join(rows, q.drop("n"), keys, F.struct("y", "x"))
    return joined.withColumn("p", F.try_divide(F.col("v") - F.col("q0"), F.col("q1") - F.col("q0"))).drop("q0", "q1")


def split_tiles(df, rows):
    """Tile number and row within the tile, for tiles stacked along y."""
    return df.withColumn("tile", idiv(F.col("y"), rows).cast("int")).withColumn("y", F.col("y") % rows)


def tile_union(tiles, rows):
    """Stack tile results back into images."""
    return tiles.withColumn("y", F.col("tile") * rows + F.col("y")).drop("tile")


def tile_assign(voxel, size, *, chunk=(64, 512, 512), overlap=(0, 0, 0), channels=None):
    """Every voxel in every chunk that covers it.

    Chunks start each max(1, chunk - overlap) cells and are clipped at the image. With `channels`
    the channels stand side by side as columns c0, c1, ...
    """
    if channels is not None:
        voxel = voxel.groupBy("image_id", "z", "y", "x").agg(*[
            F.coalesce(F.max(F.when(F.col("channel") == c, F.col("v"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(channels)])
    out = salted_join(voxel, size, ["image_id"], F.struct("z", "y", "x"))
    for axis, c, o, n in zip("zyx", chunk, overlap, ("depth_px", "length_px", "width_px")):
        step = max(1, c - o)
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(axis) - (c - 1)) / F.lit(step)))
        k = F.explode(F.sequence(first, idiv(F.col(axis), step)))
        out = (
            out.withColumn("_k", k).withColumn(f"{axis}_start", (F.col("_k") * step).cast("int"))
            .withColumn(f"{axis}_end", F.least(F.col(f"{axis}_start") + c, F.col(n)))
        )
    return out.drop("_k", "depth_px", "length_px", "width_px")


def channel_histogram(voxel, *, lo=0, width=16):
    return voxel.groupBy(
        "image_id", "resolution", "time_point", "channel", idiv(F.col("v") - lo, width).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- profile along y and the cell body -------------------------------------

def column_band(pixel, image, *, band=BAND):
    """Pixels in the middle columns of their image."""
    lo, hi = F.bround(F.col("width_px") * band[0]), F.bround(F.col("width_px") * band[1])
    return (
        salted_join(pixel, image.select("image_id", "width_px"), ["image_id"], F.struct("y", "x"))
        .filter((F.col("x") >= lo) & (F.col("x") < hi)).drop("width_px")
    )


def band_profile(pixel, image, *, band=BAND):
    """Mean intensity of each image row inside the band."""
    return column_band(pixel, image, band=band).groupBy("image_id", "y").agg(F.avg("v").alias("avg_v"))


def sliding_mean(profile, image, *, width=100, block=4096):
    """Mean of rows y .. y + width - 1, for y < n - width."""
    frame = W.partitionBy("image_id", "blk").orderBy("y").rowsBetween(0, width - 1)
    return (
        blocked(profile, "y", block, after=width - 1).withColumn("smooth", F.avg("avg_v").over(frame))
        .filter("own").join(image.select("image_id", "length_px"), "image_id")
        .filter(F.col("y") < F.col("length_px") - width).select("image_id", "y", "smooth")
    )


def local_peaks(smooth, *, margin=0.0001, block=4096):
    """Rows above both neighbours by more than `margin`; the two ends never count."""
    order = W.partitionBy("image_id", "blk").orderBy("y")
    return (
        blocked(smooth, "y", block, before=1, after=1)
        .withColumn("_before", F.lag("smooth").over(order)).withColumn("_after", F.lead("smooth").over(order))
        .filter(F.col("own") & (F.col("smooth") > F.col("_before") + margin)
                & (F.col("smooth") > F.col("_after") + margin))
        .select("image_id", "y", "smooth")
    )


def cell_body(pixel, image, *, width=100):
    """First row whose smoothed value equals the highest peak, plus half the window.

    NULL for images without a peak.
    """
    smooth = sliding_mean(band_profile(pixel, image), image, width=width)
    top = local_peaks(smooth).groupBy("image_id").agg(F.max("smooth").alias("smooth"))
    at = smooth.join(top, ["image_id", "smooth"]).groupBy("image_id").agg(F.min("y").alias("_y"))
    px = (F.col("_y") + width // 2).cast("int")
    return image.select("image_id", "length_px").join(at, "image_id", "left").select(
        "image_id", px.alias("cellbody_px"), (100.0 * px / F.col("length_px")).alias("cellbody_pct"))


# ---- thresholds from histograms --------------------------------------------

def otsu_threshold(pixel, *, value="v", bins=256):
    """Centre of the bin that maximises the between-class variance, per image; the first of equal ones.

    The variance is taken in bins, from counts and sums that are whole numbers, so it does not depend on how
    large the values are. A flat image has no threshold.
    """
    span = pixel.groupBy("image_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / float(bins)
    b = F.least(F.floor((F.col(value) - F.col("lo")) / w), F.lit(bins - 1))
    hist = (
        salted_join(pixel, span, ["image_id"], F.struct("y", "x")).filter("hi > lo")
        .groupBy("image_id", "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        .withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * w)
    )
    upto = W.partitionBy("image_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("image_id")
    s = F.col("c") * F.col("bin")
    total = lambda c, over: F.sum(c).over(over).cast("double")
    parts = hist.select(
        "image_id", "bin", "centre", total("c", upto).alias("n1"), total(s, upto).alias("s1"),
        total("c", whole).alias("n"), total(s, whole).alias("s"))
    gap = F.col("s1") * F.col("n") - F.col("s") * F.col("n1")
    between = gap * gap / (F.col("n1") * (F.col("n") - F.col("n1")))
    return (
        parts.filter("n1 < n").groupBy("image_id")
        .agg(F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("first"), "centre"))["centre"].alias("threshold"))
    )


def triangle_threshold(pixel, *, value="v"):
    """Level farthest from the chord between the histogram's peak and its longer tail, per image."""
    hist = pixel.groupBy("image_id", F.col(value).alias("level")).agg(F.count(F.lit(1)).alias("c"))
    shape = hist.groupBy("image_id").agg(
        F.min("level").alias("lo"), F.max("level").alias("hi"), F.max("c").alias("top"),
        (-F.max(F.struct("c", (-F.col("level")).alias("neg")))["neg"]).alias("peak"))
    right = (F.col("peak") - F.col("lo")) < (F.col("hi") - F.col("peak"))
    shape = shape.withColumn("right", right).withColumn(
        "width", F.when(right, F.col("hi") - F.col("peak")).otherwise(F.col("peak") - F.col("lo")))
    dense = shape.withColumn("level", F.explode(F.sequence("lo", "hi"))).join(hist, ["image_id", "level"], "left")
    step = F.when(F.col("right"), F.col("hi") - F.col("level")).otherwise(F.col("level") - F.col("lo"))
    length = F.col("top") * step - F.col("width") * F.coalesce("c", F.lit(0))
    best = (
        dense.withColumn("step", step).filter((F.col("step") >= 0) & (F.col("step") < F.col("width")))
        .groupBy("image_id")
        .agg(F.max(F.struct(length.alias("d"), (-F.col("step")).alias("first"), "level"))["level"].alias("threshold"))
    )
    flat = shape.filter("lo = hi").select("image_id", F.col("lo").alias("threshold"))
    return best.unionByName(flat)


# ---- separable filters over tiles with a halo ------------------------------

def _fold(index, n, mode):
    """Indices outside 0..n-1 brought inside, by repeating, reflecting or mirroring."""
    if mode == "nearest" or n == 1:
        return np.clip(index, 0, n - 1)
    period = 2 * n if mode == "reflect" else 2 * n - 2
    m = np.mod(index, period)
    return np.where(m >= n, period - (1 if mode == "reflect" else 0) - m, m)


def _along(a, first, lo, hi, n, kernel, mode):
    """Filter axis 0 of `a` (rows first, first+1, ..) for rows lo..hi-1 of an axis of length n."""
    reach = len(kernel) // 2
    rows = a[_fold(np.arange(lo - reach, hi + reach), n, mode) - first]
    return sum(w * rows[k:k + hi - lo] for k, w in enumerate(kernel))


def separable_filter(pixel, image, kernel, mode, *, value="v", tile=TILE):
    """Convolve rows and columns with a symmetric kernel; exact across tile borders.

    Tiles carry a halo, so one shuffle serves both passes and no task holds more than
    (tile + 2 reach)^2 pixels.
    """
    reach = len(kernel) // 2
    kernel = [float(w) for w in kernel]

    def one_tile(pdf):
        h, w = int(pdf["length_px"].iloc[0]), int(pdf["width_px"].iloc[0])
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        a = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1))
        a[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf[value].to_numpy()
        ylo, yhi = ty * tile, min(h, (ty + 1) * tile)
        xlo, xhi = tx * tile, min(w, (tx + 1) * tile)
        b = _along(a, y0, ylo, yhi, h, kernel, mode)
        b = _along(b.T, x0, xlo, xhi, w, kernel, mode).T
        yy, xx = np.mgrid[ylo:yhi, xlo:xhi]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": yy.ravel().astype("int32"),
                             "x": xx.ravel().astype("int32"), "v": b.ravel()})

    rows = salted_join(pixel.select("image_id", "y", "x", value), image.select("image_id", "length_px", "width_px"),
                       ["image_id"], F.struct("y", "x"))
    tiles = halo_tiles(rows, reach, tile=tile).filter(
        (F.col("ty") * tile < F.col("length_px")) & (F.col("tx") * tile < F.col("width_px")))
    return tiles.groupBy("image_id", "ty", "tx").applyInPandas(
        one_tile, "image_id long, y int, x int, v double")


def gaussian_kernel(sigma):
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian_blur(pixel, image, sigma=10.0, *, mode="reflect", tile=TILE):
    """Gaussian of radius int(4 sigma + .5); `reflect` or `nearest` at the border."""
    return separable_filter(pixel, image, gaussian_kernel(sigma), mode, tile=tile)
