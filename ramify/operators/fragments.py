"""Fragment features, labels, merge candidates."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ramify.functions.boards import CELL, SHIFT, bit, cell_code, packed, point_boards, tiles_of, to_pixels, word_array
from ramify.functions.patterns import cut, interval_buckets, salted_join, sorted_side
from ramify.functions.scalars import (
    angle_deg, distance, first_point, idiv, last_point, middle_point, quat_filter)
from ramify.operators.geometry import avg_step, menger_curvature

MIN_POINTS = 5


def min_size_filter(df, line="segment", more_than=MIN_POINTS):
    return df.filter(F.size(line) > more_than)


def shape_features(fragment, image, *, line="segment"):
    """Length, chord angle, tortuosity, relative position, sine filter and curvature, row by row.

    All that needs the points is worked out before they meet their image's size.
    """
    pts = F.col(line)
    a, b, m = first_point(pts), last_point(pts), middle_point(pts)
    n = F.size(pts)
    chord = distance(b["y"], b["x"], a["y"], a["x"])
    rel_x = F.col("_mx") / F.col("width_px")
    measured = fragment.withColumns({
        "length": n, "orientation": angle_deg(b["y"] - a["y"], b["x"] - a["x"]),
        "tortuosity": F.when(chord > 0, n / chord).otherwise(1.0), "curvature": menger_curvature(pts), "_my": m["y"], "_mx": m["x"]})
    names = list(dict.fromkeys(["image_id", *fragment.columns, "length", "orientation", "tortuosity", "relative_x", "relative_y",
                                "quat_filter", "curvature"]))
    return (
        salted_join(measured, image.select("image_id", "length_px", "width_px"), ["image_id"], F.col("id"))
        .withColumns({"relative_x": rel_x, "relative_y": F.col("_my") / F.col("length_px"), "quat_filter": quat_filter(rel_x)})
        .select(*names)
    )


def _values_under(batches):
    """Sum, number of known values and number of points of the pixels that a line's board (`bits`) and a board with values share."""
    for batch in batches:
        line, cell = (np.unpackbits(batch.column(k).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8),
                                    axis=1, bitorder="little").astype(bool) for k in (2, 3))
        values = pc.cast(batch.column(4).flatten(), pa.float64())
        known = values.is_valid().to_numpy(zero_copy_only=False)
        row, place = np.nonzero(cell)
        on = line[row, place]
        count = lambda which, weight=None: np.bincount(row[which], weight, minlength=batch.num_rows)
        hit = on & known
        total = count(hit, pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)[hit])
        met = count(on)
        keep = pa.array(met > 0)
        out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(total.astype(float)), pa.array(count(hit).astype(np.int64))],
                                         names=[*batch.schema.names[:2], "total", "n"])
        yield out.filter(keep)


def sample_intensity(df, pixel, *, line="segment"):
    """(image_id, id, average_intensity): mean pixel value under the points of each polyline.

    Points and pixels meet as boards of cells; a board of pixels carries its values in the order of its bits.
    """
    under = point_boards(df, line, ["image_id", "id"]).join(
        sorted_side(packed(pixel, value="v").select("image_id", "cell", F.col("bits").alias("_bits"), "values")), ["image_id", "cell"]).select(
        "image_id", "id", "bits", "_bits", "values")
    of = under.schema
    return (
        under.mapInArrow(_values_under, f"image_id {of['image_id'].dataType.simpleString()}, id {of['id'].dataType.simpleString()}, total double, n long")
        .groupBy("image_id", "id").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("average_intensity"))
    )


def label_midpoint(fragment, label_pixel, *, line="segment"):
    """Label under the middle point; 0 where there is none. Pixels of one label come as boards to the cells of the points."""
    m = middle_point(F.col(line))
    point = fragment.select("image_id", "id", m["y"].alias("y"), m["x"].alias("x")).select(
        "image_id", "id", cell_code(F.shiftright("y", SHIFT), F.shiftright("x", SHIFT)).alias("cell"), bit(F.col("y"), F.col("x")).alias("_bit"))
    named = packed(label_pixel, ["image_id", "label"]).select(
        F.col("image_id").alias("_image"), F.col("cell").alias("_cell"), "bits", "label")
    met = (F.col("image_id") == F.col("_image")) & (F.col("cell") == F.col("_cell")) & (F.col("bits").bitwiseAND(F.col("_bit")) != 0)
    return point.join(sorted_side(named), met, "left").select("image_id", "id", F.coalesce("label", F.lit(0)).alias("label"))


def drop_unlabelled(df):
    return df.filter("label <> 0")


def layer_hits(fragment, layer, *, line="segment"):
    """Share of points on the horizontal layer among those on either; 0 when on none. Points and layers meet as boards."""
    both = F.bit_count(F.col("bits").bitwiseAND(F.col("_bits")))
    named = packed(layer.filter("layer is not null"), ["image_id", "layer"]).withColumnRenamed("bits", "_bits")
    hits = point_boards(fragment, line, ["image_id", "id"]).join(sorted_side(named), ["image_id", "cell"]).filter(both > 0).select(
        "image_id", "id", F.when(F.col("layer") == "h", both).otherwise(0).alias("h"), both.alias("n"))
    every = fragment.filter(F.size(line) > 0).select("image_id", "id", F.lit(0).alias("h"), F.lit(0).alias("n"))
    share = F.coalesce(F.try_divide(F.sum("h"), F.sum("n")), F.lit(0.0))
    return (
        hits.unionByName(every).groupBy("image_id", "id").agg(share.alias("h_share"))
        .withColumn("horizontal_likely", F.col("h_share") > 0.5)
    )


DENSITY_TILE = 512


def _pixels_in_boxes(boxes, cells, tile):
    """The pixels of one tile that lie in each box, from sums over all rows and columns before a place."""
    if not len(boxes):
        return pd.DataFrame({"image_id": np.zeros(0, int), "id": np.zeros(0, "int32"), "area": np.zeros(0, int), "n": np.zeros(0, int)})
    n = np.zeros(len(boxes), np.int64)
    if len(cells):
        cell, bits = cells["cell"].to_numpy(), cells["bits"].to_numpy()
        cy, cx = cell >> 32, cell.astype(np.int32).astype(np.int64)
        box = int(cy.min()), int(cx.min()), int(cy.max()), int(cx.max())
        pixels = to_pixels(word_array(cell, bits, box))
        before = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int32)
        before[1:, 1:] = pixels.cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)
        # a box counts here only what the tile has of it; pixels of a cell that the tile shares with the next are not the tile's
        ty, tx = int(boxes["ty"].iloc[0]) * tile, int(boxes["tx"].iloc[0]) * tile
        place = lambda c, low, first, size: np.clip(np.clip(boxes[c].to_numpy(), low, low + tile) - first * CELL, 0, size)
        y0, y1 = (place(c, ty, box[0], pixels.shape[0]) for c in ("y0", "y1"))
        x0, x1 = (place(c, tx, box[1], pixels.shape[1]) for c in ("x0", "x1"))
        n = (before[y1, x1] - before[y0, x1] - before[y1, x0] + before[y0, x0]).astype(np.int64)
        n[(y1 <= y0) | (x1 <= x0)] = 0
    return boxes[["image_id", "id", "area"]].assign(n=n)


def local_density(fragment, skeleton, image, *, reach=200, line="segment", tile=DENSITY_TILE):
    """Skeleton pixels in the clipped box [mid - reach, mid + reach) over the box's area.

    A box meets the tiles it touches, each a table of sums over its own pixels; the counts of a box's tiles are added. Only
    boards that hold a pixel travel, and no pixel is paired with a fragment.
    """
    m = middle_point(F.col(line))
    dims = image.select("image_id", "length_px", "width_px")
    lo = lambda v: F.greatest(F.lit(0), v - reach)
    box = (
        salted_join(fragment.select("image_id", "id", m["y"].alias("_y"), m["x"].alias("_x")), dims, ["image_id"], F.col("id"))
        .select("image_id", "id", lo(F.col("_y")).alias("y0"), F.least("length_px", F.col("_y") + reach).alias("y1"),
                lo(F.col("_x")).alias("x0"), F.least("width_px", F.col("_x") + reach).alias("x1"))
        .withColumn("area", ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).cast("long"))
    )
    for axis in "yx":
        first = idiv(F.col(f"{axis}0"), tile)
        box = box.withColumn(f"t{axis}", F.explode(F.sequence(first, F.greatest(first, idiv(F.col(f"{axis}1") - 1, tile)))))
    key = ["image_id", "ty", "tx"]
    return (
        box.groupBy(*key).cogroup(tiles_of(packed(skeleton), 0, tile).groupBy(*key))
        .applyInPandas(lambda b, c: _pixels_in_boxes(b, c, tile), f"image_id long, id {box.schema['id'].dataType.simpleString()}, area long, n long")
        .groupBy("image_id", "id", "area").agg(F.sum("n").alias("n"))
        .select("image_id", "id", F.try_divide("n", "area").alias("local_density"))
    )


def eval_join(predicted, true):
    """Predicted against true class per fragment."""
    return predicted.join(true, ["image_id", "id"])


# ---- merge candidates ------------------------------------------------------

def connect_candidates(fragment, *, threshold=20.0, max_step_ratio=10.0, line="segment"):
    """Endpoint pairs of one image and class that may be joined, always from the lower id.

    (image_id, dendrite_type, a, b, type, ord, distance, needs_reverse); `ord` is the order in which
    the four kinds are tried.
    """
    tip = lambda end, p: F.struct(F.lit(end).alias("end"), p["y"].alias("y"), p["x"].alias("x"))
    ends = fragment.select(
        "image_id", "id", "dendrite_type", avg_step(F.col(line)).alias("step"),
        F.explode(F.array(tip(False, first_point(F.col(line))), tip(True, last_point(F.col(line))))).alias("t")
    ).select("image_id", "id", "dendrite_type", "step", "t.*")
    ends = cut(ends)  # both sides of the join read ends, no polylines
    reach = max(1, math.ceil(threshold))
    cell = 4 * reach  # an end looks into some two cells; with cells as wide as twice its reach it would be four
    mine = ends.select("image_id", "dendrite_type", F.col("id").alias("a"), F.col("end").alias("ka"),
                       F.col("y").alias("ya"), F.col("x").alias("xa"), F.col("step").alias("sa"))
    for axis in ("y", "x"):
        mine = mine.withColumn("_lo", F.col(f"{axis}a") - reach).withColumn("_hi", F.col(f"{axis}a") + reach)
        mine = interval_buckets(mine, "_lo", "_hi", cell, f"c{axis}").drop("_lo", "_hi")
    other = ends.select("image_id", "dendrite_type", F.col("id").alias("b"), F.col("end").alias("kb"),
                        F.col("y").alias("yb"), F.col("x").alias("xb"), F.col("step").alias("sb"),
                        idiv(F.col("y"), cell).alias("cy"), idiv(F.col("x"), cell).alias("cx"))
    d = distance(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb"))
    word = lambda c: F.when(F.col(c), "end").otherwise("start")
    order = F.when(F.col("ka"), 0).otherwise(2) + F.when(F.col("ka") == F.col("kb"), F.when(F.col("ka"), 1).otherwise(0)).otherwise(F.when(F.col("ka"), 0).otherwise(1))
    return (
        mine.join(sorted_side(other), ["image_id", "dendrite_type", "cy", "cx"])
        .filter((F.col("a") < F.col("b")) & (d <= threshold)
                & (d <= F.greatest("sa", "sb") * max_step_ratio))
        .select("image_id", "dendrite_type", "a", "b",
                F.concat(word("ka"), F.lit("_to_"), word("kb")).alias("type"), order.alias("ord"),
                d.alias("distance"), (F.col("ka") == F.col("kb")).alias("needs_reverse"))
    )


def nearest_candidate(candidates):
    """The closest candidate of each fragment and direction, first on ties.

    A min over structs: it combines before the shuffle, unlike a ranked window.
    """
    best = F.min(F.struct("distance", "b", "ord", "type", "needs_reverse"))
    forward = F.when(F.col("ord") < 2, "forward").otherwise("backward")
    return (
        candidates.groupBy("image_id", "dendrite_type", "a", forward.alias("direction")).agg(best.alias("m"))
        .select("image_id", "dendrite_type", "a", "direction", "m.b", "m.type", "m.distance", "m.needs_reverse")
    )
