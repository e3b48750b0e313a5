"""Column expressions: angles, distances, polyline access, unit conversion, text keys."""

from pyspark.sql import functions as F

UM_PER_PX = 0.1048


def idiv(col, k):
    """Floor division, also for negative numbers."""
    return F.floor(col / F.lit(k))


def angle_deg(dy, dx):
    return F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))


def wrapped_diff(a, b):
    """Difference of two angles on the circle, 0..180 for inputs within 360 of each other."""
    d = F.abs(a - b)
    return F.least(d, F.lit(360.0) - d)


def distance(y1, x1, y2, x2):
    return F.hypot((y1 - y2).cast("double"), (x1 - x2).cast("double"))


def near_reversal(p1, p2, p3, limit=-0.8):
    """True where the step p1->p2 is almost undone by p2->p3; false for zero-length steps."""
    ay, ax = p2["y"] - p1["y"], p2["x"] - p1["x"]
    by, bx = p3["y"] - p2["y"], p3["x"] - p2["x"]
    la, lb = F.hypot(ay.cast("double"), ax.cast("double")), F.hypot(by.cast("double"), bx.cast("double"))
    dot = F.try_divide(ay, la) * F.try_divide(by, lb) + F.try_divide(ax, la) * F.try_divide(bx, lb)
    return F.when((la < 1e-10) | (lb < 1e-10), F.lit(False)).otherwise(dot < limit)


def first_point(line):
    return F.try_element_at(line, F.lit(1))


def last_point(line):
    return F.try_element_at(line, F.lit(-1))


def middle_point(line):
    """The element at 0-based position len // 2."""
    return F.try_element_at(line, (F.floor(F.size(line) / 2) + 1).cast("int"))


def flat_line(df, line):
    """Points as two arrays of numbers, for shuffles: a quarter of the bytes of an array of structs."""
    return df.withColumns({f"{line}_{a}": F.col(line).getField(a) for a in "yx"}).drop(line)


def whole_line(df, line):
    """Points as an array of structs again."""
    points = F.zip_with(f"{line}_y", f"{line}_x", lambda y, x: F.struct(y.alias("y"), x.alias("x")))
    return df.withColumn(line, points).drop(f"{line}_y", f"{line}_x")


def mean_coord(line, axis):
    """Mean of one coordinate of a polyline (NULL when empty)."""
    total = F.aggregate(line, F.lit(0).cast("long"), lambda acc, p: acc + p[axis])
    return F.try_divide(total.cast("double"), F.size(line))


def um(px, um_per_px=UM_PER_PX):
    """Pixels to whole micrometres, halves to even."""
    return F.bround(px * F.lit(um_per_px))


def axial(orientation):
    """Fold orientations above 90 degrees to negative ones."""
    return F.when(orientation > 90, orientation - 180).otherwise(orientation)


def quat_filter(rel_x):
    return F.lit(0.2) * F.sin(F.lit(3.0) * F.pi() * rel_x) + F.lit(0.5)


def safe_acos(c):
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def pad_to(n, multiple=16):
    """How many cells bring n up to the next multiple."""
    return (F.ceil(n / F.lit(multiple)) * multiple - n).cast("int")


def parse_timestamp(text):
    """Timestamp, or NULL where the text does not parse."""
    return F.try_to_timestamp(text)


def genotype_key(stem):
    """`<parts 2 and 3 of the file name, split on underscore>` joined by a dash."""
    parts = F.split(stem, "_")
    return F.concat_ws("-", F.try_element_at(parts, F.lit(3)), F.try_element_at(parts, F.lit(4)))


def pixel_code(y, x):
    """One LONG per pixel; its order is row-major scan order."""
    return F.shiftleft(y.cast("long"), 32).bitwiseOR(x.cast("long"))


def code_y(code):
    return F.shiftright(code, 32).cast("int")


def code_x(code):
    return code.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
