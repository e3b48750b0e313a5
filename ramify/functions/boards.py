"""Pixels as bitboards: a cell of 8 x 8 pixels is one LONG, so that shuffles carry cells instead of pixels."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ramify.functions.patterns import TILE, interval_buckets, spread
from ramify.functions.scalars import idiv

SHIFT = 3
CELL = 1 << SHIFT
OFFSETS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]  # scan order; bit k of `near` is OFFSETS[k]
CROSS = sum(1 << k for k, (dy, dx) in enumerate(OFFSETS) if not (dy and dx))
CENTRE = 4


def _shifted(name, value, by):
    return F.call_function(name, value, by.cast("int"))


def _signed(value):
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value)


def bit(y, x):
    """Bit of a pixel within its cell, as a LONG."""
    low = lambda c: c.cast("int").bitwiseAND(F.lit(CELL - 1))
    return _shifted("shiftleft", F.lit(1).cast("long"), F.shiftleft(low(y), SHIFT).bitwiseOR(low(x)))


def cell_code(cy, cx):
    """One LONG per cell, negative ones too."""
    return F.shiftleft(cy.cast("long"), 32).bitwiseOR(cx.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))


def _runs_in_cells(batches):
    """Consecutive points of a line in one cell become one row of that cell; the line is the last column."""
    for batch in batches:
        row, y, x = points_of_lines(batch)
        if not len(row):
            continue
        cell = (y >> SHIFT) << 32 | (x >> SHIFT) & ((1 << 32) - 1)
        bits = np.left_shift(np.int64(1), (y & CELL - 1) << SHIFT | x & CELL - 1)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]))
        keys = batch.take(pa.array(row[first])).columns[:-1]
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array(cell[first]), pa.array(np.bitwise_or.reduceat(bits, first))], names=[*batch.schema.names[:-1], "cell", "bits"])


def points_of_lines(batch):
    """Row, y and x of the points of a batch's lines (its last column) that have both."""
    line = batch.column(batch.num_columns - 1)
    size = pc.fill_null(pc.list_value_length(line), 0).to_numpy(zero_copy_only=False)
    flat = line.flatten()
    axes = [pc.struct_field(flat, [flat.type.get_field_index(axis)]) for axis in ("y", "x")]
    known = pc.and_(axes[0].is_valid(), axes[1].is_valid()).to_numpy(zero_copy_only=False)
    y, x = (pc.fill_null(axis, 0).to_numpy(zero_copy_only=False).astype(np.int64)[known] for axis in axes)
    return np.repeat(np.arange(len(size)), size)[known], y, x


def _in_cells(owner, y, x):
    """Points as boards that lose none: (order, first, cell, bits).

    `order` puts the points of one owner and cell side by side by bit, `first` are the places in it where a board begins.
    A pixel that comes again goes into a further board of its cell, so every point is one bit of one board.
    """
    cell = (y >> SHIFT) << 32 | (x >> SHIFT) & ((1 << 32) - 1)
    place = (y & CELL - 1) << SHIFT | x & CELL - 1
    order = np.lexsort((place, cell, owner))
    new = lambda *cols: np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
    fresh = new(owner[order], cell[order], place[order])
    at = np.arange(len(order))
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    if again.any():
        by = np.lexsort((place[order], again, cell[order], owner[order]))
        order, again = order[by], again[by]
    first = np.flatnonzero(new(owner[order], cell[order], again))
    bits = np.bitwise_or.reduceat(np.left_shift(np.int64(1), place[order]), first)
    return order, first, cell[order][first], bits


def _lines_in_cells(batches):
    for batch in batches:
        row, y, x = points_of_lines(batch)
        if len(row):
            order, first, cell, bits = _in_cells(row, y, x)
            keys = batch.take(pa.array(row[order][first])).columns[:-1]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(cell), pa.array(bits)], names=[*batch.schema.names[:-1], "cell", "bits"])


def _pixels_in_cells(batches, n_keys):
    """Pixels (keys, y, x and perhaps a value) as boards, those of one batch together; values in the order of the bits."""
    for batch in batches:
        y, x = batch.column(n_keys), batch.column(n_keys + 1)
        batch = batch.filter(pc.and_(y.is_valid(), x.is_valid()))
        if not batch.num_rows:
            continue
        y, x = (batch.column(n_keys + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        owner = np.zeros(batch.num_rows, np.int64)
        for k in range(n_keys):
            code = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = owner * (code.max() + 1) + code
        order, first, cell, bits = _in_cells(owner, y, x)
        out = [*batch.take(pa.array(order[first])).columns[:n_keys], pa.array(cell), pa.array(bits)]
        names = [*batch.schema.names[:n_keys], "cell", "bits"]
        if batch.num_columns > n_keys + 2:
            ends = pa.array(np.append(first, len(order)).astype(np.int32))
            out.append(pa.ListArray.from_arrays(ends, batch.column(n_keys + 2).take(pa.array(order))))
            names.append("values")
        yield pa.RecordBatch.from_arrays(out, names=names)


def _schema(rows, keys, *more):
    return ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [*more])


def point_boards(df, line, keys):
    """(keys, cell, bits): every point of each polyline as one bit of one board, repeated points in boards of their own."""
    rows = df.select(*keys, line)
    return rows.mapInArrow(_lines_in_cells, _schema(rows, keys, "cell long", "bits long"))


def packed(pixels, keys=("image_id",), value=None):
    """(keys, cell, bits[, values]): pixels as boards made inside their batch, before any shuffle.

    A cell comes in as many boards as batches hold pixels of it; a pixel that comes twice is a bit of two boards.
    """
    rows = pixels.select(*keys, "y", "x", *([value] if value else []))
    more = [f"values array<{rows.schema[value].dataType.simpleString()}>"] if value else []
    n = len(keys)
    return rows.mapInArrow(lambda it: _pixels_in_cells(it, n), _schema(rows, keys, "cell long", "bits long", *more))


def line_boards(df, line, keys):
    """(keys, cell, bits): the pixels of each polyline as boards, made where its row is; points without y or x are left out.

    A cell comes once for every time the line passes through it.
    """
    rows = df.select(*keys, line)
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["cell long", "bits long"])
    return rows.mapInArrow(_runs_in_cells, schema)


def _set_bits(batches):
    """Every set bit of a board as a pixel; cell and board are the last columns."""
    for batch in batches:
        cell, bits = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False).astype("<i8") for k in (2, 1))
        row, k = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(len(bits), 8), axis=1, bitorder="little"))
        keys = batch.take(pa.array(row)).columns[:-2]
        y = (cell[row] >> 32) * CELL + (k >> SHIFT)
        x = cell[row].astype(np.int32).astype(np.int64) * CELL + (k & CELL - 1)  # the low half of the code
        yield pa.RecordBatch.from_arrays([*keys, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32))],
                                         names=[*batch.schema.names[:-2], "y", "x"])


def pixels_of(cells, *keys):
    """(keys, y, x): the pixels of the boards (keys, cell, bits)."""
    rows = cells.select(*keys, "cell", "bits")
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["y int", "x int"])
    return rows.mapInArrow(_set_bits, schema)


def gathered(cells, *aggs):
    """One row per image and cell, combined behind the shuffle: boards of different lines seldom share a cell within a task."""
    return spread(cells, "image_id", "cell").groupBy("image_id", "cell").agg(*(aggs or [F.bit_or("bits").alias("bits")]))


def first_of(boards):
    """An array of boards (label, bits) cut so that a pixel stays only in the first that has it."""
    none = F.struct(F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<label:int,bits:bigint>>").alias("out"))
    return F.aggregate(boards, none, lambda acc, b: F.struct(
        acc["taken"].bitwiseOR(b["bits"]).alias("taken"),
        F.concat(acc["out"], F.array(F.struct(
            b["label"].alias("label"), b["bits"].bitwiseAND(F.bitwise_not(acc["taken"])).alias("bits")))).alias("out")))["out"]


def boards(pixels, keys=("image_id",)):
    """(keys, cy, cx, bits) of the cells that hold a pixel."""
    cell = [F.shiftright(axis, SHIFT).alias(f"c{axis}") for axis in ("y", "x")]
    return pixels.groupBy(*keys, *cell).agg(F.bit_or(bit(F.col("y"), F.col("x"))).alias("bits"))


def square_cells(df, pad):
    """df's pixels (y, x) grown to squares of 2 pad + 1 pixels: one row per cell a square touches, with its bits there."""
    for axis in ("y", "x"):
        df = df.withColumn("_lo", F.col(axis) - pad).withColumn("_hi", F.col(axis) + pad)
        df = interval_buckets(df, "_lo", "_hi", CELL, f"c{axis}").drop("_lo", "_hi")
    first = lambda axis: F.greatest(F.lit(0), F.col(axis) - pad - F.col(f"c{axis}") * CELL)
    last = lambda axis: F.least(F.lit(CELL - 1), F.col(axis) + pad - F.col(f"c{axis}") * CELL)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    columns = _shifted("shiftleft", one, last("x") + 1) - _shifted("shiftleft", one, first("x"))
    rows = none
    for k in range(CELL):
        rows = rows.bitwiseOR(F.when((first("y") <= k) & (last("y") >= k), F.shiftleft("_columns", CELL * k)).otherwise(none))
    return df.withColumn("_columns", columns).withColumn("bits", rows).withColumn("cell", cell_code(F.col("cy"), F.col("cx"))).drop(
        "_columns", "y", "x", "cy", "cx")


def _rim(dy, dx):
    """The bits of a cell that lie next to the cell (dy, dx) away."""
    rows = range(CELL) if dy == 0 else [0 if dy < 0 else CELL - 1]
    cols = range(CELL) if dx == 0 else [0 if dx < 0 else CELL - 1]
    return _signed(sum(1 << (CELL * r + c) for r in rows for c in cols))


def with_rims(cells, own=None):
    """Every cell of `own` (default: `cells` itself) with its bits there (`own`) and the 3 x 3 boards b0 .. b8 of `cells` around it.

    A cell is sent to a neighbour only where it has pixels on their common border, so a cell of a thin line is some three rows.
    """
    sent = F.array(*[F.struct((F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx"), F.lit(8 - k).alias("slot"),
                              F.col("bits").bitwiseAND(_rim(dy, dx)).alias("bits")) for k, (dy, dx) in enumerate(OFFSETS)])
    rows = cells.select("image_id", F.explode(sent).alias("s")).select("image_id", "s.*").filter("bits <> 0")
    if own is not None:
        rows = rows.unionByName(own.select("image_id", "cy", "cx", F.lit(9).alias("slot"), "bits"))
    mine = 9 if own is not None else CENTRE
    pick = lambda k: F.coalesce(F.bit_or(F.when(F.col("slot") == k, F.col("bits"))), F.lit(0).cast("long"))
    # not combined before the shuffle, where a row would carry all ten boards for the one it has
    return (
        spread(rows, "image_id", "cy", "cx").groupBy("image_id", "cy", "cx").agg(*[pick(k).alias(f"b{k}") for k in range(9)], pick(mine).alias("own"))
        .filter("own <> 0")
    )


def unpack(rimmed):
    """(image_id, y, x, near) of the pixels of `own`; `near` has a bit for each pixel of the 3 x 3 around, in the order of OFFSETS."""
    k = rimmed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter(
        _shifted("shiftright", F.col("own"), F.col("_k")).bitwiseAND(F.lit(1).cast("long")) == 1)
    k = k.withColumn("_r", F.shiftright("_k", SHIFT)).withColumn("_c", F.col("_k").bitwiseAND(F.lit(CELL - 1)))

    def three(dr):
        r = F.col("_r") + dr
        part = r.bitwiseAND(F.lit(CELL - 1)) * CELL
        outside = {-1: r < 0, 0: F.lit(False), 1: r > CELL - 1}[dr]
        board = lambda col: F.when(outside, F.col(f"b{3 * (dr + 1) + col}")).otherwise(F.col(f"b{3 + col}"))
        one = F.lit(1).cast("long")
        ten = (
            _shifted("shiftright", board(0), part + CELL - 1).bitwiseAND(one)
            .bitwiseOR(F.shiftleft(_shifted("shiftright", board(1), part).bitwiseAND(F.lit(255).cast("long")), 1))
            .bitwiseOR(F.shiftleft(_shifted("shiftright", board(2), part).bitwiseAND(one), 9))
        )
        return _shifted("shiftright", ten, F.col("_c")).bitwiseAND(F.lit(7).cast("long"))

    near = three(-1).bitwiseOR(F.shiftleft(three(0), 3)).bitwiseOR(F.shiftleft(three(1), 6))
    return k.select("image_id", (F.col("cy") * CELL + F.col("_r")).cast("int").alias("y"),
                    (F.col("cx") * CELL + F.col("_c")).cast("int").alias("x"), near.cast("int").alias("near"))


# ---- boards in tiles --------------------------------------------------------

def cell_y(cell):
    return F.shiftright(cell, 32)


def cell_x(cell):
    return F.shiftright(F.shiftleft(cell, 32), 32)


def tiles_of(cells, reach, tile=TILE):
    """Each board in every tile (ty, tx) it lies in or within `reach` pixels of."""
    for axis, c in (("ty", cell_y), ("tx", cell_x)):
        first = idiv(c(F.col("cell")) * CELL - reach, tile)
        cells = cells.withColumn(axis, F.explode(F.sequence(first, idiv(c(F.col("cell")) * CELL + (CELL - 1 + reach), tile))))
    return cells


def to_pixels(words):
    """An array of boards as the array of their pixels, 0 or 1."""
    h, w = words.shape
    bits = np.unpackbits(words.astype("<i8").view(np.uint8).reshape(h, w, 8), axis=2, bitorder="little")
    return bits.reshape(h, w, CELL, CELL).transpose(0, 2, 1, 3).reshape(h * CELL, w * CELL)


def to_words(pixels):
    h, w = pixels.shape[0] // CELL, pixels.shape[1] // CELL
    bits = pixels.reshape(h, CELL, w, CELL).transpose(0, 2, 1, 3).reshape(h, w, CELL * CELL)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little")).view("<i8").reshape(h, w)


def word_array(cell, bits, box):
    """Boards as an array over the cells (y0, x0, y1, x1), ends included; others are left out."""
    y0, x0, y1, x1 = box
    words = np.zeros((y1 - y0 + 1, x1 - x0 + 1), np.int64)
    y, x = (cell >> 32) - y0, cell.astype(np.int32).astype(np.int64) - x0
    inside = (y >= 0) & (x >= 0) & (y < words.shape[0]) & (x < words.shape[1])
    np.bitwise_or.at(words, (y[inside], x[inside]), bits[inside])
    return words


def tile_box(cell, ty, tx, reach, tile=TILE):
    """The cells (y0, x0, y1, x1) from the first to the last set one within `reach` pixels of a tile."""
    lo, hi = [], []
    for t, c in ((ty, cell >> 32), (tx, cell.astype(np.int32).astype(np.int64))):
        first, last = (t * tile - reach) >> SHIFT, (t * tile + tile - 1 + reach) >> SHIFT
        lo.append(max(first, int(c.min()) if len(c) else first))
        hi.append(max(lo[-1], min(last, int(c.max()) if len(c) else first)))
    return *lo, *hi


def tile_pixels(cell, bits, ty, tx, reach, tile=TILE, box=None):
    """The pixels of a tile and those within `reach` around it, as far as any are set (or in `box`): (array, y0, x0)."""
    box = box or tile_box(cell, ty, tx, reach, tile)
    return to_pixels(word_array(cell, bits, box)), box[0] * CELL, box[1] * CELL


def core_of(y0, x0, ty, tx, tile=TILE):
    """Where the tile itself lies in an array that begins at (y0, x0)."""
    return tuple(slice(max(0, t * tile - at), max(0, t * tile - at + tile)) for t, at in ((ty, y0), (tx, x0)))


def tile_boards(pixels, y0, x0, ty, tx, tile=TILE):
    """Cells and boards of an array's pixels in the tile itself."""
    core = np.zeros_like(pixels, np.uint8)
    own = core_of(y0, x0, ty, tx, tile)
    core[own] = pixels[own]
    words = to_words(core)
    y, x = np.nonzero(words)
    return (y + y0 // CELL) << 32 | (x + x0 // CELL) & ((1 << 32) - 1), words[y, x]


WIDE_TILE = 1024  # few tiles, since each costs some milliseconds besides its pixels


def over_tiles(sets, reach, step, *, image=None, tile=WIDE_TILE):
    """(image_id, part, cell, bits): what `step` makes of the pixel sets of every tile, in one shuffle of boards.

    `step` gets an array per set (a tile and `reach` pixels around it, as far as any set has pixels), the array's first y and x and, with `image`, the
    image's (length_px, width_px), and returns arrays of the same shape, of which the tile itself is kept. With `image`, only
    images that have a row there are treated.
    """
    n, sized = len(sets), image is not None
    cells = [packed(s).withColumn("part", F.lit(k)) for k, s in enumerate(sets)]
    rows = cells[0]
    for more in cells[1:]:
        rows = rows.unionByName(more)
    rows = tiles_of(rows, reach, tile)
    if sized:
        size = tiles_of(cells[0], 0, tile).select("image_id", "ty", "tx").distinct().join(
            image.select("image_id", F.col("length_px").cast("long").alias("cell"), F.col("width_px").cast("long").alias("bits")), "image_id")
        rows = rows.unionByName(size.withColumn("part", F.lit(-1)))

    def one(pdf):
        part, cell, bits = (pdf[c].to_numpy() for c in ("part", "cell", "bits"))
        size = part < 0
        if sized and not size.any():
            return none
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        box = tile_box(cell[~size], ty, tx, reach, tile)
        arrays = [tile_pixels(cell[part == k], bits[part == k], ty, tx, reach, tile, box) for k in range(n)]
        y0, x0 = arrays[0][1:]
        made = step(*[a[0] for a in arrays], y0, x0, *([(int(cell[size][0]), int(bits[size][0]))] if sized else []))
        out = [tile_boards(m, y0, x0, ty, tx, tile) for m in made]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "part": np.repeat(np.arange(len(out)), [len(c) for c, _ in out]).astype("int32"),
                             "cell": np.concatenate([c for c, _ in out]), "bits": np.concatenate([b for _, b in out])})

    none = pd.DataFrame({"image_id": np.zeros(0, int), "part": np.zeros(0, "int32"), "cell": np.zeros(0, int), "bits": np.zeros(0, int)})
    return rows.groupBy("image_id", "ty", "tx").applyInPandas(one, "image_id long, part int, cell long, bits long")
