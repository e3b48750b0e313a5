"""Product codes of vectors, their codebooks learned exactly by k-means over metric trees.

Components become integers, vectors are cut into equal parts, and every part position has a codebook of a few entries. All
distances, sums and means are whole numbers, so the result does not depend on how the rows are split over tasks.

1. Trees. Every block of rows gets one tree per part by the anchors hierarchy, middle-out: about sqrt(n) anchors, each the
   point furthest from all before it and taking over the points nearer to it (points closer to their anchor than half way
   to the new one are not looked at); the anchors are merged upwards, the pair with the smallest common ball first, and each
   anchor's points are divided downwards in the same way. A ball caches its radius, sum and count. The blocks are written
   once to the shared folder and read by every round; their size is fixed, so no group of rows meets in one task.
2. Rounds. From the root, a ball inherits its parent's list of entries that may still own one of its points. The entry
   nearest to the centre rules out every entry that is farther for the whole ball; when one is left, the ball is owned and
   its cached sum counts. Points of leaves that stay undivided are compared one by one with the entries left. Each task
   returns one sum per entry; the driver sees parts * entries rows a round.
3. Codes. The same walk assigns every point; errors are added up per label.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter than the
longest, and lengths that `parts` does not divide, are filled up with zeros. Null ids are kept but never start an entry; a
repeated id starts one entry, from its least vector. With fewer ids than entries there are fewer entries. Repeated rows
stay. Null labels are one label. An empty table gives no rows. Components of 2^17 and more would overflow the whole numbers
and raise ValueError. Other columns are left out, whatever their names.
"""

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ramify.functions.patterns import salted_join
from ramify.llm.common import arrow_batches, cut, drop_cut, scratch_path, tidy

SCALE = 4096
LARGEST = 1 << 17
BLOCK = 4096
LEAF = 24
ROW_GROUP = 16 << 20
SMALL_LABELS = 50_000


# ---- trees of one block ------------------------------------------------------

def _anchors(x):
    """Owner of every point among about sqrt(n) anchors, and the anchors' pivots."""
    want = int(np.ceil(np.sqrt(len(x))))
    pivots, owner = [0], np.zeros(len(x), np.int64)
    dist = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(pivots) < want:
        new = int(dist.argmax())
        if dist[new] == 0:
            break
        apart = np.sqrt(((x[pivots] - x[new]) ** 2).sum(1))
        near = np.flatnonzero(2 * dist > apart[owner])
        d = np.sqrt(((x[near] - x[new]) ** 2).sum(1))
        won = d < dist[near]
        owner[near[won]], dist[near[won]] = len(pivots), d[won]
        pivots.append(new)
    return owner, dist, x[pivots]


def _merged(centre, radius):
    """Order of merges: pairs (a, b) of balls, numbered on from the given ones, always the smallest common ball."""
    k = len(centre)
    c, r = np.concatenate([centre, np.zeros((k - 1, centre.shape[1]))]), np.concatenate([radius, np.zeros(k - 1)])
    common = np.full((2 * k - 1, 2 * k - 1), np.inf)

    def fill(i, others):
        d = np.sqrt(((c[others] - c[i]) ** 2).sum(1))
        common[i, others] = common[others, i] = np.maximum((d + r[others] + r[i]) / 2, np.maximum(r[others], r[i]))

    live = list(range(k))
    for i in range(1, k):
        fill(i, np.arange(i))
    for new in range(k, 2 * k - 1):
        a, b = divmod(int(common[:new, :new].argmin()), new)
        yield a, b
        d = np.sqrt(((c[a] - c[b]) ** 2).sum())
        r[new] = common[a, b]
        to_b = 0.0 if d == 0 else float(np.clip((r[new] - r[a]) / d, 0, 1))  # a's far side touches the common ball
        c[new] = c[a] + (c[b] - c[a]) * to_b
        common[[a, b]] = common[:, [a, b]] = np.inf
        live = [i for i in live if i not in (a, b)]
        if live:
            fill(new, np.array(live))
        live.append(new)


def build_tree(points, leaf=LEAF):
    """Tree over the rows of `points`: their order, and per ball left, right (-1: leaf), start, end, sum and radius; the root is last."""
    x = points.astype(np.float64)
    order, left, right, start, end = [], [], [], [], []
    at = 0

    def ball(a, b, s, e):
        left.append(a)
        right.append(b)
        start.append(s)
        end.append(e)
        return len(left) - 1

    def divide(rows):
        nonlocal at
        if len(rows) > leaf:
            owner, dist, pivots = _anchors(x[rows])
            if len(pivots) > 1:
                radius = np.zeros(len(pivots))
                np.maximum.at(radius, owner, dist)
                pairs = list(_merged(pivots, radius))
                members = np.split(rows[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner))[:-1])

                def place(i):  # children stand next to each other, so every ball is one range of the order
                    if i < len(pivots):
                        return divide(members[i])
                    a, b = pairs[i - len(pivots)]
                    s = at
                    one, two = place(a), place(b)
                    return ball(one, two, s, at)

                return place(2 * len(pivots) - 2)
        order.append(rows)
        s, at = at, at + len(rows)
        return ball(-1, -1, s, at)

    divide(np.arange(len(x)))
    order, start, end = np.concatenate(order), np.array(start), np.array(end)
    x = x[order]
    run = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0, dtype=np.int64)])
    total = run[end] - run[start]
    centre = total / (end - start)[:, None]
    radius = np.array([np.sqrt(((x[s:e] - c) ** 2).sum(1).max()) for s, e, c in zip(start, end, centre)])
    return {"order": order.astype(np.int32), "points": points[order], "left": np.array(left, np.int32), "right": np.array(right, np.int32),
            "start": start.astype(np.int32), "end": end.astype(np.int32), "sum": total, "radius": radius}


def walk(tree, entries):
    """Which entry owns what: (balls, their entries) owned as a whole, and (points, their entries) of undivided leaves.

    Points are numbered in the tree's order. Ties go to the lower entry; of equal entries only the first owns anything.
    """
    e = entries.astype(np.float64)
    width = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    first = np.array([not (entries[:j] == entries[j]).all(1).any() for j in range(len(entries))])
    ball, may = np.array([len(tree["left"]) - 1]), first[None]
    balls, owners, points, chosen = [], [], [], []
    while len(ball):
        size = (tree["end"] - tree["start"])[ball]
        centre = tree["sum"][ball] / size[:, None]
        d = ((centre[:, None] - e[None]) ** 2).sum(2)
        best = np.where(may, d, np.inf).argmin(1)
        least = d[np.arange(len(ball)), best]
        # d(x, j) - d(x, best) over the ball is at least this; the last term covers rounding
        slack = d - least[:, None] - 2 * tree["radius"][ball][:, None] * width[best] - 1e-9 * (d + least[:, None] + 1)
        may = may & (slack <= 0)
        may[np.arange(len(ball)), best] = True
        whole = may.sum(1) == 1
        balls.append(ball[whole])
        owners.append(best[whole])
        leaf = ~whole & (tree["left"][ball] < 0)
        if leaf.any():
            n = size[leaf]
            which = np.repeat(tree["start"][ball[leaf]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            x = tree["points"][which].astype(np.int64)
            exact = ((x[:, None] - entries[None]) ** 2).sum(2)
            exact[~np.repeat(may[leaf], n, axis=0)] = np.iinfo(np.int64).max
            points.append(which)
            chosen.append(exact.argmin(1))
        inner = ~whole & ~leaf
        ball, may = np.concatenate([tree["left"][ball[inner]], tree["right"][ball[inner]]]), np.concatenate([may[inner]] * 2)
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(part or empty) for part in (balls, owners, points, chosen))


def entry_sums(tree, entries):
    """Sum and count of the points every entry owns, mostly from the balls' cached ones."""
    ball, owner, point, choice = walk(tree, entries)
    total = np.zeros(entries.shape, np.int64)
    np.add.at(total, owner, tree["sum"][ball])
    np.add.at(total, choice, tree["points"][point].astype(np.int64))
    n = np.zeros(len(entries), np.int64)
    np.add.at(n, owner, (tree["end"] - tree["start"])[ball])
    np.add.at(n, choice, 1)
    return total, n


def assign(tree, entries):
    """Entry and squared distance of every row, in the order the tree was built from."""
    ball, owner, point, choice = walk(tree, entries)
    code = np.zeros(len(tree["order"]), np.int64)
    size = (tree["end"] - tree["start"])[ball]
    code[np.repeat(tree["start"][ball] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(owner, size)
    code[point] = choice
    error = ((tree["points"].astype(np.int64) - entries[code]) ** 2).sum(1)
    out = np.empty((2, len(code)), np.int64)
    out[:, tree["order"]] = code, error
    return out


# ---- blocks as rows of a table -------------------------------------------------

def _whole_numbers(column, width, scale):
    """Lists of numbers as rows of `width` whole numbers, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int32)
    out = np.zeros((len(column), width), np.int32)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _blocks(kept, width, parts, block, scale):
    """One row per block of rows: ids, labels, and the trees of all parts."""
    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = _whole_numbers(part.column(2), width, scale)
                held = io.BytesIO()
                np.savez(held, **{f"{k}{name}": a for k, points in enumerate(np.split(x, parts, axis=1))
                                  for name, a in build_tree(points).items()})
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()),
                                                  c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
                         for c in (part.column(0), part.column(1))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([held.getvalue()], pa.binary())], names=["vec_id", "label", "trees"])

    kinds = [kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    made = kept.mapInArrow(tidy(scan), f"vec_id array<{kinds[0]}>, label array<{kinds[1]}>, trees binary")
    path = scratch_path(kept.sparkSession, "trees")
    made.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    out = kept.sparkSession.read.schema(made.schema).parquet(path)
    out._cut_path = path
    return out


def _trees(packed, parts):
    held = np.load(io.BytesIO(packed))
    names = ("order", "points", "left", "right", "start", "end", "sum", "radius")
    return [{name: held[f"{k}{name}"] for name in names} for k in range(parts)]


def _round(blocks, books):
    """Codebooks after one round: every entry the floored mean of its points; unused entries stay."""
    parts, width = len(books), books[0].shape[1]
    sent = blocks.sparkSession.sparkContext.broadcast(books)  # parts * entries * width numbers
    axes = [f"s{i}" for i in range(width)]

    def scan(batches):
        total = [np.zeros((len(b), width + 1), np.int64) for b in sent.value]
        for batch in batches:
            for packed in batch.column(0):
                for t, tree, entries in zip(total, _trees(packed.as_py(), parts), sent.value):
                    sums, n = entry_sums(tree, entries)
                    t[:, :width] += sums
                    t[:, width] += n
        for k, t in enumerate(total):
            which = np.arange(len(t), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), k, np.int32)), pa.array(which), *map(pa.array, t.T.copy())],
                                             names=["part", "entry", *axes, "n"])

    found = (blocks.select("trees").mapInArrow(tidy(scan), "part int, entry int, " + "".join(f"{a} long, " for a in axes) + "n long")
             .groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in (*axes, "n")]).filter("n > 0"))
    after = [b.copy() for b in books]
    for r in found.collect():  # at most parts * entries rows
        after[r["part"]][r["entry"]] = [r[a] // r["n"] for a in axes]
    sent.unpersist()
    return after


def _coded(blocks, books, kinds):
    parts, sent = len(books), blocks.sparkSession.sparkContext.broadcast(books)

    def scan(batches):
        for batch in batches:
            for ids, labels, packed in zip(batch.column(0), batch.column(1), batch.column(2)):
                found = np.array([assign(tree, e) for tree, e in zip(_trees(packed.as_py(), parts), sent.value)])
                codes = [row.tobytes().hex() for row in found[:, 0].T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes, pa.string()), pa.array(found[:, 1].sum(0))],
                                                 names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(tidy(scan), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


# ---- the operator ---------------------------------------------------------------

def usable(vector):
    """Condition: not null, no null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def start_books(kept, width, parts, entries, scale):
    """Per part, that part of the vectors of the smallest ids. At most `entries` rows are read back."""
    ids = [r[0] for r in kept.select("vec_id").filter("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries).collect()]
    rows = kept.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    x = np.zeros((len(rows), width), np.int64)
    for row, r in zip(x, rows):
        row[:len(r["vector"])] = np.floor(scale * np.array(r["vector"], np.float64))
    return np.split(x, parts, axis=1)


def books_digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(df, vector="embedding", vec_id="vec_id", label="label", parts=8, entries=16, rounds=6, scale=SCALE, block=BLOCK):
    """(vec_id, label, code, error, label_error) of every kept row, and the final codebooks (one array per part)."""
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark = df.sparkSession
    kept = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(usable("vector"))
    kinds = [kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    seen = kept.agg(F.max(F.size("vector")).alias("width"),
                    F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))).alias("top")).first()
    if seen["width"] is None:
        return spark.createDataFrame([], f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long, label_error long"), []
    if seen["top"] >= LARGEST * SCALE / scale:
        raise ValueError(f"a component of {seen['top']} is too large for whole numbers of 64 bits")
    width = -(-max(seen["width"], 1) // parts) * parts
    books = start_books(kept, width, parts, entries, scale)
    if not len(books[0]):
        books = [np.zeros((1, width // parts), np.int64)] * parts  # no id at all: one entry at the origin
    blocks = _blocks(kept, width, parts, block, scale)
    with arrow_batches(spark, 1):  # a row is a whole block
        for _ in range(rounds):
            books = _round(blocks, books)
        coded = cut(_coded(blocks, books, kinds))
    drop_cut(blocks)
    return _with_label_errors(coded), books


def _with_label_errors(coded):
    keyed = coded.withColumn("_l", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("_n", F.col("label").isNull())
    sums = cut(keyed.groupBy("_l", "_n").agg(F.sum("error").alias("label_error")))
    if sums.count() <= SMALL_LABELS:
        out = keyed.join(F.broadcast(sums), ["_l", "_n"])  # counted: at most SMALL_LABELS rows
    else:
        out = salted_join(keyed, sums, ["_l", "_n"], F.struct("vec_id", "code", "error"))
    return out.drop("_l", "_n").select("vec_id", "label", "code", "error", "label_error")
