"""Nearest neighbours along several shifted space-filling curves.

1. Classes. Equal vectors become one class with its k + 1 smallest ids, which is all that any answer can hold of it; the
   rows of a class are cut to that number before they are shuffled, so a vector that fills a third of the table is one row.
2. Fit. From SAMPLE classes of least hash come, per curve, random orthonormal directions, the cut points that turn each
   projection into a rank, and BINS cut points of the curve. Every curve shifts the grid by its own random offset.
3. Curves. Every class stands on every curve at the Hilbert key of its ranks, below it a few bits of hash. The curves are
   range-partitioned in blocks of bins; a query goes to the blocks its window touches, and a block is read in curve order,
   a few thousand classes at a time, against the queries whose windows reach them.
4. Merge. The windows' best k + 1 classes of all curves meet per query; distances are exact in them, so merging reranks.

The width of the windows is measured, not set: PROBES sampled vectors are compared with every class, and the windows, the
same number of bins for all queries, are the least that hold `recall` of the probes' true neighbours on at least one curve.
Where vectors have structure that is a few bins; where they have none (random directions in 64 dimensions) it is a good
part of the curve, and the search costs about as much as comparing all pairs in blocks.

Only the fit, bounded by SAMPLE and PROBES, reaches the driver. Queries run in groups of QUERY_GROUP distinct vectors, which
bounds what a task holds. Equal queries are searched once.

Defined cases: rows with a null id, and vectors that are null, zero, of another length than the commonest (ties: the
shorter) or hold null or non-finite components, take no part. A row is a candidate for every query but itself; rows that
repeat an id or a vector are candidates of their own. Equal distances go to the smaller id. With fewer candidates than k all
are returned. An empty table gives no rows. Other columns are left out, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.functions.patterns import salted_join
from ramify.llm.common import cut, tidy
from ramify.llm.vector_codes import usable

CURVES, DIMS, BITS, TIE_BITS = 4, 6, 9, 9  # DIMS * BITS + TIE_BITS = 63
SAMPLE, BINS, PROBES = 16_384, 512, 128
BLOCK_ROWS = 65_536
QUERY_GROUP = 65_536
CHUNK = 2048


# ---- curves --------------------------------------------------------------------

def hilbert(cells, bits):
    """Hilbert index of points (rows) with coordinates of `bits` bits.

    Per level, the half-spaces a point lies in name its sub-cube in Gray code order; the rotation and reflection of that
    sub-cube's own curve are carried as a first axis and a mask.
    """
    n = cells.shape[1]
    index, flip, axis = (np.zeros(len(cells), np.int64) for _ in range(3))
    full = (1 << n) - 1
    turn = lambda x, by: ((x << by) | (x >> (n - by))) & full
    for level in range(bits - 1, -1, -1):
        corner = np.zeros(len(cells), np.int64)
        for a in range(n):
            corner |= ((cells[:, a] >> level) & 1) << a
        corner = turn(corner ^ flip, (n - axis - 1) % n)
        step = corner.copy()
        for by in (1, 2, 4, 8, 16):
            step ^= step >> by
        index = (index << n) | step
        before = (step - 1) & ~1
        entry = np.where(step == 0, 0, before ^ (before >> 1))
        odd = np.where(step == 0, 0, np.where(step & 1, step, step - 1))
        ones = np.zeros(len(cells), np.int64)
        run = odd.copy()
        for _ in range(n):  # trailing ones
            ones += run & 1
            run = np.where(run & 1, run >> 1, 0)
        flip ^= turn(entry, (axis + 1) % n)
        axis = (axis + ones % n + 1) % n
    return index


class Curves:
    """Directions, cut points and shifts of all curves."""

    def __init__(self, sample, hashes, curves=CURVES, bins=BINS, seed=17):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.directions, self.steps, self.shifts = [], [], []
        levels = 1 << (BITS - 1)
        for _ in range(curves):
            d = np.linalg.qr(rng.normal(size=(max(width, DIMS), DIMS)))[0][:width]
            self.directions.append(d)
            self.steps.append(np.quantile(sample @ d, np.arange(1, levels) / levels, axis=0))
            self.shifts.append(rng.integers(0, levels, DIMS))
        self.bins = bins
        cuts = np.sort(self.places(sample, hashes), axis=1)
        self.cuts = cuts[:, np.arange(1, bins) * cuts.shape[1] // bins]

    def places(self, x, hashes):
        """Position of every vector on every curve (curves x rows)."""
        tie = (hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        out = []
        for d, steps, shift in zip(self.directions, self.steps, self.shifts):
            y = x @ d
            cells = np.stack([np.searchsorted(steps[:, a], y[:, a]) for a in range(DIMS)], axis=1) + shift
            out.append(hilbert(cells, BITS) << TIE_BITS | tie)
        return np.array(out)

    def bin_of(self, places):
        return np.stack([np.searchsorted(c, p, "right") for c, p in zip(self.cuts, places)])

    def windows(self, places, reach):
        """First and last bin, lowest and highest position of each vector's window."""
        at = self.bin_of(places)
        lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach, self.bins - 1)
        edges = np.concatenate([np.full((len(self.cuts), 1), -1), self.cuts, np.full((len(self.cuts), 1), np.iinfo(np.int64).max)], axis=1)
        curve = np.arange(len(self.cuts))[:, None]
        return lo, hi, edges[curve, lo], edges[curve, hi + 1]


# ---- vectors in batches ----------------------------------------------------------

def _matrix(column, width):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def _packed(x):
    """Rows of a matrix as one binary column."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    ends = pa.array(np.arange(len(x) + 1) * size, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(x.tobytes())])


def _unpacked(column, kind, width):
    return np.array([np.frombuffer(v.as_buffer(), kind) for v in column]).reshape(len(column), width)


def _squares(q, x):
    """Squared distances by a product of matrices, good to about 1e-15 of the squared lengths."""
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0)


class Best:
    """The least `keep` (distance, smallest id, class) of every query so far."""

    def __init__(self, queries, keep):
        self.q, self.keep = queries.astype(np.float64), keep
        self.length = (self.q * self.q).sum(1)
        self.bound = np.full(len(queries), np.inf)
        self.rows = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
        self.fresh = []
        self.waiting = 0

    def add(self, which, x, first, cls, ids):
        """Compare the queries `which` with the classes x."""
        x = x.astype(np.float64)
        longest = (x * x).sum(1).max()
        for at in range(0, len(which), 1024):
            some = which[at:at + 1024]
            d = _squares(self.q[some], x)
            near = self.bound[some]
            if d.shape[1] > self.keep:
                near = np.minimum(near, np.partition(d, self.keep - 1, axis=1)[:, self.keep - 1])
            blur = 1e-12 * (self.length[some] + longest)
            near = near + blur
            self.bound[some] = np.minimum(self.bound[some], near)
            row, col = np.nonzero(d <= (near + blur)[:, None])
            exact = np.sqrt(((self.q[some[row]] - x[col]) ** 2).sum(1))
            self.fresh.append((some[row], exact, first[col], cls[col], ids[col]))
            self.waiting += len(row)
        if self.waiting > 4 * self.keep * len(self.q) + 100_000:
            self.settle()

    def settle(self):
        q, d, first, cls, ids = (np.concatenate([a, *b]) for a, b in zip(self.rows, zip(*self.fresh))) if self.fresh else self.rows
        order = np.lexsort((cls, first, d, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[rank < self.keep]
        self.rows = [q[rank < self.keep], d[order], first[order], cls[order], ids[order]]
        self.fresh, self.waiting = [], 0
        return self.rows


# ---- the operator -------------------------------------------------------------

def classes_of(kept, keep):
    """Distinct vectors: cls, h, vector and their `keep` smallest ids."""
    same = W.partitionBy("h", "vector").orderBy("vec_id")
    few = kept.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= keep)
    grouped = few.groupBy("h", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return cut(grouped.withColumn("cls", F.monotonically_increasing_id()))


def _sampled(classes, n, size, width):
    """At most `size` classes of least hash: vectors and hashes."""
    share = min(1.0, 2 * size / max(n, 1))
    near = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30))
    rows = classes.filter(near < int(share * (1 << 30))).orderBy(near, "h", "cls").limit(size).select("h", "vector").toArrow()
    return _matrix(rows.column(1).combine_chunks(), width).astype(np.float64), rows.column(0).to_numpy()


def _probe_reach(classes, model, probes, probe_hashes, k, width, recall):
    """Bins to both sides that hold `recall` of the probes' k nearest classes, found by comparing them with every class."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast((model, probes))

    def scan(batches):
        curves, q = sent.value
        best = Best(q, k + 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                x, h = _matrix(part.column(1), width).astype(np.float64), part.column(0).to_numpy()
                nothing, places = np.zeros(len(x), np.int64), np.empty(len(x), object)
                places[:] = list(zip(*curves.places(x, h).tolist()))
                best.add(np.arange(len(q)), x, nothing, nothing, places)
        who, dist, _, _, places = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(dist), pa.array([list(p) for p in places], pa.list_(pa.int64()))],
                                         names=["probe", "d", "places"])

    near = classes.select("h", "vector").mapInArrow(tidy(scan), "probe long, d double, places array<long>")
    order = W.partitionBy("probe").orderBy("d", "places")
    rows = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).filter("d > 0").collect()
    sent.unpersist()  # at most PROBES * (k + 1) rows came back
    if not rows:
        return model.bins
    own = model.bin_of(model.places(probes, probe_hashes))
    found = model.bin_of(np.array([r["places"] for r in rows]).T)
    away = np.abs(found - own[:, [r["probe"] for r in rows]]).min(0)
    return int(np.quantile(away, recall, method="higher"))


def _on_curves(df, model, blocks, width, reach=None):
    """Every class (or, with `reach`, every query with the blocks of its window) on every curve."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        curves = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                raw = _matrix(part.column(1), width)
                places = curves.places(raw.astype(np.float64), part.column(0).to_numpy())
                low = high = places
                if reach is None:
                    first = last = curves.bin_of(places) * blocks // curves.bins
                else:
                    first, last, low, high = curves.windows(places, reach)
                    first, last = first * blocks // curves.bins, last * blocks // curves.bins
                for c in range(len(places)):
                    n = last[c] - first[c] + 1
                    row = np.repeat(np.arange(len(raw)), n)
                    block = first[c][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), c, np.int32)), pa.array(block.astype(np.int32)),
                         pa.array(np.full(len(row), reach is None)), pa.array(low[c][row]), pa.array(high[c][row]),
                         part.column(2).take(pa.array(row)), part.column(3).take(pa.array(row)), _packed(raw[row])],
                        names=["curve", "block", "is_row", "low", "high", "id", "ids", "vector"])

    return df.mapInArrow(tidy(scan), "curve int, block int, is_row boolean, low long, high long, id long, ids array<long>, vector binary")


def _search_blocks(queries, rows, partitions, keep, kind, width):
    """Best `keep` classes of every query in every block of its windows: qid, d, first, cls, ids."""
    key = ["curve", "block"]
    dealt = queries.union(rows).repartitionByRange(partitions, *key).sortWithinPartitions(*key, "is_row", "low")

    def done(best, qid):
        if best is not None:
            q, d, first, cls, ids = best.settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid[q]), pa.array(d), pa.array(first), pa.array(cls), pa.array(list(ids), pa.list_(pa.int64()))],
                names=["qid", "d", "first", "cls", "ids"])

    def scan(batches):
        here, held, best, qid, low, high = None, [], None, None, None, None
        for batch in batches:
            curve, block, is_row = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            new = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if (curve[a], block[a]) != here:
                    yield from done(best, qid)
                    here, held, best = (curve[a], block[a]), [], None
                part = batch.slice(a, b - a)
                if not is_row[a]:
                    held.append((part.column(5).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(),
                                 _unpacked(part.column(7), kind, width)))
                    continue
                if best is None:
                    if not held:
                        continue
                    qid, low, high, q = (np.concatenate(c) for c in zip(*held))
                    best, held = Best(q, keep), []
                for at in range(0, part.num_rows, CHUNK):
                    some = part.slice(at, CHUNK)
                    place = some.column(3).to_numpy()
                    which = np.flatnonzero((low <= place[-1]) & (high >= place[0]))
                    if len(which):
                        ids = np.empty(some.num_rows, object)
                        ids[:] = some.column(6).to_pylist()
                        first = np.array([i[0] for i in ids], np.int64)
                        best.add(which, _unpacked(some.column(7), kind, width), first, some.column(5).to_numpy(), ids)
        yield from done(best, qid)

    return dealt.mapInArrow(tidy(scan), "qid long, d double, first long, cls long, ids array<long>")


def nearest(df, is_query, k=10, vector="embedding", vec_id="vec_id", curves=CURVES, recall=0.96, bins=BINS, sample=SAMPLE,
            probes=PROBES, block_rows=BLOCK_ROWS, query_group=QUERY_GROUP):
    """(query_id, rank, vec_id, score) of the k nearest other rows of every row for which `is_query` (a condition on vec_id) holds."""
    spark = df.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kept = (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
        .filter(F.col("vec_id").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0))
    )
    size = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return none
    width = size["n"]
    kind = np.float64 if "double" in kept.schema["vector"].dataType.simpleString() else np.float32
    plain = "array<double>" if kind is np.float64 else "array<float>"
    kept = kept.filter(F.size("vector") == width).withColumn("vector", F.col("vector").cast(plain)).withColumn("h", F.xxhash64("vector"))

    asked = kept.filter(is_query).select(F.col("vec_id").alias("query_id"), "h", "vector")
    query = cut(asked.select("h", "vector").distinct().withColumn("qid", F.monotonically_increasing_id()))
    classes = classes_of(kept, k + 1)
    n, n_query = classes.count(), query.count()
    if not n_query:
        return none

    x, hashes = _sampled(classes, n, sample, width)
    model = Curves(x, hashes, curves, max(1, min(bins, len(x) // 2)))
    reach = _probe_reach(classes, model, x[:probes], hashes[:probes], k, width, recall)
    blocks = max(1, min(model.bins, -(-n // block_rows)))
    rows = _on_curves(classes.select("h", "vector", "cls", "ids"), model, blocks, width)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), curves * blocks)
    groups = -(-n_query // query_group)
    found = None
    for g in range(groups):
        some = query.filter(F.pmod(F.xxhash64("qid", F.lit(5)), F.lit(groups)) == g) if groups > 1 else query
        some = some.select("h", "vector", F.col("qid").alias("id"), F.array(F.lit(0).cast("long")).alias("ids"))
        part = _search_blocks(_on_curves(some, model, blocks, width, reach), rows, partitions, k + 1, kind, width)
        order = W.partitionBy("qid").orderBy("d", "first", "cls")  # a class found on several curves has one rank
        part = part.withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= k + 1).dropDuplicates(["qid", "cls"])
        each = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("score"), i.alias("vec_id")))))
        part = cut(part.groupBy("qid").agg(F.slice(F.array_sort(each), 1, k + 1).alias("near")))
        found = part if found is None else found.union(part)

    answers = query.join(found, "qid").select("h", "vector", "near")
    joined = salted_join(asked, answers, ["h", "vector"], "query_id").drop("h", "vector")
    own = F.array_position(F.transform("near", lambda e: e["vec_id"]), F.col("query_id"))
    others = F.filter("near", lambda e, i: i + 1 != own)
    return (
        joined.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("_i", "_e"))
        .select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), F.col("_e.vec_id").alias("vec_id"), F.col("_e.score").alias("score"))
    )
