"""Helpers of the text operators: tables, bounded samples, words and shingles as NumPy arrays."""

import contextlib
import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ramify.functions.patterns import cut, drop_cut, scratch_path  # noqa: F401

GOLD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 1 << 20


def kept(name, key, build):
    """build(), kept per process under `name` while `key` stays the same.

    The package's functions travel to executors with the globals they use, so such state must not be a global.
    """
    store = sys.modules.setdefault("_ramify_kept", types.ModuleType("_ramify_kept")).__dict__
    if name not in store or store[name][0] != key:
        store[name] = (key, build())
    return store[name][1]


def release():
    """Give memory that a finished task no longer uses back to the machine, for whatever the executor runs next."""
    store = sys.modules.get("_ramify_kept")
    for name in [n for n in vars(store) if n.startswith("powers")] if store else ():
        vars(store).pop(name)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(func):
    """A task function for mapInArrow that releases memory at its end."""
    def run(batches):
        try:
            yield from func(batches)
        finally:
            release()
    return run


# ---- tables ----------------------------------------------------------------

def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(n, doc_id="doc_id"):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def lower_ascii(col):
    """Lower-case A-Z only. Pure ASCII text, which is most of it, takes the built-in `lower`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def labelled_sample(documents, labels, label, classes, learn, per_class, seed=5):
    """Texts and labels of the rows to learn from, and the number of such labels per class.

    At most `per_class` ids of each class are chosen, those with the least hashes, from the narrow label table
    alone; only their texts are read and sent. `learn` is the condition on doc_id. An id with several labels
    counts as its largest. Null and empty texts are left out; repeated ids fall under the same total bound.
    """
    usable = (
        labels.select("doc_id", F.col(label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(*classes)).filter(learn)
        .groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    )
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().toLocalIterator()}
    chosen = None
    for c in classes:
        part = usable.filter(F.col("label") == c).orderBy("_h", "doc_id").limit(per_class).select("doc_id", "label")
        chosen = part if chosen is None else chosen.union(part)
    rows = (
        documents.select("doc_id", "text").filter(F.length("text") > 0)
        .join(F.broadcast(chosen), "doc_id")  # at most per_class * len(classes) ids
        .withColumn("_h", F.xxhash64("text", F.lit(seed)))
        .orderBy("_h", "doc_id", "text").limit(per_class * len(classes)).select("text", "label")
    )
    return [(r["text"], r["label"]) for r in rows.collect()], sizes


def cut_packed(df, label="packed"):
    """cut() for wide binary columns: zstandard files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def held_out(n, rem, doc_id="doc_id"):
    """True for ids never learned from: crc32 of the id modulo n is `rem`, or the id is null."""
    return F.coalesce(id_remainder(n, doc_id) == rem, F.lit(True))


def map_texts(df, func, schema, batch_rows=2000):
    """mapInArrow with batches of few rows, so that a batch of very long texts stays small."""
    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                yield func(batch.slice(at, batch_rows))
    return df.mapInArrow(tidy(parts), schema)


@contextlib.contextmanager
def arrow_batches(spark, rows):
    """Jobs run inside send `rows` rows at a time to Python, which bounds the buffers outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def logistic(x, y, weight, ridge=0.1, rounds=60):
    """Weighted logistic regression by Newton steps; returns the coefficients."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


# ---- bytes, words, shingles -------------------------------------------------

def text_buffer(column):
    """Bytes of a text column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_groups(offsets, limit=CHUNK_BYTES):
    """Consecutive row ranges of about `limit` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


def mix(x):
    """splitmix64's finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def _power(base, n):
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, made by doubling."""
    size = max(2 * CHUNK_BYTES, 1 << int(n).bit_length())

    def build():
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have
    return kept(f"powers of {base} to {size}", 0, build)[:n]


def words(raw, offsets):
    """Words of all rows: start and end in `raw`, 64-bit hash, and each row's first word (len rows + 1).

    A word is a run of bytes outside [\\x20\\x09-\\x0D]; a row's end also ends it. Hashes depend on the
    bytes as they are; pass lower-cased bytes for case-free words. Equal words have equal hashes.
    """
    n = len(raw)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # the running sums cover about one CHUNK of bytes at a time
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
        lo, hi = start[at], end[to - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LETTER[raw[lo:hi]] * _power(_R, hi - lo), out=sums[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        hashes[at:to] = mix((sums[e] - sums[s]) * _power(_RINV, hi - lo)[s] + (e - s).astype(np.uint64) * GOLD)
        at = to
    return start, end, hashes, np.searchsorted(start, offsets)


def prefixes(raw, start, end, length):
    """Words longer than `length` bytes: their indexes and the hashes of their first `length` bytes."""
    longer = np.flatnonzero(end - start > length)
    out = np.zeros(len(longer), np.uint64)
    for k in range(length):
        out += _LETTER[raw[start[longer] + k]] * np.uint64(pow(_R, k, 1 << 64))
    return longer, mix(out ^ np.uint64(length))


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD,
                                0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)]


def ngrams(hashes, n):
    """Hash of the n words from every position; the last n - 1 positions are missing."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] * _STEP[0]
    for k in range(1, n):
        out += (hashes[k:k + m] ^ (hashes[k:k + m] >> np.uint64(29))) * _STEP[k]
    return mix(out)


def shingle_sets(raw, offsets, n=5):
    """Per row, the sorted distinct hashes of its n-word shingles.

    A row with fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    _, _, h, first = words(raw, offsets)
    grams = ngrams(h, n)
    for r in range(len(first) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            yield ngrams(h[a:b], b - a) + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def lowered(raw):
    """The bytes with A-Z lower-cased."""
    return np.frombuffer(raw.tobytes().lower(), np.uint8)


def _case_pairs():
    """Lower-case forms of the two-byte UTF-8 signs, where those have two bytes as well."""
    t = np.arange(1 << 16, dtype=np.uint16)
    for cp in range(0x80, 0x800):
        a, b = chr(cp).encode(), chr(cp).lower().encode()
        if len(b) == 2:
            t[a[0] << 8 | a[1]] = b[0] << 8 | b[1]
    return t


def lowered_wide(raw):
    """The bytes with A-Z and two-byte capitals (Latin, Greek, Cyrillic, ...) lower-cased, length unchanged."""
    low = lowered(raw).copy()
    lead = np.flatnonzero((low >= 0xC2) & (low <= 0xDF))
    lead = lead[lead + 1 < len(low)]
    pair = kept("case pairs", 0, _case_pairs)[low[lead].astype(np.uint16) << np.uint16(8) | low[lead + 1]]
    low[lead], low[lead + 1] = pair >> np.uint16(8), pair & np.uint16(255)
    return low
