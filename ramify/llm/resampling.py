"""Resampling towards a target distribution by hashed n-gram features.

Every feature (a run of words) falls into one of `buckets` by the crc32 of its bytes. The share of a bucket in the target
texts over its share in the documents is its gain; a document's weight is the mean gain of its features, and weight plus
keyed Gumbel noise is its score. The highest scores are drawn, so documents are sampled without replacement.

Features are interned per chunk of text in an open-addressed NumPy table: the xxhash64 of a feature's bytes is its key,
linear probing finds its slot, and the bytes of slot owner and occurrence are compared, so colliding keys stay apart. A
slot stores bucket and count; the crc32 is taken once per slot, and occurrences gather their gains by slot number.

1. One pass over both tables: per task one count for each bucket, added up by Spark (at most `buckets` numbers come back).
2. A second pass over the documents with the table of gains (8 bytes a bucket, broadcast): weight of every document.
3. One range-partitioned sort of narrow rows numbers the documents; nothing but a count per range reaches the driver.

Defined cases: a null or empty text has no features and weight 0. A null id has a null score and is never drawn nor counted
among the documents to draw from. Repeated rows are documents of their own. Ties of score go to the smaller id, then to the
smaller weight. A text of any length is one row of one chunk. An empty table gives no rows; an empty target gives gains that
only its smoothing makes. Other columns are left out, whatever their names.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ramify.llm.common import cut, map_texts, row_groups, text_buffer, tidy

BUCKETS = 10_000
CHUNK = 4 << 20
ROWS_PER_RANGE = 200_000

_KEPT = np.zeros(256, bool)  # a-z, 0-9 and every byte of a sign beyond ASCII
_KEPT[0x30:0x3A] = _KEPT[0x61:0x7B] = _KEPT[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

# The five primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


# ---- words and features of a chunk -------------------------------------------

def normal_words(raw, offsets):
    """Lower-cased words of all rows, laid out with one space after each.

    Returns the new bytes (padded by 8), start and end of every word there, and each row's first word (rows + 1).
    """
    low = _FOLD[raw]
    inside = _KEPT[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[cuts] = inside[cuts]
    first = np.flatnonzero(begins)
    word = np.cumsum(begins, dtype=np.int64)[inside] - 1
    size = np.bincount(word, minlength=len(first)).astype(np.int64)
    start = np.zeros(len(first), np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    out = np.full(int(size.sum()) + len(first) + 8, 0x20, np.uint8)
    out[np.arange(len(word)) + word] = low[inside]
    return out, start, start + size, np.searchsorted(first, offsets)


def features(raw, offsets, longest):
    """Bytes, and per run of 1 to `longest` words of a row: start, end, row; and the word count of every row."""
    text, start, end, first = normal_words(raw, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    a, b, r = [], [], []
    for n in range(1, longest + 1):
        ok = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1]) if n > 1 else np.arange(len(row))
        a.append(start[ok])
        b.append(end[ok + n - 1])
        r.append(row[ok])
    return text, np.concatenate(a), np.concatenate(b), np.concatenate(r), count


def _lanes(text):
    """The 8 bytes from every position as one little-endian number."""
    return np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))


def _turn(x, n):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(text, start, end):
    """xxhash64 (seed 0) of many byte ranges; those of 32 bytes and more go through the library."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    lanes, data = _lanes(text), memoryview(text)
    for i in np.flatnonzero(size >= 32):
        out[i] = xxhash.xxh64_intdigest(data[start[i]:end[i]])
    short = np.flatnonzero(size < 32)
    order = short[np.argsort(size[short].astype(np.uint8), kind="stable")]
    edges = np.searchsorted(size[order], np.arange(33))
    for n in range(32):
        which = order[edges[n]:edges[n + 1]]
        if not len(which):
            continue
        at = start[which]
        h = np.full(len(which), _P5 + np.uint64(n), np.uint64)
        for k in range(0, n - 7, 8):
            h = _turn(h ^ (_turn(lanes[at + k] * _P2, 31) * _P1), 27) * _P1 + _P4
        k = n // 8 * 8
        if n - k >= 4:
            h = _turn(h ^ ((lanes[at + k] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            k += 4
        for j in range(k, n):
            h = _turn(h ^ (text[at + j] * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[which] = h ^ (h >> np.uint64(32))
    return out


def _same_bytes(text, a, b, size):
    """Whether the `size` bytes from a and from b are equal, eight at a time."""
    lanes = _lanes(text)
    same = np.ones(len(a), bool)
    left, at = np.arange(len(a)), 0
    while len(left):
        rest = size[left] - at
        shift = (8 * np.clip(8 - rest, 0, 7)).astype(np.uint64)
        differ = ((lanes[a[left] + at] ^ lanes[b[left] + at]) << shift) != 0
        same[left[differ]] = False
        left, at = left[~differ & (rest > 8)], at + 8
    return same


class SlotTable:
    """Open-addressed table of the distinct byte ranges of one chunk."""

    def __init__(self, text, start, end, buckets, keys=None):
        keys = xxh64(text, start, end) if keys is None else keys
        size = 1 << max(4, int(2 * len(start)).bit_length())
        owner = np.full(size, -1, np.int64)
        slot = (keys & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(len(start))
        while len(left):  # one step of linear probing for all occurrences that have no slot yet
            free = left[owner[slot[left]] < 0][::-1]
            owner[slot[free]] = free  # of several the first occurrence takes the slot
            own = owner[slot[left]]
            hit = (keys[own] == keys[left]) & (end[own] - start[own] == end[left] - start[left])
            maybe = np.flatnonzero(hit)
            hit[maybe] = _same_bytes(text, start[own[maybe]], start[left[maybe]], (end - start)[left[maybe]])
            left = left[~hit]
            slot[left] = (slot[left] + 1) & (size - 1)
        self.slot = slot
        self.count = np.bincount(slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        self.used = np.flatnonzero(owner >= 0)
        data, a, b = memoryview(text), start[owner[self.used]].tolist(), end[owner[self.used]].tolist()
        self.bucket[self.used] = [zlib.crc32(data[i:j]) % buckets for i, j in zip(a, b)]

    def bucket_counts(self, buckets):
        return np.bincount(self.bucket[self.used], self.count[self.used], buckets).astype(np.int64)

    def gather(self, gains):
        """The gain of every occurrence."""
        return gains[self.bucket][self.slot]


# ---- the operator ---------------------------------------------------------------

def bucket_counts(df, text="text", longest=1, buckets=BUCKETS):
    """Features per bucket (bucket, n) over all texts; empty buckets are missing."""
    def scan(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            for lo, hi in row_groups(offsets, CHUNK):
                data, a, b, _, _ = features(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], longest)
                total += SlotTable(data, a, b, buckets).bucket_counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return df.select(text).mapInArrow(tidy(scan), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus, target, buckets=BUCKETS):
    """floor(1000 ln) of every bucket's smoothed share in the target over that in the corpus. Two rows of numbers a bucket."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.toLocalIterator():
            into[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log(float(y + 1) * float(all_s + buckets) / (float(x + 1) * float(all_t + buckets))))
                     for x, y in zip(s.tolist(), t.tolist())], np.int64)


def weigh(df, gains, text="text", doc_id="doc_id", longest=1):
    """(doc_id, n_words, n_features, weight) of every row."""
    buckets, sent = len(gains), df.sparkSession.sparkContext.broadcast(gains)

    def scan(batch):
        raw, offsets = text_buffer(batch.column(1))
        out = np.zeros((3, batch.num_rows), np.int64)
        for lo, hi in row_groups(offsets, CHUNK):
            data, a, b, row, words = features(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], longest)
            order = np.argsort(row, kind="stable") if longest > 1 else slice(None)
            per = np.bincount(row, minlength=hi - lo)
            sums = np.concatenate([[0], np.cumsum(SlotTable(data, a, b, buckets).gather(sent.value)[order])])
            ends = np.cumsum(per)
            out[:, lo:hi] = words, per, (sums[ends] - sums[ends - per]) // np.maximum(per, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = df.schema[doc_id].dataType.simpleString()
    return map_texts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scan,
                     f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id, seed):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of `seed:id`."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8)
    u = (F.conv(first, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def numbered(scored, draw, spark, rows_per_range=ROWS_PER_RANGE):
    """`rank` (from 1) of the first `draw` rows by descending score; null for the rest. Rows that cannot be drawn come last."""
    order = [F.col("eligible").desc(), F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-scored.count() // rows_per_range))
    placed = cut(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                 .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    found = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()  # one row a range
    before, so_far = [], 0
    for r in found:
        before.append((r["_p"], so_far))
        so_far += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_p long, _off long"))  # one row a range
    rank = F.col("_off") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("_p", part).join(offsets, "_p", "left")
    return out.withColumn("rank", F.when(F.col("eligible") & (rank <= draw), rank)).drop("_at", "_p", "_off")


def resample(documents, target, percent=10, least_words=20, longest=1, buckets=BUCKETS, seed=2024, text="text", doc_id="doc_id",
             target_text="text"):
    """Every document with n_words, n_features, weight, score and its rank among the drawn (null: not drawn).

    floor(percent * N / 100) of the N documents with at least `least_words` words are drawn.
    """
    spark = documents.sparkSession
    gains = bucket_gains(bucket_counts(documents, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    scored = cut(
        weigh(documents, gains, text, doc_id, longest)
        .withColumn("score", F.col("weight") + gumbel("doc_id", seed))
        .withColumn("eligible", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words))
    )
    draw = percent * scored.filter("eligible").count() // 100
    return numbered(scored, draw, spark).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
