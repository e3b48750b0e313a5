import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute import LOWER
from helpers_llm import duck_rows

from ramify.llm import resampling
from ramify.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, least, longest, buckets, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, grams(text, longest)[1]))
    for text in target:
        t.update(map(bucket, grams(text, longest)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, pool = [], []
    for i, text, *_ in rows:
        n, g = grams(text, longest)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                pool.append((-score, i, weight, len(g)))
        out.append((i, len(g), weight, score))
    pool.sort()
    rank = {}
    for k, (s_, i, w, n) in enumerate(pool[:percent * len(pool) // 100], 1):
        rank.setdefault((i, n, w, -s_), []).append(k)
    return Counter((*r, rank[r].pop() if rank.get(r) else None) for r in out)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (2, 97, 35), (3, 10_000, 100)])
def test_same_as_loops(make, spark, odd_rows, longest, buckets, percent):
    target = [odd_rows[3][1], "Ünïcode words 12-34", None, ""]
    got = resampling.resample(make(odd_rows), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"),
                              percent=percent, longest=longest, buckets=buckets)
    got = Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == brute(odd_rows, target, percent, 20, longest, buckets, 2024)


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(make([]), none).collect() == []
    rows = resampling.resample(make([(1, "a b c"), (2, None)]), none, least_words=1, percent=100).collect()
    assert sorted((r.doc_id, r.rank) for r in rows) == [(1, 1), (2, None)]


def test_hash_is_xxhash64():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(70), *range(40)]]
    text = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    end = np.cumsum([len(p) for p in parts])
    got = resampling.xxh64(text, end - [len(p) for p in parts], end)
    assert got.tolist() == [xxhash.xxh64_intdigest(p) for p in parts]


def test_colliding_keys_stay_apart():
    """All keys equal: the bytes alone decide, also of long words that differ in the last byte only."""
    words = [b"a", b"b", b"abcdefgh", b"abcdefghi", b"abcdefghj", b"x" * 40 + b"1", b"x" * 40 + b"2"] * 3
    text = np.frombuffer(b" ".join(words) + b" " * 8, np.uint8)
    size = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    table = resampling.SlotTable(text, start, start + size, 1000, keys=np.full(len(words), 5, np.uint64))
    assert len(table.used) == 7 and set(table.count[table.used]) == {3}
    assert table.bucket[table.slot].tolist() == [zlib.crc32(w) % 1000 for w in words]


def test_ranks_run_on_across_ranges(spark, make):
    rows = [(i, " ".join(["word"] * (20 + i % 7))) for i in range(500)]
    df = resampling.resample(make(rows), spark.createDataFrame([(1, "other")], "item_id long, text string"), percent=100)
    got = sorted(df.collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1, 501))
    assert [(r.score, -r.doc_id) for r in got] == sorted(((r.score, -r.doc_id) for r in got), reverse=True)


def test_query_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_slot_resampling"](spark, sf)
    want = duck_rows(sf, ORACLE["op12_slot_resampling"], got.columns)
    assert Counter(tuple(r) for r in got.collect()) == want
