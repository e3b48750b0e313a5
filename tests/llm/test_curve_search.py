import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.llm import curve_search
from ramify.llm.queries import QUERIES

KIND = "vec_id long, embedding array<float>, label int, rank int, score double, h long, near string, cls int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3.0, 4, "n", 5)
                                  for i, v in rows], KIND)


def brute(rows, is_query, k):
    """Per row that asks (a list, as ids may repeat): its k nearest other rows."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = min(((-n, w) for w, n in Counter(len(v) for _, v in ok).items()), default=(0, 0))[1]
    ok = [r for r in ok if len(r[1]) == width]
    out = defaultdict(list)
    for a, (i, v) in enumerate(ok):
        if is_query(i):
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for b, (j, w) in enumerate(ok) if b != a)
            out[i].append(near[:k])
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.rank, r.score, r.vec_id))
    return out


def odd_vectors():
    """Random, clustered and grid vectors, many copies of one vector, ties, and everything that takes no part."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, [float(rng.randint(-1, 1)) for _ in range(7)] + [1.0]) for i in range(300, 600)]
    rows += [(i, [0.5] * 8) for i in range(600, 1000)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [math.nan] * 8), (1010, [math.inf] * 8), (1020, [1.0] * 9),
             (1030, []), (None, [0.5] * 8), (1040, [-0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0]), (1050, [0.0] * 7 + [2.0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("more", [{}, {"query_group": 7, "block_rows": 50}])
def test_whole_windows_are_exact(spark, more):
    rows = odd_vectors()
    got = answers(curve_search.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, recall=1.0, bins=1, **more))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert set(got) == set(want)
    for i, lists in want.items():
        assert [(s, j) for _, s, j in got[i]] == lists[0]
        assert [r for r, _, _ in got[i]] == list(range(1, 6))


def test_recall_of_windows(spark):
    """Directions without structure and clusters, several blocks: at least 0.9 of the true neighbours."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x[:1500] = rng.normal(size=(15, 64))[rng.integers(0, 15, 1500)] + 0.05 * rng.normal(size=(1500, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    got = answers(curve_search.nearest(frame(spark, enumerate(x.tolist())), F.col("vec_id") % 40 == 0, block_rows=500, sample=2000, bins=128))
    hits = 0
    for i in range(0, 4000, 40):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        d[i] = np.inf
        hits += len({j for _, _, j in got[i]} & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert all(abs(s - d[j]) < 1e-12 for _, s, j in got[i]) and len(got[i]) == 10
    assert hits >= 0.9 * 1000


def test_windows_are_narrow_where_vectors_have_structure(spark):
    """On a line in 32 dimensions a few bins are enough."""
    rng = np.random.default_rng(6)
    x = rng.uniform(-5, 5, 6000)[:, None] * rng.normal(size=32) + rng.normal(scale=1e-3, size=(6000, 32))
    kept = frame(spark, enumerate(x.tolist())).select("vec_id", F.col("embedding").alias("vector")).withColumn("h", F.xxhash64("vector"))
    classes = curve_search.classes_of(kept, 11)
    sample, hashes = curve_search._sampled(classes, 6000, 2000, 32)
    model = curve_search.Curves(sample, hashes, bins=200)
    assert curve_search._probe_reach(classes, model, sample[:50], hashes[:50], 10, 32, 0.96) <= 10


def test_few_candidates_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0])]
    got = answers(curve_search.nearest(frame(spark, rows), F.col("vec_id") == 0))
    assert got == {0: [(1, 0.0, 1), (2, 0.0, 1), (3, 5.0, 2)]}
    assert curve_search.nearest(frame(spark, rows[:1]), F.col("vec_id") == 0).collect() == []
    assert curve_search.nearest(frame(spark, []), F.col("vec_id") == 0).collect() == []
    assert curve_search.nearest(frame(spark, rows), F.col("vec_id") == 77).collect() == []


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (6, 2)])
def test_hilbert_steps_to_a_neighbouring_cell(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    key = curve_search.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(1 << dims * bits))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_query_recall(spark):
    sf = "/root/testdata/sf0.001"
    got = answers(QUERIES["op11_shifted_curves"](spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    hits = [len({j for _, _, j in got[i]} & {j for _, j in lists[0]}) for i, lists in want.items()]
    assert set(got) == set(want) and sum(hits) >= 9 * len(hits)
