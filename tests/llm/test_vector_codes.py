import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers_llm import duck_rows

from ramify.llm import vector_codes
from ramify.llm.queries import ORACLE, QUERIES


def brute(rows, parts, entries, rounds):
    """Plain rounds over all points with Python's whole numbers."""
    kept = [(i, lab, [float(x) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max([len(v) for *_, v in kept], default=1) // parts) * parts
    kept = [(i, lab, [int(np.floor(4096 * x)) for x in v] + [0] * (width - len(v))) for i, lab, v in kept]
    w = width // parts
    cutv = lambda v: [tuple(v[k * w:(k + 1) * w]) for k in range(parts)]
    first = {}
    for i, _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2])):
        first.setdefault(i, v)
    start = [cutv(first[i]) for i in sorted(first)[:entries]]
    books = [[s[k] for s in start] for k in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        sums = [defaultdict(list) for _ in range(parts)]
        for _, _, v in kept:
            for k, p in enumerate(cutv(v)):
                sums[k][near(p, books[k])[1]].append(p)
        books = [[tuple(sum(c) // len(got) for c in zip(*got)) if (got := sums[k][j]) else e for j, e in enumerate(book)]
                 for k, book in enumerate(books)]
    out, labels = [], Counter()
    for i, lab, v in kept:
        found = [near(p, books[k]) for k, p in enumerate(cutv(v))]
        e = sum(d for d, _ in found)
        labels[lab] += e
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), e))
    return Counter((*r, labels[r[1]]) for r in out), books


def vectors(n, width=16, seed=3):
    """Clusters, grid points with many equal distances, repeated vectors."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            v = [c + rng.gauss(0, .05) for c in centres[i % 5]]
        elif kind == 1:
            v = [float(rng.randint(-1, 1)) for _ in range(width)]
        elif kind == 2:
            v = centres[0]
        else:
            v = [rng.gauss(0, 1) for _ in range(width)]
        out.append((i * 3 + 1, [float(np.float32(x)) for x in v], rng.choice([None, 1, 2, 3])))
    return out


ODD = [(5000, None, 1), (5001, [1.0] * 15 + [None], 1), (5002, [float("nan")] + [0.0] * 15, 2), (5003, [float("-inf")] * 16, None),
       (None, [0.5] * 16, 1), (None, None, None), (1, [9.0] * 16, 2), (1, [9.0] * 16, 2), (5004, [0.0] * 16, 3), (5005, [], 3), (5006, [2.5], None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1.0, "x", 3) for i, v, lab in rows],
                                 "vec_id long, embedding array<float>, label int, error double, code string, part int")


@pytest.mark.parametrize("n, parts, entries, rounds, block", [(400, 8, 16, 6, 4096), (300, 4, 5, 3, 37), (250, 5, 16, 2, 100), (6, 8, 16, 6, 3)])
def test_same_as_loops(spark, n, parts, entries, rounds, block):
    rows = vectors(n) + ODD
    random.Random(n).shuffle(rows)
    got, books = vector_codes.encode(frame(spark, rows), parts=parts, entries=entries, rounds=rounds, block=block)
    want, want_books = brute(rows, parts, entries, rounds)
    assert [[tuple(e) for e in b.tolist()] for b in books] == want_books
    assert Counter(tuple(r) for r in got.collect()) == want


def test_no_rows(spark):
    got, books = vector_codes.encode(frame(spark, ODD[:4]))
    assert got.collect() == [] and books == []


def test_large_component_is_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        vector_codes.encode(frame(spark, [(1, [2.0 ** 17] * 8, 1)]))


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "SMALL_LABELS", 1)
    rows = vectors(120)
    got, _ = vector_codes.encode(frame(spark, rows), rounds=1)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 8, 16, 1)[0]


def test_balls_are_owned_as_a_whole():
    """In clustered points most balls are settled above the leaves; sums and choices are those of plain comparison."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (6, 8))
    x = (centres[rng.integers(0, 6, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int32)
    tree = vector_codes.build_tree(x)
    entries = np.concatenate([centres, centres[:2], rng.integers(-4000, 4000, (4, 8))]).astype(np.int64)
    ball, owner, point, _ = vector_codes.walk(tree, entries)
    assert len(point) < 300 and len(ball) < 200
    d = ((x[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
    code, error = vector_codes.assign(tree, entries)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    sums, n = vector_codes.entry_sums(tree, entries)
    assert (n == np.bincount(d.argmin(1), minlength=len(entries))).all()
    assert (sums[0] == x[d.argmin(1) == 0].sum(0)).all()


def test_ball_ranges_and_radii():
    x = np.random.default_rng(2).integers(-99, 99, (700, 3)).astype(np.int32)
    t = vector_codes.build_tree(x)
    assert sorted(t["order"].tolist()) == list(range(700))
    for k in range(len(t["left"])):
        own = t["points"][t["start"][k]:t["end"][k]]
        assert (own.sum(0) == t["sum"][k]).all()
        assert np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= t["radius"][k] + 1e-6
        if t["left"][k] >= 0:
            a, b = t["left"][k], t["right"][k]
            assert t["start"][k] == t["start"][a] and t["end"][a] == t["start"][b] and t["end"][b] == t["end"][k]
        else:
            assert len(own) <= vector_codes.LEAF or (own == own[0]).all()


def test_query_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_anchor_codes"](spark, sf)
    assert Counter(tuple(r) for r in got.collect()) == duck_rows(sf, ORACLE["op13_anchor_codes"], got.columns)
