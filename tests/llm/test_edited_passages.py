"""op10: edited repeats end to end, and buckets that hold several groups."""

import random

import numpy as np

from ramify.llm import substring


def _text(rng, vocabulary, n):
    return [rng.choice(vocabulary) for _ in range(n)]


def _edited(words, places, rng, vocabulary):
    out = list(words)
    for k in places:
        out[k] = rng.choice(vocabulary) + "x"
    return out


def test_edited_paragraphs_are_found(make, vocabulary):
    """Lines with an edited word: whole-line Jaccard 0.85, the edit away from the ends, so that 32-word windows differ too."""
    rng = random.Random(21)
    rows = []
    for k in range(40):
        line = _text(rng, vocabulary, 60)
        other = _edited(line, [30], rng, vocabulary)
        rows.append((2 * k, "\n".join(" ".join(x) for x in (_text(rng, vocabulary, 40), line))))
        rows.append((2 * k + 1, "\n".join(" ".join(x) for x in (other, _text(rng, vocabulary, 50)))))
    got = substring.repeated_passages(make(rows)).collect()
    whole = {(r.doc_id, r.keep_doc_id) for r in got if r.n_words >= 60}
    want = {(d, d - d % 2) for d in range(80)}
    assert len(whole & want) >= 0.95 * len(want)
    assert all(r.removed == (r.doc_id % 2 == 1) and r.keep_doc_id == r.doc_id - r.doc_id % 2 for r in got)


def test_short_lines_make_a_paragraph(make, vocabulary):
    rng = random.Random(22)
    lines = [_text(rng, vocabulary, 9) for _ in range(8)]
    other = [list(x) for x in lines]
    other[4][4] = "elsewhere"
    block = lambda x: "\n".join(" ".join(w) for w in x)
    rows = [(1, "short head\n\n" + block(lines)), (2, block(other) + "\n\n" + " ".join(_text(rng, vocabulary, 60)))]
    got = substring.repeated_passages(make(rows)).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in got if 72 <= r.n_words <= 76} == {(1, 1), (2, 1)}


def test_edited_passages_inside_lines_are_found(make, vocabulary):
    """200 words inside longer lines, a word in 60 edited: whatever stands between, most of the passage is found."""
    rng = random.Random(23)
    rows, n = [], 30
    for k in range(n):
        passage = _text(rng, vocabulary, 200)
        for d in (2 * k, 2 * k + 1):
            w = _text(rng, vocabulary, 120)
            w[60:60] = passage if d % 2 == 0 else _edited(passage, range(20, 200, 60), rng, vocabulary)
            rows.append((d, " ".join(w)))
    got = substring.repeated_passages(make(rows)).collect()
    found = sum(r.n_words for r in got if r.removed) / (200 * n)
    assert found > 0.6
    crossed = 0
    for r in got:
        span = dict(rows)[r.doc_id].encode()[r.start:r.end].decode().split()
        crossed += any(w.endswith("x") and w not in vocabulary for w in span[16:-16])
    assert crossed > n // 2


def _band(spark, sets, buckets, threshold=0.75):
    schema = "key long, size long, elems binary, " + ", ".join(f"p{i} long" for i in range(substring.PARITY))
    rows = [(k, len(s), s.tobytes(), *map(int, substring.parity_bits(s))) for k, s in sets.items()]
    entries = spark.createDataFrame([(b, k) for b, keys in buckets.items() for k in keys], "band long, key long")
    comp = substring._linked(entries, spark.createDataFrame(rows, schema), threshold).collect()
    groups = {}
    for r in comp:
        groups.setdefault(r.root, set()).add(r.key)
    return {frozenset(g) for g in groups.values()}


def test_several_groups_in_one_bucket(spark):
    rng = np.random.default_rng(24)
    sets, want = {}, set()
    for g in range(12):
        base = rng.integers(0, 1 << 32, 60).astype(np.uint32)
        own = set()
        for v in range(5):
            s = base.copy()
            if v:
                s[v] = rng.integers(0, 1 << 32)
            sets[10 * g + v] = np.unique(s)
            own.add(10 * g + v)
        want.add(frozenset(own))
    assert _band(spark, sets, {7: list(sets)}) == want


def test_similarities_of_unlike_sizes():
    rng = np.random.default_rng(25)
    pairs = [tuple(np.unique(rng.integers(0, 90, rng.integers(1, 80))).astype(np.uint32) for _ in "xy") for _ in range(50)]
    x, y = zip(*pairs, strict=True)
    got = substring.similarities(np.concatenate(x), np.array([len(s) for s in x]), np.concatenate(y), np.array([len(s) for s in y]))
    assert np.allclose(got, [len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in pairs])


def test_common_clusters_are_spread_with_the_same_result(make, vocabulary, monkeypatch):
    """Passages of many documents take the salted way, rarer ones the plain one; both name the same keeper."""
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, rare = text(60), text(50)
    rows = [(i, text(40) + "\n\n" + common + "\n\n" + text(35)) for i in range(12)] + [(100 + i, text(45) + "\n\n" + rare) for i in range(2)]
    read = lambda: sorted(map(tuple, substring.repeated_passages(make(rows)).drop("cluster").collect()))
    plain = read()
    monkeypatch.setattr(substring, "MANY_PLACES", 5)
    assert read() == plain and {r[0] for r in plain} >= {*range(12), 100, 101}
