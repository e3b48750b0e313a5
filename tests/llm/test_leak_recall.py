"""op5: recall of the seeds against full alignment, on copies near the threshold."""

import random

import numpy as np
import pyarrow as pa

from ramify.llm import decontaminate


def _score(item, text):
    a, b = (next(decontaminate._words(pa.array([" ".join(w)])))[3] for w in (item, text))
    return decontaminate.align(a, b)[0] / (2 * len(a))


def _found(items, docs):
    hashes = [next(decontaminate._words(pa.array([" ".join(w)])))[3] for w in items]
    p = decontaminate.plan(list(range(len(items))), hashes)
    return {(r, k): s for r, k, s, *_ in decontaminate.matches(pa.array([" ".join(w) for w in docs]), p)}


def test_short_items_with_replaced_words(vocabulary):
    rng = random.Random(31)
    item = rng.sample(vocabulary, 15)
    docs = []
    for places in ((2, 5, 9, 12), range(2, 14, 3)):
        copy = [f"{w}q9" if i in places else w for i, w in enumerate(item)]
        docs.append(rng.sample(vocabulary, 80) + copy + rng.sample(vocabulary, 80))
    split = [x for w in item for x in (w, "between9")]
    docs += [rng.sample(vocabulary, 40) + split, item[:8] + [f"in{i}" for i in range(11)] + item[8:], rng.sample(vocabulary, 300)]
    got = _found([item], docs)
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_every_pair_of_full_alignment_is_found():
    """Few distinct words, so that common seeds abound; random edits around the threshold."""
    rng = random.Random(32)
    words = [f"w{i}" for i in range(120)]
    items = [[rng.choice(words) for _ in range(rng.randint(4, 40))] for _ in range(25)]
    docs = []
    for _ in range(150):
        copy = []
        for w in rng.choice(items):
            u, rate = rng.random(), 0.36
            copy += [w] if u > rate else [rng.choice(words)] if u > rate / 2 else [] if u > rate / 4 else [w, rng.choice(words)]
        d = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(d))
        docs.append(d[:at] + copy + d[at:])
    want = {(r, k): s for r, d in enumerate(docs) for k, w in enumerate(items) if (s := _score(w, d)) >= 0.5}
    got = _found(items, docs)
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in want) and len(want) > 50
    assert sum(s < 0.65 for s in want.values()) > 10
