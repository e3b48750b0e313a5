import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "keep_id long, kept string, score double, shard int, slot int, key string, mark long, root long, a long, b long")


def fill(rows):
    """Rows (doc_id, text[, lang, source]) with clashing extra columns, some null."""
    out = []
    for i, r in enumerate(rows):
        r = (*r, *(None,) * (4 - len(r)))
        out.append((r[0], r[1], r[2], r[3], None, -5, None, 9.0, 77, 77, "k", 1, None, 3, 4))
    return out


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(fill(rows), SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(2000)]


@pytest.fixture(scope="session")
def odd_rows(vocabulary):
    """Nulls, empties, one very long text, ties, repeated rows, a null id."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(80)
    rows = [(i, text(rng.randint(1, 120)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    rows += [(60, base, "en", "s0"), (61, base, "en", "s1"), (62, base.upper(), None, None), (62, base.upper(), None, None),
             (63, base + " more", "en", "s0"), (64, None, None, None), (65, "", "en", "s0"), (66, " \t\n ", "de", None),
             (None, base, None, "s2"), (None, None, None, None), (67, text(40_000), "en", "s3"), (68, "x" * 50_000, "en", "s3"),
             (69, "... !!! 123", None, "s1"), (70, "Ünïcode İ ß 你好 🙂", "de", "s1")]
    return rows
