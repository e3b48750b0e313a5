import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import components, shingle_set

from ramify.llm import common, decontaminate, ngram_join, substring, surrogates


# ---- words and shingles ------------------------------------------------------

def test_shingles_match_strings(odd_rows):
    import pyarrow as pa
    texts = [t for _, t, *_ in odd_rows]
    raw, offsets = common.text_buffer(pa.array(texts))
    sets = list(common.shingle_sets(common.lowered(raw), offsets))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert len(np.unique(np.concatenate(sets))) == len(frozenset().union(*map(shingle_set, texts)))


# ---- 7: n-gram Jaccard join --------------------------------------------------

def near_copies(base, rng, vocabulary, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def near_rows(odd_rows, vocabulary):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [r[:2] for r in odd_rows]
    line = text(12)
    at = 100
    for size, n, edits in ((60, 90, 6), (150, 40, 12), (8, 30, 2), (400, 12, 25)):
        for t in near_copies(text(size), rng, vocabulary, n, edits):
            rows.append((at, t))
            at += 1
    rows += [(at + i, line + " " + text(rng.randint(2, 30))) for i in range(80)]  # a common line is no link
    return rows


def test_components_match_all_pairs(make, near_rows):
    got = ngram_join.linked_documents(make(near_rows)).collect()
    want = components(near_rows)
    named = Counter()
    for i, (n, group) in want.items():
        ids = [near_rows[j][0] for j in group if near_rows[j][0] is not None]
        own = near_rows[i][0]
        named[own, n, (min(ids) if ids else None) if n else own] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == named
    assert len({r.component_id for r in got}) < len(near_rows) - 50


def test_drop_linked_leaves_one_of_each(make, near_rows):
    df = make(near_rows)
    out = ngram_join.drop_linked(df)
    assert out.schema == df.schema
    kept = Counter(r.doc_id for r in out.collect())
    groups = {frozenset(g) for n, g in components(near_rows).values() if n}
    for g in groups:
        ids = [near_rows[j][0] for j in g if near_rows[j][0] is not None]
        assert not ids or kept[min(ids)] == 1
    empty = sum(not shingle_set(t) for _, t in near_rows)
    assert sum(kept.values()) == len(groups) + empty


def test_join_of_nothing(make):
    assert ngram_join.linked_documents(make([])).collect() == []
    rows = ngram_join.linked_documents(make([(1, None), (2, ""), (2, "")])).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == {(1, 0, 1): 1, (2, 0, 2): 2}


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2000, 200)).astype(np.uint64)
        y = np.unique(rng.integers(0, 2000, 200)).astype(np.uint64)
        bits = ngram_join.parity_bits(x) ^ ngram_join.parity_bits(y)
        assert sum((int(b) & 0xFFFFFFFFFFFFFFFF).bit_count() for b in bits) <= len(np.setxor1d(x, y))


# ---- 5: decontamination ------------------------------------------------------

def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_plain_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in "ab")
        score, lo, hi = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a, b[lo:hi + 1]) == score


@pytest.fixture(scope="module")
def leaks(vocabulary):
    rng = random.Random(4)
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(12, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "two words"), (93, "")]
    docs, truth = [], set()
    for d in range(120):
        w = text(150)
        if d % 3 == 0:
            i = rng.randrange(25)
            copy = items[i][1].split()
            if d % 2:
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if d % 6 == 0:
                copy = [x.upper() + "***" for x in copy]
            w[70:70] = copy
            truth.add((d, i))
        docs.append((d, " ".join(w)))
    return docs, items, truth


def test_leaks_are_found_and_clean_documents_left(make, spark, leaks, odd_rows):
    docs, items, truth = leaks
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make([*docs, *((500 + i, r[1]) for i, r in enumerate(odd_rows))])
    got = decontaminate.contaminations(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    text = dict(docs)
    for r in got:
        span = text[r.doc_id].encode()[r.span_start:r.span_end].decode()
        if r.score == 1:
            assert re.sub(r"\W", "", span).lower() == re.sub(r"\W", "", items[r.item_id][1])
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - {d for d, _ in truth}


def test_blocks_of_items_and_empty_sides(make, spark, leaks, monkeypatch):
    docs, items, truth = leaks
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, block_grams=100))
    assert len(blocks) > 3 and sorted(i for ids, _ in blocks for i in ids) == list(range(25))
    assert decontaminate.contaminations(make([]), bench).collect() == []
    assert decontaminate.contaminations(make(docs), bench.limit(0)).collect() == []


# ---- 10: repeated passages ---------------------------------------------------

def test_passages_of_fifty_words(make, odd_rows, vocabulary):
    rng = random.Random(9)
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [" ".join(text(50)) for _ in range(6)]
    rows, holders = [], defaultdict(set)
    for d in range(200):
        w = text(rng.randint(20, 300))
        if d % 4 == 0:
            p = rng.randrange(6)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [passages[p].upper() if d % 8 else passages[p]]
            holders[p].add(d)
        rows.append((d, " ".join(w)))
    once = " ".join(text(40))
    rows.append((900, f"{once} {' '.join(text(30))} {once}"))  # twice in one document only
    rows += [(1000 + i, r[1]) for i, r in enumerate(odd_rows) if r[1] and len(r[1]) > 1000]
    got = substring.repeated_passages(make(rows)).collect()
    assert {r.doc_id for r in got} == set().union(*holders.values())
    keeper = {d: min(h) for h in holders.values() for d in h}
    data = dict(rows)
    for r in got:
        assert r.removed == (r.doc_id != r.keep_doc_id) and r.keep_doc_id >= keeper[r.doc_id]
        span = data[r.doc_id].encode()[r.start:r.end].decode().lower().split()
        assert len(span) == r.n_words >= 32
        assert max(len(set(span) & set(p.split())) for p in passages) >= 0.75 * len(set(span))


def test_edited_paragraphs_link(vocabulary):
    """Recall of the bands against all pairs of paragraphs at 0.75 or more."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, (400, 28)).astype(np.uint32)
    other = base.copy()
    for i in range(400):
        other[i, rng.choice(28, 3, False)] = rng.integers(0, 1 << 32, 3)
    sim = substring.jaccard(base, other)
    assert (sim >= 0.75).all()
    want = [len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in zip(base.tolist(), other.tolist(), strict=True)]
    assert np.allclose(sim, want)
    met = (substring.signatures(base) == substring.signatures(other)).any(1)
    assert met.mean() > 0.95


def test_passages_of_nothing(make):
    assert substring.repeated_passages(make([])).collect() == []
    assert substring.repeated_passages(make([(1, None), (2, ""), (3, "short text")])).collect() == []


def test_repeated_rows_and_null_ids(make, vocabulary):
    rng = random.Random(2)
    long = " ".join(rng.choice(vocabulary) for _ in range(60))
    got = substring.repeated_passages(make([(1, long), (1, long), (2, long), (None, long)])).collect()
    assert Counter((r.doc_id, r.removed, r.keep_doc_id) for r in got) == {(1, False, 1): 1, (2, True, 1): 1, (None, True, 1): 1}
    assert substring.repeated_passages(make([(1, long), (1, long)])).collect() == []


# ---- 1: surrogates -----------------------------------------------------------

KEY = b"test key"


@pytest.mark.parametrize("size", [2, 3, 10, 1000, 10 ** 16, 1 << 32])
def test_permutations_are_permutations(size):
    xs = range(size) if size <= 1000 else [7 ** k % size for k in range(60)]
    out = [surrogates.permute(x, size, KEY, b"t") for x in xs]
    assert len(set(out)) == len(set(xs)) and all(0 <= y < size for y in out)


def test_surrogates_keep_type_and_format():
    text = ("Mr. James Smith (+1 (974) 555-3436, james@mail.example.com) paid with 4111 1111 1111 1111 from 8.8.4.4; "
            "Frau Monika Größe, DE89370400440532013000, 123-45-6789, token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"; "
            "Господин Иван Петров. JAMES@mail.example.com again, version 2.0 of 2019")
    new, places = surrogates.rewrite(text, KEY, {})
    kinds = [p["kind"] for p in places]
    assert kinds == ["name", "phone", "email", "card", "ip", "name", "iban", "ssn", "hex", "name", "email"]
    part = [new[p["start"]:p["end"]] for p in places]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", part[1]) and part[1] != "+1 (974) 555-3436"
    assert part[0].split()[0] in surrogates.GIVEN["m", "latin"] and part[5].split()[0] in surrogates.GIVEN["f", "latin"]
    assert part[9].split()[0] in surrogates.GIVEN["m", "cyrillic"]
    assert surrogates._luhn(part[3].replace(" ", "")) and re.fullmatch(r"(\d{4} ){3}\d{4}", part[3])
    assert part[6].startswith("DE") and len(part[6]) == 22 and re.fullmatch(r"[0-9A-F]{40}", part[8])
    assert part[2].lower() == part[10].lower() and part[10].split("@")[0].isupper(), "one address, one surrogate"
    assert new.endswith("again, version 2.0 of 2019")
    assert surrogates.rewrite(text, KEY, {})[0] == new and surrogates.rewrite(text, b"other", {})[0] != new


def test_replacement_is_distinct_and_coreferent(make, odd_rows):
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(200)]
    rows = [(i, f"host {ips[i % 200]} mail user{i % 90:03d}@site{i % 7}.example.com and 0{i % 50:015d}") for i in range(400)]
    rows += [(1000 + i, r[1]) for i, r in enumerate(odd_rows)]
    got = {r.doc_id: r for r in surrogates.replace(make(rows), KEY).collect()}
    assert len(got) == len(rows)
    seen = defaultdict(set)
    for i, t in rows:
        found = surrogates.find(t)
        if not found:
            assert got[i].text == t and got[i].n_entities == 0
        for (_, _, kind, norm), place in zip(found, got[i].entities, strict=True):
            seen[kind, norm].add(got[i].text[place.start:place.end])
    assert all(len(v) == 1 for v in seen.values())
    new = Counter((k, next(iter(v))) for (k, _), v in seen.items())
    assert max(new.values()) == 1
    real = {n for _, n in seen}
    assert not any(s in real for _, s in new)


def test_collision_rounds(spark):
    """A two-digit space: drawing must not give two entities one surrogate nor reuse an entity that occurs."""
    found = spark.createDataFrame([("secret", f"{i:02d}") for i in range(0, 60, 2)], surrogates.HANDLED)
    drawn = surrogates.draw(found, KEY, attempts=60).collect()
    assert len({r.new for r in drawn}) == 30 and surrogates.collisions(spark.createDataFrame(drawn)).count() == 0
    assert not {r.new for r in drawn} & {r.norm for r in drawn} and any(r.attempt > 0 for r in drawn)


def test_many_later_attempts_are_joined(make, monkeypatch):
    rows = [(i, f"token = pin{i:02d}9x") for i in range(40)] + [(99, None), (100, "")]
    want = {r.doc_id: r.text for r in surrogates.replace(make(rows), KEY).collect()}
    monkeypatch.setattr(surrogates, "BROADCAST_ROWS", -1)
    got = {r.doc_id: r.text for r in surrogates.replace(make(rows), KEY).collect()}
    assert got == want and got[99] is None and got[100] == ""


def test_surrogates_of_nothing(make):
    assert surrogates.replace(make([]), KEY).collect() == []


def test_crc_helper(spark):
    rows = spark.range(50).select("id", common.id_remainder(3, "id").alias("r"), common.held_out(3, 1, "id").alias("h")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 and r.h == (r.r == 1) for r in rows)
    assert spark.sql("SELECT cast(null AS bigint) AS id").select(common.held_out(3, 1, "id").alias("h")).first().h
