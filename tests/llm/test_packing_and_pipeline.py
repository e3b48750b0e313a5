import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import LOWER, components, shingle_set
from tokenizers import Tokenizer

import corpus_pipeline
from ramify.llm import packing
from ramify.llm.common import cut

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_pieces(rows, want, length=2048):
    """Every document's ids lie in its pieces in order; sequences are gapless and full but for the last."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or s == max(sequences)
    assert set(sequences) == set(range(len(sequences)))


def test_packing_odd_rows(make, odd_rows):
    from pyspark.sql import functions as F
    rows = [(i, r[1]) for i, r in enumerate(odd_rows)] + [(500, "a <|endoftext|> b"), (501, " " * 5000), (502, "  x")]
    got = packing.pack(make(rows), *FILES).withColumn("ids_crc32", F.crc32("ids")).collect()
    tok = Tokenizer.from_file(FILES[0])
    check_pieces(got, {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows})


def test_packing_ties_and_nothing(make):
    rows = packing.pack(make([(1, "same text here")] * 700 + [(None, None)]), *FILES, length=64).collect()
    ids = Tokenizer.from_file(FILES[0]).encode("same text here", add_special_tokens=False).ids
    assert sum(r.length for r in rows) == 700 * (len(ids) + 1) + 1
    assert packing.pack(make([]), *FILES).collect() == []


def test_fast_and_exact_tokenizer_agree():
    encode, tok = packing.encoder(*FILES), Tokenizer.from_file(FILES[0])
    rng = random.Random(1)
    pool = [chr(c) for c in (32, 32, 10, 9, 0x85, 0xA0, 0x3000, 0x301, 0x1F600, 0x4E2D, 0xE9)] + list("aZ09'stre!-.")
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_hilbert_keys_walk_step_by_step(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_keys(cells)
    assert sorted(key) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.fixture(scope="module")
def piped(spark):
    """Every stage's input and output at the smallest size."""
    sf, out = "/root/testdata/sf0.001", {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf))
        out[name] = before, docs
    return out


def test_stage_columns_and_counts(piped):
    for name, (before, after) in piped.items():
        if name != "pack":
            assert after.schema == before.schema
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_quality_stage_keeps_clean_documents(spark, piped):
    before, after = piped["quality"]
    kept = {r.doc_id for r in after.collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.5


def test_exact_stage(piped):
    before, after = piped["exact_dedup"]
    best = {}
    for r in before.collect():
        t = r.text.translate(LOWER)
        best[t] = max(best.get(t, -1), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(best.values())


def test_near_stage(piped):
    before, after = piped["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    keep = {min(rows[j][0] for j in g) for n, g in components(rows).values() if n}
    keep |= {i for i, t in rows if not shingle_set(t)}
    assert {r.doc_id for r in after.collect()} == keep


def test_leak_stage(spark, piped):
    import re
    before, after = piped["decontaminate"]
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in before.collect() if any(i in plain(r.text) for i in items)}
    kept = {r.doc_id for r in after.collect()}
    assert not leaky & kept and len(kept) >= 0.9 * (before.count() - len(leaky))


def test_pack_stage(piped):
    before, after = piped["pack"]
    tok = Tokenizer.from_file(FILES[0])
    check_pieces(after.collect(), {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in before.collect()})
