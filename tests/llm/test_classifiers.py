import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ramify.llm import langid, quality, toxicity
from ramify.llm.common import labelled_sample
from ramify.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held(doc_id, mod, rem):
    return zlib.crc32(str(doc_id).encode()) % mod == rem


def test_language_query_held_out(spark):
    got = QUERIES["op2_language_filters"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(right) / len(right) > 0.98


@pytest.mark.parametrize("name,label,least,cut", [("op3_compression_quality", "quality", 0.95, 0.5), ("op6_toxic_sentences", "toxic", 0.85, 0.7)])
def test_label_queries_held_out(spark, name, label, least, cut):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == held(i, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for i, r in got.items())
    rows = [(got[r.doc_id].predicted, r[label]) for r in labels if got[r.doc_id].held_out]
    recall = {c: sum(p == y for p, y in rows if y == c) / sum(y == c for _, y in rows) for c in (0, 1)}
    assert (recall[0] + recall[1]) / 2 > least, recall


def test_learning_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    sample, sizes = labelled_sample(docs, labels, "quality", [0, 1], F.crc32(F.col("doc_id").cast("string")) % 3 != 1, 40)
    used = [int(t.split()[2]) for t, _ in sample]
    assert not any(held(i, 3, 1) for i in used) and Counter(y for _, y in sample) == {0: 40, 1: 40}
    assert sum(sizes.values()) == sum(not held(i, 3, 1) for i in range(300))


@pytest.fixture(scope="module")
def samples(vocabulary):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(vocabulary[:400]) for _ in range(60)) + ". And more of it" for _ in range(120)]
    bad = [" | ".join(rng.choice(vocabulary[400:500]).upper() for _ in range(60)) for _ in range(60)]
    return clean, bad


def test_quality_odd_rows(make, odd_rows, samples):
    clean, bad = samples
    model = quality.fit([(t, 1) for t in clean] + [(t, 0) for t in bad], {1: 120, 0: 60})
    rows = quality.score_texts(make(odd_rows), model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 9) for r, (_, t, *_) in zip(rows, odd_rows, strict=True) if not t}) == 1
    assert quality.scores(clean[:5], model).min() > 0.9 and quality.scores(bad[:5], model).max() < 0.1
    kept = quality.keep_good(make([(1, clean[0]), (2, bad[0]), (2, bad[0])]), model)
    assert [r.doc_id for r in kept.collect()] == [1] and "kept" in kept.columns


def test_quality_without_labels(make):
    assert quality.scores(["a", None], quality.fit([], {})).tolist() == [0.5, 0.5]
    assert quality.scores(["a"], quality.fit([("x", 1)] * 20, {1: 20})).tolist() == [1.0]
    assert quality.score_texts(make([]), quality.fit([], {})).collect() == []


def test_toxicity_finds_the_sentence(make, odd_rows, vocabulary):
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice(vocabulary[:300]) for _ in range(8))
    docs = []
    for i in range(200):
        s = [sentence() for _ in range(6)]
        if i % 2:
            s[rng.randrange(6)] += " villain"
        docs.append((". ".join(s), i % 2))
    model = toxicity.fit(docs, {0: 100, 1: 100})
    text = "Alles gut. Du VILLAIN, ja! Ende"
    score, worst, span = toxicity.score_column(pa.array([text, None, "", "...", "villain"]), model)
    assert score[0] > 0.7 and score[4] > 0.7 and (score[1:4] == 0).all()
    a, b = span[0]
    assert text.encode()[a:b].decode().startswith("Du VILLAIN") and (span[1:4] == -1).all()
    assert abs(score[4] - worst[4]) < 1e-9, "one sentence: noisy-or is that sentence"
    rows = toxicity.score_texts(make(odd_rows), model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)


def test_noisy_or_of_sentences(vocabulary):
    model = {"bias": -1.0, "weights": toxicity.fit([("bad thing", 1), ("good thing", 0)] * 30, {0: 30, 1: 30})["weights"]}
    text = "bad. good. bad bad. thing"
    z, *_ = toxicity.sentence_logits(*_buffer(text), model)
    want = 1
    for v in z:
        want *= 1 - 1 / (1 + 2.718281828459045 ** -v)
    assert abs(toxicity.score_column(pa.array([text]), model)[0][0] - (1 - want)) < 1e-9


def _buffer(text):
    from ramify.llm.common import text_buffer
    return text_buffer(pa.array([text]))


def test_toxicity_without_labels(make):
    assert toxicity.fit([("a", 1)] * 5, {1: 5}) is None
    assert [r.score for r in toxicity.score_texts(make([(1, "a"), (2, None)]), None).collect()] == [0.0, 0.0]
    assert toxicity.score_texts(make([]), None).collect() == []


def test_language_cases(make, odd_rows):
    model = langid.fit([("the cat sat on the mat with the hat", "en")] * 3 + [("der hund und die katze sind nicht da", "de")] * 3,
                       {"en": 5, "de": 3})
    langs, score = langid.classify(["the hat", "die katze", None, "", "123 !!", "漢字", "x"], model)
    assert langs[:5] == ["en", "de", "und", "und", "und"] and langs[5] == "en" and (score[2:6] == 0).all()
    rows = langid.detect(make(odd_rows), model).collect()
    assert len(rows) == len(odd_rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for r, (_, t, *_) in zip(rows, odd_rows, strict=True))
    assert langid.detect(make([]), model).collect() == []
    assert langid.classify(["abc"], langid.fit([], {}))[0] == ["und"]


def test_language_filter_has_no_false_negatives():
    texts = ["alpha beta gamma delta", "alpha beta gamma delta epsilon"]
    model = langid.fit([(t, "x") for t in texts], {"x": 2})
    _, score = langid.classify([texts[0]], model)
    assert score[0] == 1.0 and (model["false"] < 0.01).all()


def test_a_hundred_languages(make):
    """More languages than a word of the filter has bits: each has thirty words of the same letters."""
    rng = random.Random(2)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(100)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(60))
    rows = [(i, text(lang), lang, "s") for i, lang in enumerate(lang for lang in words for _ in range(6))]
    df = make(rows)
    sample, sizes = langid.language_sample(df, F.col("doc_id") >= 0, per_language=5)
    assert len(sizes) == 100 and len(sample) == 500
    held = make([(1000 + k, " ".join(t.split()[:12]), None, "s") for k, (_, t, *_) in enumerate(rows[::6])])
    got = {r.doc_id: r.lang_pred for r in langid.detect(held, langid.fit(sample, sizes, least=1)).collect()}
    assert got == {1000 + k: r[2] for k, r in enumerate(rows[::6])}
