"""Language by bit-sliced Bloom filters of character n-grams.

Every slot of the filter holds one bit per language (bit-sliced in 64-bit words), so one probe (the AND of `HASHES` slots) gives the bitmask of
all languages that contain an n-gram. Per language the set bits over a text are counted and corrected for the
filter's false positives, which are known from the share of its bits that are set: with hit share h and false
positive rate f, the share of n-grams the language holds is (h - f) / (1 - f). The largest share decides.

The filters are filled from at most `per_language` texts of each language (the only bound here); an n-gram enters a
language's filter when at least `least` of its sample texts hold it. Every whole text is classified from its text.

Defined cases: a null text or one without letters is `und` with score 0. A text whose n-grams no language holds goes
to the language with the most documents, score 0. Ties go to the language first in the order of document counts,
then of names. Without a learned language every text is `und`. A text of any length is cut into chunks of texts, never
itself; repeated rows and ids are classified row by row; an empty table gives no rows; columns not named in `keep` are
left out. There is no limit to the languages: a slot has one 64-bit word for every 64 of them (8 MB a word).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ramify.llm.common import kept, map_texts, mix

PER_LANGUAGE = 400
SLOT_BITS = 20
HASHES = 3
N = 4


def _letters():
    t = np.zeros(0x110000, bool)
    t[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return t


def grams(texts):
    """Hashed n-grams of all texts and the text of each.

    Texts are lower-cased, each run of other signs becomes one space, with spaces before and after the text,
    so a single letter has n-grams too.
    """
    low = [(t or "").lower() for t in texts]
    lens = np.array([len(t) for t in low], np.int64)
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), lens)
    letter = kept("letters", 0, _letters)[cp]
    head = np.ones(len(cp), bool)
    head[1:] = letter[:-1] | (doc[1:] != doc[:-1])
    keep = letter | head
    cp, doc, letter = np.where(letter, cp, 32)[keep], doc[keep], letter[keep]
    has = np.bincount(doc[letter], minlength=len(low)) > 0
    # one space before and N - 1 behind every text
    size = np.bincount(doc, minlength=len(low))
    begin = np.concatenate([[0], np.cumsum(size + N)])
    at = np.arange(len(cp)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) + begin[doc] + 1
    padded = np.full(begin[-1], 32, np.uint64)
    padded[at] = cp
    owner = np.repeat(np.arange(len(low), dtype=np.int32), size + N)
    m = len(padded) - N + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
    key = padded[:m].copy()
    for k in range(1, N):
        key = key * np.uint64(0x100000001B3) + padded[k:k + m]
    good = (owner[:m] == owner[N - 1:]) & has[owner[:m]]
    return mix(key[good]), owner[:m][good], has


def _probes(h):
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def language_sample(documents, learn, per_language=PER_LANGUAGE, seed=5):
    """(text, lang) pairs to learn from and the number of labelled ids per language.

    At most `per_language` ids of each language, those with the least hashes; `learn` is the condition on doc_id. An id with
    several languages counts as the last of them. The ranks see ids only, and rows beyond the bound go before the shuffle.
    """
    usable = (
        documents.select("doc_id", F.col("lang").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(learn)
        .groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    )
    spark = documents.sparkSession
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().toLocalIterator()}
    # hashes are even, so the least ones of a language lie below a bound known from its size; ten times the rows are let through
    top = [(c, (1 << 63) - 1 if n <= 10 * per_language else int(-(1 << 63) + 10 * per_language / n * (1 << 64))) for c, n in sizes.items()]
    low = usable.join(F.broadcast(spark.createDataFrame(top, "label string, _top long")), "label").filter(F.col("_h") <= F.col("_top"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id"))
    chosen = low.withColumn("_r", rank).filter(F.col("_r") <= per_language).select("doc_id", "label")
    rows = (
        documents.select("doc_id", "text").filter(F.length("text") > 0)
        .join(F.broadcast(chosen), "doc_id")  # at most per_language ids a language
        .withColumn("_h", F.xxhash64("text", F.lit(seed)))
        .orderBy("_h", "doc_id", "text").limit(per_language * max(1, len(sizes))).select("text", "label")
    )
    return [(r["text"], r["label"]) for r in rows.collect()], sizes


def fit(sample, sizes, least=2):
    """Filters from (text, language) pairs; `sizes` are the document counts per language."""
    langs = sorted({c for _, c in sample}, key=lambda c: (-sizes.get(c, 0), c))
    table = np.zeros((-(-len(langs) // 64) or 1, 1 << SLOT_BITS), np.uint64)
    for number, lang in enumerate(langs):
        word, bit = divmod(number, 64)
        h, doc, _ = grams([t for t, c in sample if c == lang])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        own, count = np.unique(h[first], return_counts=True)
        for slot in _probes(own[count >= least] if (count >= least).any() else own):
            np.bitwise_or.at(table[word], slot, np.uint64(1 << bit))
    fills = [float(((table[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean()) for b in range(len(langs))]
    return {"langs": langs, "table": table, "false": np.array([f ** HASHES for f in fills])}


def classify(texts, model):
    """Language and score of every text."""
    k, n = len(model["langs"]), len(texts)
    if k == 0 or n == 0:
        return ["und"] * n, np.zeros(n)
    h, doc, has = grams(texts)
    probes, masks = _probes(h), []
    for table in model["table"]:
        mask = table[probes[0]]
        for slot in probes[1:]:
            mask = mask & table[slot]
        masks.append(mask)
    total = np.maximum(1, np.bincount(doc, minlength=n))
    share = np.empty((n, k))
    for b in range(k):
        hits = np.bincount(doc[(masks[b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1], minlength=n)
        share[:, b] = (hits / total - model["false"][b]) / (1 - model["false"][b])
    share = np.clip(share, 0, 1)
    best = share.argmax(1)
    top, whole = share.max(1), share.sum(1)
    score = np.where(has & (whole > 0), top / np.maximum(whole, 1e-12), 0.0)
    return [model["langs"][b] if ok else "und" for b, ok in zip(best, has, strict=True)], score


def detect(df, model, text="text", keep=("doc_id",), chunk_chars=1 << 20):
    """The columns `keep` of df with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a filter of fixed size
    fields = [df.schema[c] for c in keep]
    names = [*keep, "lang_pred", "score"]

    def part(batch):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        langs, scores, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= chunk_chars):
                size += len(texts[to] or "")
                to += 1
            lang, score = classify(texts[at:to], shared.value)
            langs += lang
            scores.append(score)
            at = to
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double"])
    return map_texts(df.select(*[f"`{c}`" for c in keep], df[text].alias("_text")), part, schema)
