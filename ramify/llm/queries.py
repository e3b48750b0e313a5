"""Registered queries of the text operators, and their SQL where SQL can express them."""

from pyspark.sql import functions as F

from ramify.llm import (
    curve_search, decontaminate, exact_dedup, langid, ngram_join, packing, quality, resampling, sharding, substring, surrogates, toxicity,
    vector_codes,
)
from ramify.llm.common import held_out, id_remainder, labelled_sample, table


def op1_surrogates(spark, sf_dir, key=b"set a secret key in production"):
    """Every document with its personal data replaced by keyed surrogates."""
    return surrogates.replace(table(spark, sf_dir, "documents"), key)


def op2_language_filters(spark, sf_dir):
    """Language of every document, learned from documents whose id remainder modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    sample, sizes = langid.language_sample(docs, id_remainder(4) != 2)
    found = langid.detect(docs, langid.fit(sample, sizes))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def quality_model(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample, sizes = labelled_sample(docs, labels, "quality", [0, 1], id_remainder(3) != 1, quality.PER_CLASS)
    return quality.fit(sample, sizes)


def op3_compression_quality(spark, sf_dir):
    """Quality of every document, learned from labels whose id remainder modulo 3 is not 1."""
    scored = quality.score_texts(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_stratified_interleave(spark, sf_dir):
    """24 shards of all documents, each with the mixture of sources; law `rows`."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.stratified_shards(rows, source="source", shards=24, seed=7)
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_seed_align(spark, sf_dir):
    """Every pair of a document and a benchmark item of which it holds a copy, exact or edited."""
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxic_sentences(spark, sf_dir):
    """Toxicity of every document and its worst sentence, learned from labels whose id remainder modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample, sizes = labelled_sample(docs, labels, "toxic", [0, 1], id_remainder(3) != 1, toxicity.PER_CLASS)
    scored = toxicity.score_texts(docs, toxicity.fit(sample, sizes))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         "worst_score", "worst_start", "worst_end")


def op7_ngram_jaccard(spark, sf_dir):
    """Every document with its set size and its component of 0.75-similar documents."""
    return ngram_join.linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_curve_packing(spark, sf_dir, vocabulary=None, ranks=None):
    """All documents as pieces of sequences of 2048 tokens; the public byte-level BPE unless other files are named."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, vocabulary, ranks)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_exact_dedup(spark, sf_dir):
    """Every document with its group of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_paragraph_banding(spark, sf_dir):
    """Every passage that repeats across documents, with the document whose occurrence stays."""
    return substring.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_shifted_curves(spark, sf_dir):
    """The 10 nearest other vectors of every vector whose id is divisible by 100."""
    return curve_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_slot_resampling(spark, sf_dir):
    """Every document with its weight towards the benchmark texts and its rank among the drawn tenth."""
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_anchor_codes(spark, sf_dir):
    """Every usable vector with its product code, its error and that of its label."""
    rows, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _vector_code_sql(parts=8, entries=16, rounds=6):
    """Plain k-means rounds, unrolled."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
             near{k} AS MATERIALIZED (
               SELECT row_no, part, min({{'d': list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
                                         'entry': entry}}) AS hit
               FROM comp JOIN book{k} USING (part) GROUP BY row_no, part)""")
        if k < rounds:
            steps.append(f"""
             mean{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY axis)::BIGINT[] AS m
                         FROM (SELECT part, hit.entry AS entry, axis, sum(p[axis]) AS s, count(*) AS n
                               FROM near{k} JOIN comp USING (row_no, part), (SELECT unnest(range(1, (SELECT max(len(p)) FROM comp) + 1)) AS axis)
                               GROUP BY ALL) GROUP BY part, entry),
             book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, e) AS e FROM book{k} LEFT JOIN mean{k} USING (part, entry))""")
    return f"""
        WITH kept AS MATERIALIZED (
               SELECT row_number() OVER () AS row_no, vec_id, label, embedding AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             comp AS MATERIALIZED (
               SELECT row_no, part, list_transform(v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}],
                                                   lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS p
               FROM kept, range({parts}) r(part)),
             book0 AS MATERIALIZED (
               SELECT part, entry, p AS e FROM comp JOIN (SELECT row_no, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (row_no)
               WHERE entry < {entries}),{",".join(steps)},
             coded AS (SELECT row_no, string_agg(printf('%02x', hit.entry), '' ORDER BY part) AS code, sum(hit.d)::BIGINT AS error
                       FROM near{rounds} GROUP BY row_no),
             digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, axis)) AS codebooks_sha256
                        FROM (SELECT part, entry, unnest(e) AS x, generate_subscripts(e, 1) AS axis FROM book{rounds}))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (row_no), digest"""


QUERIES = {f.__name__: f for f in (
    op1_surrogates, op2_language_filters, op3_compression_quality, op4_stratified_interleave, op5_seed_align, op6_toxic_sentences,
    op7_ngram_jaccard, op8_curve_packing, op9_exact_dedup, op10_paragraph_banding, op11_shifted_curves,
    op12_slot_resampling, op13_anchor_codes)}

ORACLE = {
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
                   FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    # crc32 byte by byte, once for each distinct word
    "op12_slot_resampling": r"""
        WITH tbl AS MATERIALIZED (
               SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs
               FROM range(256) r(i)),
             texts AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents
                       UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark),
             word AS MATERIALIZED (
               SELECT row_no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
             hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(hex(w)) // 2),
                                                              lambda k: ('0x' || substr(hex(w), 2 * k + 1, 2))::BIGINT)),
                                                  lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
                        FROM (SELECT DISTINCT w FROM word), tbl),
             filled AS MATERIALIZED (SELECT row_no, bucket FROM word JOIN hashed USING (w)),
             counted AS (SELECT b.bucket, count(*) FILTER (row_no > 0) AS s, count(*) FILTER (row_no < 0) AS t
                         FROM range(10000) b(bucket) LEFT JOIN filled USING (bucket) GROUP BY b.bucket),
             gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                                                     / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain FROM counted),
             weighed AS (SELECT row_no, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
                         FROM filled JOIN gains USING (bucket) WHERE row_no > 0 GROUP BY row_no),
             scored AS (SELECT row_no, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                               coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                                          / 4294967296::DOUBLE)))::BIGINT AS score
                        FROM texts LEFT JOIN weighed USING (row_no) WHERE row_no > 0),
             ranked AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id, weight, n_features) AS r, count(*) OVER () AS n
                        FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
        FROM scored LEFT JOIN ranked USING (row_no)""",
    "op13_anchor_codes": _vector_code_sql(),
}
