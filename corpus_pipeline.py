"""From raw documents to packed training sequences: five stages, each one of the text operators.

1. quality: documents that the compression classifier rejects go; 2. exact_dedup: of equal texts the row of the largest id
stays; 3. near_dedup: of documents linked by 0.75 Jaccard on 5-word shingles one stays; 4. decontaminate: documents that
hold a benchmark item, exact or edited, go; 5. pack: what is left becomes sequences of 2048 tokens along a Hilbert curve.

Every stage works on all rows its predecessor kept. Null and empty texts: scored as empty text in 1, one of them stays
after 2, linked with nothing in 3, clean in 4, their end id in 5.
"""

from pyspark.sql import functions as F

from ramify.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from ramify.llm.common import cut, id_remainder, labelled_sample, table


def keep_quality(spark, docs, sf_dir):
    """Labels of ids whose crc32 modulo 3 is not 1 teach the classifier, as in the query of its own."""
    sample, sizes = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", [0, 1],
                                    id_remainder(3) != 1, quality.PER_CLASS)
    return quality.keep_good(docs, quality.fit(sample, sizes))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    return ngram_join.drop_linked(docs)


def drop_leaks(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark, docs, sf_dir):
    import public_tokenizers
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pack", pack_sequences),
]

#: SQL cannot express the classifier, the alignment or the packing; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the table documents; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
