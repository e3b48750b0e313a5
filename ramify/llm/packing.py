"""Packing along a space-filling curve.

Every document becomes token ids and a hashed vector of them, which is projected to three dimensions; the Hilbert
key of that point puts like documents close to each other. The documents are range-sorted by key, laid end to end
and cut every `length` tokens, so that only the very last sequence can be short and neighbours share sequences.

1. Tokens. One pass writes key, token count and packed ids to the shared folder.
2. Ranges. The narrow keys are range-partitioned; each range's lowest key and token total give its place in the
   whole order. The ranges grow in number with the tokens, about RANGE_BYTES of ids each.
3. Pieces. Each range is sorted and cut with its global offset. The low bits of a key come from a hash of id and text,
   so the copies of one text spread over ranges too.

Defined cases: a null text is empty; an empty document is its end id alone. Rows equal in id and text are placed one
after the other. An empty table gives no pieces. Other columns are ignored.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ramify.llm.common import cut, cut_packed, drop_cut, kept, tidy

END_ID = 1
RANGE_BYTES = 64 << 20
DIMS = 256
BITS = 16
SPREAD_BITS = 15


def encoder(vocabulary, ranks):
    """Text to ids, as the vocabulary file defines them.

    The rank file holds the same vocabulary for a faster library with equal ids; a text with a special token's
    string goes through the vocabulary file, where it is one id.
    """
    def build():
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        exact = Tokenizer.from_file(vocabulary)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text):
            if any(s in text for s in special):
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        return encode
    return kept("encoder", (vocabulary, ranks), build)


def _projection(vocabulary_size):
    """Per token id a hashed dimension and sign; and the projection of the dimensions to three."""
    rng = np.random.default_rng(11)
    return (rng.integers(0, DIMS, vocabulary_size), rng.choice([-1.0, 1.0], vocabulary_size), rng.standard_normal((DIMS, 3)))


def points(ids, tables):
    """Point of a document in the unit cube: damped hashed counts, normalised, projected, squashed."""
    dim, sign, project = tables
    v = np.bincount(dim[ids], sign[ids], DIMS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    p = (v / max(1e-12, np.sqrt(v @ v))) @ project
    return 1 / (1 + np.exp(-1.702 * p))  # close to the normal distribution function


def hilbert_keys(cells):
    """Hilbert index of points with BITS-bit coordinates; rows are points. (Skilling's transform.)"""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in reversed(range(BITS)):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenise(docs, vocabulary, ranks, vocabulary_size):
    width = np.uint16 if vocabulary_size <= 1 << 16 else np.uint32

    def scan(batches):
        encode, tables = encoder(vocabulary, ranks), _projection(vocabulary_size)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                packed, counts, where = [], [], []
                for text in part.column(2).to_pylist():
                    ids = np.array([*encode(text or ""), END_ID], width)
                    packed.append(ids.tobytes())
                    counts.append(len(ids))
                    where.append(points(ids, tables))
                cells = np.minimum(np.array(where) * (1 << BITS), (1 << BITS) - 1)
                spread = part.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - SPREAD_BITS)
                key = (hilbert_keys(cells) << SPREAD_BITS) | spread.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(key), pa.array(np.array(counts, np.int64)), pa.array(packed, pa.binary())],
                    names=["doc_id", "key", "n", "ids"])

    return docs.mapInArrow(tidy(scan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n long, ids binary")


def _ranges(tokens, id_bytes):
    """Lowest key of each range and the number of tokens before it, from the written narrow keys."""
    spark = tokens.sparkSession
    narrow = tokens.select("key", "n")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * id_bytes // RANGE_BYTES))
    sorted_keys = cut(narrow.repartitionByRange(wanted, "key").withColumn("p", F.spark_partition_id()))
    found = sorted_keys.groupBy("p").agg(F.min("key").alias("low"), F.sum("n").alias("n")).orderBy("low").collect()
    drop_cut(sorted_keys)  # one row per RANGE_BYTES of ids came back
    lows = np.array([r["low"] for r in found], np.int64)
    before = np.concatenate([[0], np.cumsum([r["n"] for r in found], dtype=np.int64)])[:-1]
    return lows, before


def pack(df, vocabulary, ranks, vocabulary_size=50_257, length=2048, text="text", doc_id="doc_id"):
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document's ids followed by END_ID lie in its pieces in order; sequences hold `length` ids, the last one fewer.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("_text"))
    tokens = cut_packed(_tokenise(docs, vocabulary, ranks, vocabulary_size))
    width = np.dtype(np.uint16 if vocabulary_size <= 1 << 16 else np.uint32)
    lows, before = _ranges(tokens, width.itemsize)
    shared = spark.sparkContext.broadcast((lows, before))  # two numbers per RANGE_BYTES of ids
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            rng = np.searchsorted(shared.value[0], batch.column(1).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rng.astype(np.int32))],
                                             names=["doc_id", "key", "n", "ids", "rng"])

    placed = tokens.mapInArrow(tidy(place), f"doc_id {id_type}, key long, n long, ids binary, rng int")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut_up(table):
        keys, packed = table.column("key").to_numpy(), table.column("ids").to_pylist()
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], packed[i], ids[i] is None, ids[i]))
        rng = table.column("rng")[0].as_py()
        at = int(shared.value[1][rng])
        out = [[] for _ in names]
        for i in order:
            flat = np.frombuffer(packed[i], width)
            start = 0
            while start < len(flat):
                offset = at % length
                take = min(length - offset, len(flat) - start)
                row = (ids[i], start, take, len(flat), at // length, offset, flat[start:start + take].astype("<u4").tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                start += take
                at += take
        types = [table.schema.field("doc_id").type, *[pa.int64()] * 5, pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    schema = f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.groupBy("rng").applyInArrow(cut_up, schema)
