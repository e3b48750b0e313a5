"""Exact de-duplication through an extendible-hash index on shared files. Built-in functions only.

1. Entries. Texts are grouped by (64-bit hash, normalised bytes): the grouping compares the bytes, so two
   texts that share a hash stay two entries. Copies are combined before the shuffle, so a text that a third
   of all rows carry sends one row per task.
2. Directory. Entries are counted by hash prefix; every bucket over `capacity` is split by one more bit of the
   hash until it fits, which doubles the directory where needed.
3. Index files. Owner tasks, one per range of buckets, chain the entries of one hash value and write the index
   (bucket, local depth, hash, chain position, digest, keep id, group size) to the shared folder.
4. Look-up. Rows meet their entry by hash and digest; the row with the largest id stays.

Defined cases: a null text counts as empty, and all empty texts are one group. A null id is below every other
id; where a group has null ids only, one of its rows stays. Of rows equal in id and text one stays, no matter
which. Other columns are carried along untouched, whatever their names. An empty table gives an empty result.
"""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.llm.common import cut, lower_ascii

CAPACITY = 50_000
TIE_SALTS = 64


def hashed(df, text="text", h="h", sha="sha", norm=None):
    """df with the normalised text's 64-bit hash and SHA-256 (and the text itself under `norm`)."""
    low = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    kept = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*kept, low.alias(norm or "_norm"))
    out = out.withColumn(h, F.xxhash64(norm or "_norm")).withColumn(sha, F.sha2(norm or "_norm", 256))
    return out if norm else out.drop("_norm")


def entries(df, text="text", doc_id="doc_id"):
    """One row per distinct text: h, sha, n_bytes, keep_id, group_size."""
    low = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(doc_id).alias("id"), low.alias("norm")).withColumn("h", F.xxhash64("norm"))
    return (
        rows.groupBy("h", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("n_bytes"), "keep_id", "group_size")
    )


def directory(entry, n_entries, capacity=CAPACITY):
    """Bucket and local depth of every prefix of the finest depth: columns slot, bucket, depth.

    A bucket is a hash prefix of `depth` bits, written with zeros up to the finest depth. Prefixes are counted
    once; a bucket over `capacity` is split by its next bit until it fits or the finest depth is reached,
    64 times finer than an even spread would need.
    """
    finest = 6
    while (n_entries >> (finest - 6)) > capacity:
        finest += 1
    counts = entry.groupBy(F.shiftrightunsigned("h", 64 - finest).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    depth = F.lit(finest)
    for d in reversed(range(finest)):
        prefix = F.shiftright("slot", finest - d)
        total = F.sum("n").over(W.partitionBy(prefix))
        counts = counts.withColumn(f"n{d}", total)
        depth = F.when(F.col(f"n{d}") <= capacity, d).otherwise(depth)
    fine = counts.withColumn("depth", depth)
    shift = F.lit(finest) - F.col("depth")
    bucket = F.expr(f"shiftleft(shiftright(slot, {finest} - depth), {finest} - depth)")
    return fine.select("slot", bucket.alias("bucket"), F.col("depth").cast("int").alias("depth"), shift.alias("shift")), finest


def build_index(df, text="text", doc_id="doc_id", capacity=CAPACITY):
    """The index of all texts of df, written to the shared folder; returns it as a table."""
    entry = cut(entries(df, text, doc_id))
    buckets, finest = directory(entry, entry.count(), capacity)
    owned = (
        entry.withColumn("slot", F.shiftrightunsigned("h", 64 - finest))
        .join(buckets.select("slot", "bucket", "depth"), "slot")
        .repartitionByRange(F.col("bucket"), F.col("h"))
    )
    chain = W.partitionBy("h").orderBy("n_bytes", "sha")
    index = owned.withColumn("chain", F.row_number().over(chain) - 1)
    return cut(index.select("bucket", "depth", "h", "chain", "sha", "n_bytes", "keep_id", "group_size"), retire=entry)


def one_of(df, keys, spread, where, tag):
    """df with helper columns, and the condition that leaves one row per `keys` of those that satisfy `where`.

    Rows are ranked per salt first and then over the salts' winners, so that no task sees all copies of a row.
    """
    salt, rank, last = (f"_{c}_{tag}" for c in ("salt", "rank", "last"))
    salted = df.withColumn(salt, F.when(where, F.spark_partition_id() % TIE_SALTS)
                           .otherwise(-1 - F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")))
    ranked = salted.withColumn(rank, F.row_number().over(W.partitionBy(*keys, salt).orderBy(F.lit(1))))
    ranked = ranked.withColumn(last, F.when((F.col(salt) >= 0) & (F.col(rank) == 1), -1).otherwise(F.col(salt) + 1))
    ranked = ranked.withColumn(f"{rank}2", F.row_number().over(W.partitionBy(*keys, last).orderBy(rank)))
    return ranked, (F.col(last) == -1) & (F.col(f"{rank}2") == 1)


def exact_groups(df, text="text", doc_id="doc_id", capacity=CAPACITY):
    """df's rows with keep_id, group_size, kept and text_sha256 of their group of equal texts.

    Texts are equal when identical after lower-casing A-Z only. Columns of df with these names are replaced.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    index = build_index(df, text, doc_id, capacity)
    tag = uuid.uuid4().hex[:8]
    names = {k: f"_{k}_{tag}" for k in ("h", "sha", "keep", "size")}
    rows = df.select([F.col(f"`{c}`") for c in df.columns if c not in added])
    rows = hashed(rows, text, names["h"], names["sha"])
    found = rows.join(
        index.select(F.col("h").alias(names["h"]), F.col("sha").alias(names["sha"]),
                     F.col("keep_id").alias(names["keep"]), F.col("group_size").alias(names["size"])),
        [names["h"], names["sha"]])
    kept = F.col(doc_id).eqNullSafe(F.col(names["keep"]))
    if not df.groupBy(doc_id).count().filter("count > 1").isEmpty():
        found, kept = one_of(found, [names["h"], names["sha"], doc_id], doc_id, kept, tag)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in added]
    return found.select(*rest, F.col(names["keep"]).alias("keep_id"), F.col(names["size"]).alias("group_size"),
                        kept.alias("kept"), F.col(names["sha"]).alias("text_sha256"))


def drop_copies(df, text="text", doc_id="doc_id", capacity=CAPACITY):
    """df without copies: of equal texts the row with the largest id stays. Columns as in df."""
    flag = f"_kept_{uuid.uuid4().hex[:8]}"
    clash = [c for c in df.columns if c in ("keep_id", "group_size", "kept", "text_sha256")]
    aside = {c: f"{flag}_{i}" for i, c in enumerate(clash)}
    rows = df.withColumnsRenamed(aside)
    out = exact_groups(rows, aside.get(text, text), aside.get(doc_id, doc_id), capacity)
    out = out.filter("kept").drop("keep_id", "group_size", "kept", "text_sha256")
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select([F.col(f"`{c}`") for c in df.columns])
