"""Proportional stratified interleaving. Built-in functions only.

Rows of each source are put into a seeded random order; row r of n gets the fractional rank (r + 1/2) / n. Sorted
by that rank, every stretch of the order holds the sources in the proportion of the whole, so cutting it into
equal counts gives shards that match the mixture to within a row or so per source.

Both rankings are exact and have two levels, buckets and ranks inside a bucket, so that a source with a third of
all rows is spread over as many tasks as any other rows. Rows equal in every column are counted first and
numbered, so copies of one row are spread as well.

Defined cases: a null source is a source of its own; null ids and repeated rows take part like any other row; an
empty table gives no rows. The result depends on the rows, seed and shard count only, not on how files are split.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.llm.common import cut

ROWS_PER_BUCKET = 50_000
COPIES_PER_BLOCK = 10_000


def _ranked(df, keys, bucket, order, name):
    """Exact 0-based rank over (keys, order); `bucket` must not decrease along `order`."""
    tagged = df.withColumn("_b", bucket)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"),
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    numbered = tagged.withColumn("_r", inside)
    return (
        numbered.join(offsets, same).withColumn(name, F.col("_off") + F.col("_r") - 1)
        .drop("_b", "_kb", "_off", "_r", *[f"_k{i}" for i in range(len(keys))])
    )


def stratified_shards(rows, source="source", shards=24, seed=7, rows_per_bucket=ROWS_PER_BUCKET):
    """All rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Law: shard sizes in rows are at most one apart. `rows` should be narrow (ids, source, sizes), since it is
    shuffled four times and grouped by all its columns; texts are joined to the result by id.
    """
    spark = rows.sparkSession
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}  # the caller's names cannot clash with ours
    src = names[source]
    base = rows.toDF(*names.values())
    cols = base.columns
    counted = base.groupBy(*cols).agg(F.count(F.lit(1)).alias("_m"))
    blocks = counted.withColumn("_blk", F.explode(F.sequence(F.lit(0), ((F.col("_m") - 1) / COPIES_PER_BLOCK).cast("long"))))
    blocks = blocks.repartition(*cols, "_blk")
    last = F.least(F.col("_m"), (F.col("_blk") + 1) * COPIES_PER_BLOCK) - 1
    each = blocks.withColumn("_copy", F.explode(F.sequence(F.col("_blk") * COPIES_PER_BLOCK, last)))
    each = each.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols, "_copy"), 1)).drop("_m", "_blk")
    each = cut(each)

    total = each.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_bucket))
    bits = max(1, (wanted - 1).bit_length())
    order = ["_u", *cols, "_copy"]
    in_source = _ranked(each, [src], F.shiftright("_u", 63 - bits), order, "_rank")
    sizes = each.groupBy(F.col(src).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    share = in_source.join(sizes, F.col(src).eqNullSafe(F.col("_src"))).drop("_src")
    share = share.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_n")).drop("_rank", "_n")
    placed = _ranked(share, [], F.floor(F.col("_f") * (1 << bits)), ["_f", src, *order], "_p")

    shard = F.expr(f"_p * {shards} div {max(total, 1)}")
    out = placed.withColumn("_shard", shard)
    start = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return out.select(*[F.col(v).alias(k) for k, v in names.items() if k not in ("shard", "slot")],
                      F.col("_shard").cast("int").alias("shard"), (F.col("_p") - start).cast("long").alias("slot"))


def write_shards(placed, path):
    """One folder per shard, rows in slot order inside each file."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
