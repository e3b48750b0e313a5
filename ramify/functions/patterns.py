"""Plan-building blocks shared by the operators.

They keep one very large image from becoming one very large task: windows run over
blocks with a halo, ranks and quantiles in two levels, range joins over buckets.
"""

import atexit
import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ramify.functions.scalars import idiv

TILE = 256
_local_dirs, _made = {}, {}


# ---- cutting lineage -------------------------------------------------------

def scratch_root(spark):
    """The shared folder named by spark.checkpoint.dir.

    A machine-local folder is used only where that is unset and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="ramify-")
    return _local_dirs[app]


def scratch_path(spark, label="t"):
    """A new path in the scratch folder; what is written there goes when the driver's process ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made[path] = spark
    return path


def _delete(spark, path):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _clear():
    """Runs before the gateway to the JVM closes; a folder that cannot be reached any more is left."""
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001
            return
    _made.clear()


def cut(df, retire=None):
    """Write df once to the shared folder and go on from the written table.

    `retire` names an earlier cut that nothing reads any more; its files are dropped.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if retire is not None:
        drop_cut(retire)
    return out


def drop_cut(df):
    path = getattr(df, "_cut_path", None)
    if path:
        _made.pop(path, None)
        _delete(df.sparkSession, path)


# ---- neighbourhoods and buckets -------------------------------------------

def neighbourhood(df, radius, y="y", x="x"):
    """Every pixel within Chebyshev distance `radius`, as rows (adds dy, dx)."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    return (
        df.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
        .withColumn(y, F.col(y) + F.col("dy")).withColumn(x, F.col(x) + F.col("dx"))
    )


def interval_buckets(df, lo, hi, size, name="bucket"):
    """One row per bucket of `size` that the closed interval [lo, hi] touches."""
    return df.withColumn(name, F.explode(F.sequence(idiv(F.col(lo), size), idiv(F.col(hi), size))))


def halo_tiles(pixel, reach, *, tile=TILE):
    """Each pixel in its own tile and in the tiles whose border it is within `reach` of (ty, tx)."""
    def span(axis):
        first = F.greatest(F.lit(0).cast("long"), idiv(F.col(axis) - reach, tile))
        return F.explode(F.sequence(first, idiv(F.col(axis) + reach, tile)))
    return pixel.withColumn("ty", span("y")).withColumn("tx", span("x"))


def blocked(df, pos, size, before=0, after=0):
    """Split an ordered axis into blocks that overlap by a halo.

    A window over (keys, blk) then sees, for every row with `own`, all rows from
    pos - before to pos + after, however long the axis is.
    """
    first = F.greatest(F.lit(0).cast("long"), idiv(F.col(pos) - F.lit(after), size))
    last = idiv(F.col(pos) + F.lit(before), size)
    return (
        df.withColumn("blk", F.explode(F.sequence(first, last)))
        .withColumn("own", F.col("blk") == idiv(F.col(pos), size))
    )


def spread(df, *cols):
    """df by the hash of `cols` in as many partitions as the session shuffles into, which adaptive execution leaves apart.

    For rows that grow behind the shuffle: merged by their size before it, they would be too much for one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def two_level_rank(df, keys, bucket, order, name, start=0):
    """row_number over (keys, order), counted per bucket and then offset.

    `bucket` must not decrease along `order`, so no task holds a whole key. The ranked rows stay in many partitions.
    """
    tagged = spread(df.withColumn("_bkt", bucket), *keys, "_bkt")
    before = W.partitionBy(*keys).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.withColumn("_bkt", bucket).groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_bkt").orderBy(*order))
    return (
        tagged.join(offsets, [*keys, "_bkt"])
        .withColumn(name, (F.col("_off") + inside - 1 + start).cast("int"))
        .drop("_bkt", "_off")
    )


def ordered_bits(col):
    """A LONG that orders like the double it comes from (0.0 and -0.0 alike, NaN last)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), col.cast("double") + 0.0).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def from_ordered_bits(col):
    bits = F.when(col < 0, col.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(col)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_quantiles(df, keys, value, probs):
    """Exact linear-interpolated quantiles: columns q0, q1, ... and n per key; null values do not count.

    Radix selection on the 64 bits of the values, 16 at a time: each level counts one digit of the rows that share all digits
    found so far and goes on with the digit that holds the wanted rank. Rows are combined before every shuffle, to 65,536
    digits a key and prefix at most, so neither a hot key nor equal values gather anywhere.
    """
    rows = cut(df.filter(F.col(value).isNotNull()).select(*keys, ordered_bits(F.col(value)).alias("_b")))
    at = [*keys, "_p"]
    found, shift = None, 64
    while shift:
        shift -= 16
        digit = F.shiftright("_b", shift)
        if found is None:
            inside = rows.withColumn("_p", F.lit(0).cast("long"))
        else:
            inside = salted_join(rows.withColumn("_p", F.shiftright("_b", shift + 16)), found.select(*at).distinct(), at,
                                 F.col("_b"), how="left_semi")
        counts = inside.groupBy(*at, digit.alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        before = W.partitionBy(*at).orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
        whole = [F.sum("_c").over(W.partitionBy(*at)).alias("n")] if found is None else []
        counts = counts.select(*at, "_d", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), *whole)
        if found is None:
            wanted = F.array(*[
                F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                         (F.floor if side == 0 else F.ceil)((F.col("n") - 1) * F.lit(float(p))).alias("rank"))
                for i, p in enumerate(probs) for side in (0, 1)])
            found = counts.select("*", F.explode(wanted).alias("_w")).select("*", "_w.i", "_w.side", "_w.rank").drop("_w")
        else:
            found = counts.join(found, at)
        rank = F.col("rank") - F.col("_off")
        found = found.filter((rank >= 0) & (rank < F.col("_c"))).select(*keys, F.col("_d").alias("_p"), "n", "i", "side", rank.alias("rank"))
    found = found.withColumn("_v", from_ordered_bits(F.col("_p")))
    cells = [F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("_v"))).alias(f"_q{i}_{side}")
             for i in range(len(probs)) for side in (0, 1)]
    out = found.groupBy(*keys).agg(F.max("n").alias("n"), *cells)
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_q{i}_0"), F.col(f"_q{i}_1")
        picks.append((lo + (hi - lo) * (h - F.floor(h))).alias(f"q{i}"))
    return out.select(*keys, "n", *picks)


BROADCAST_ROWS = 100_000


def sorted_side(df):
    """A side of a join that must not be broadcast: pixels, points and ends, whose rows Spark takes from the bytes of packed files
    or from what they were exploded from, and would gather in the driver."""
    return df.hint("merge")


def hashed_side(df):
    """A narrow side of a join, few rows a key, that is neither broadcast nor sorted: the other side is not sorted either."""
    return df.hint("shuffle_hash")


def salted_join(big, small, on, spread, how="inner", salts=16):
    """Join a side with hot keys to a side that is unique on `on`.

    The unique side is repeated per salt; `spread` is any well-distributed column of the big side. The repeated side is
    never broadcast: Spark would judge it by the bytes of the files it comes from, which say nothing of its rows.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(sorted_side(right), [*on, "_salt"], how).drop("_salt")


# ---- graphs ----------------------------------------------------------------

def components(edges, key="image_id", a="a", b="b"):
    """Connected components of an undirected edge list of LONG nodes within `key`.

    Randomised contraction: in every round each node joins the closed neighbour with the
    least hash, and the graph of those representatives replaces the graph. It shrinks by a
    constant factor per round, long paths included. Returns (key, node, root) for nodes with edges.
    """
    both = edges.select(key, a, b).union(edges.select(key, F.col(b).alias(a), F.col(a).alias(b)))
    graph = cut(both.filter(F.col(a) != F.col(b)).distinct())
    maps, rnd = [], 0
    while left := graph.count():
        side = sorted_side if left > BROADCAST_ROWS else lambda df: df
        rnd += 1
        prio = lambda c: F.struct(F.xxhash64(F.lit(rnd), c).alias("h"), c.alias("n"))
        step = (
            graph.groupBy(key, a).agg(F.min(prio(F.col(b))).alias("best"))
            .select(key, F.col(a).alias("node"),
                    F.least(F.col("best"), prio(F.col(a)))["n"].alias("root"))
        )
        step = cut(step)
        maps.append((step, side))
        after = (
            graph.join(side(step.select(key, F.col("node").alias(a), F.col("root").alias("ra"))), [key, a])
            .select(key, "ra", b)
            .join(side(step.select(key, F.col("node").alias(b), F.col("root").alias("rb"))), [key, b])
            .filter("ra <> rb").select(key, F.col("ra").alias(a), F.col("rb").alias(b)).distinct()
        )
        graph = cut(after, retire=graph)
    if not maps:
        return graph.select(key, F.col(a).alias("node"), F.col(a).alias("root"))
    # Compose from the last (smallest) round back, so that no join key is a whole component.
    total = maps[-1][0]
    for step, side in reversed(maps[:-1]):
        later = total.select(key, F.col("node").alias("root"), F.col("root").alias("final"))
        total = (
            step.join(side(later), [key, "root"], "left")
            .select(key, "node", F.coalesce("final", "root").alias("root"))
        )
    return total
