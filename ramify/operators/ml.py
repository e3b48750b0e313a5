"""Table learning: scaling, components, the fragment classifier and its evaluation."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ramify.functions.patterns import cut, scratch_path
from ramify.operators import forest

CLASSIFIER_FEATURES = [
    "orientation", "horizontal_likely", "relative_y", "relative_x", "quat_filter",
    "curvature", "tortuosity", "local_density", "average_intensity",
]
SEED = 42


# ---- scaling and principal components --------------------------------------

def standardize(df, columns):
    """z-scores with the population SD; constant columns become 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    z = [(((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])) if stats[f"s_{c}"]
          else F.lit(0.0)).alias(c) for c in columns]
    return df.select(*[c for c in df.columns if c not in columns], *z)


class Components:
    """Principal components of standardised features.

    Rows with a NULL feature are left out. Each component is signed so that its loading of
    greatest magnitude is positive.
    """

    def __init__(self, df, columns, k=2):
        self.columns, self.k = list(columns), k
        z = standardize(df.dropna(subset=self.columns), self.columns)
        self._rows = VectorAssembler(inputCols=self.columns, outputCol="_z").transform(z)
        self._model = PCA(k=k, inputCol="_z", outputCol="_pc").fit(self._rows)
        self._pc = self._model.pc.toArray()
        self._sign = [1.0 if abs(col.max()) >= abs(col.min()) else -1.0 for col in self._pc.T]

    def scores(self, keys=("image", "genotype")):
        """Scores beside the keys they belong to; nothing is matched by position."""
        pc = vector_to_array("_pc")
        return self._model.transform(self._rows).select(
            *keys, *[(pc[i] * self._sign[i]).alias(f"PC_{i + 1}") for i in range(self.k)])

    def explained_variance(self):
        spark = self._rows.sparkSession
        rows = [(f"PC_{i + 1}", float(v)) for i, v in enumerate(self._model.explainedVariance.toArray())]
        return spark.createDataFrame(rows, "component string, ratio double")

    def loadings(self):
        """Component entries times the root of the component's variance, one row per feature."""
        spark = self._rows.sparkSession
        total = self._rows.agg(*[F.var_samp(c) for c in self.columns]).first()
        variance = sum(v or 0.0 for v in total)
        ratio = self._model.explainedVariance.toArray()
        rows = [(c, *[float(self._pc[j, i] * self._sign[i] * math.sqrt(ratio[i] * variance)) for i in range(self.k)])
                for j, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "feature string, " + ", ".join(f"PC_{i + 1} double" for i in range(self.k)))


# ---- fragment classifier ---------------------------------------------------

def feature_vector(df, columns=CLASSIFIER_FEATURES, *, fill=0.0):
    """The nine inputs in their fixed order as one vector.

    A missing input (NULL or NaN: no pixel under a fragment, no chord) counts as `fill`, so a fragment
    without a measure is classified by its others and never ends a job.
    """
    cast = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(fill))) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(cast)


def split_80_20(df, key, *, share=0.2):
    """Adds `is_test`; decided by a hash of the key, so it does not move with partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in key])), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", h < F.lit(int(share * (1 << 32))))


def bounded_sample(df, key, rows, seed=SEED):
    """At most `rows` rows (None: all), those whose `key` has the least hashes."""
    if rows is None:
        return df
    ranked = df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).orderBy("_h", *key)
    return cut(ranked.limit(rows).drop("_h"))


GROWN_ROWS = 10_000  # labelled rows up to which the forest is Spark's own


def _features_of(df):
    known = df.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    return known or len(df.select("features").first()[0])


def forest_train(df, *, label="label", trees=100, depth=30, seed=SEED, weight=None, key=None, max_labelled_rows=None):
    """Random forest on `features`; the square root of the features is tried per split.

    All rows are fitted. `max_labelled_rows` bounds them where a caller wants that: those whose `key` has the least hashes.
    Tables beyond `GROWN_ROWS` grow tree by tree in tasks of their own (forest.py), with the same rules as Spark's forest.
    """
    df = bounded_sample(df, key, max_labelled_rows, seed)
    size = _features_of(df)
    if not weight and size <= forest.MOST_FEATURES and df.limit(GROWN_ROWS + 1).count() > GROWN_ROWS:
        return forest.train(df, label=label, trees=trees, depth=depth, seed=seed, size=size)
    fitted = RandomForestClassifier(
        featuresCol="features", labelCol=label, predictionCol="prediction", numTrees=trees,
        maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=True, maxMemoryInMB=1024)
    if weight:
        fitted = fitted.setWeightCol(weight)
    return fitted.fit(df.withColumn(label, F.col(label).cast("double")))


SCORED_ROWS = 64
TABLE_BYTES = 1 << 28


def _leaf_sets(model, spark):
    """A forest as sets of leaves: (thresholds per feature, sets per feature, words a tree, shares), or None if it is not of that kind.

    Every tree numbers its leaves from the left, as bits of words. A split that a row does not meet takes out the leaves on its
    left; the leftmost leaf that all splits leave is the row's. `sets[f][b]` is what the splits on feature f leave of all
    trees for a value above b of its thresholds; `shares` holds each leaf's share of classes.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "leftChild", "rightChild", "impurityStats", F.col("split.featureIndex").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("kinds")).collect()
    trees = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    if any(r["leftChild"] >= 0 and r["kinds"] != -1 for r in rows):
        return None
    leaves, splits = [], []  # stats of the leaves; (feature, threshold, first leaf, one past the last on the left)
    for t in range(len(trees)):
        nodes, mine, todo, opened = trees[t], [], [(0, False)], {}
        while todo:
            at, left_done = todo.pop()
            node = nodes[at]
            if left_done:
                splits.append((node["feature"], node["cut"][0], t, opened[at], len(mine)))
            elif node["leftChild"] < 0:
                mine.append(node["impurityStats"])
            else:
                opened[at] = len(mine)
                todo += [(node["rightChild"], False), (at, True), (node["leftChild"], False)]
        leaves.append(mine)
    words = -(-max(map(len, leaves)) // 64)
    cuts = [np.unique([c for f, c, *_ in splits if f == k]) for k in range(model.numFeatures)]
    if sum(len(c) + 1 for c in cuts) * len(leaves) * words * 8 > TABLE_BYTES:
        return None
    sets = [np.full((len(c) + 1, len(leaves), words * 64), True) for c in cuts]
    for f, c, t, first, end in splits:
        sets[f][np.searchsorted(cuts[f], c) + 1, t, first:end] = False
    # the first words of all trees side by side, then the second ones
    packed = lambda on: np.ascontiguousarray(np.packbits(on, axis=-1, bitorder="little").view("<u8").transpose(0, 2, 1)).reshape(len(on), -1)
    shares = np.zeros((len(leaves), words * 64, model.numClasses))
    for t, mine in enumerate(leaves):
        for k, stats in enumerate(mine):
            total = sum(stats)
            shares[t, k] = np.array(stats) / total if total else 0.0
    return cuts, [packed(np.logical_and.accumulate(on, axis=0)) for on in sets], words, shares


def _votes(x, cuts, sets, words, shares):
    """Sums of the shares of the leaves that rows of features fall into, tree after tree."""
    places = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    leaf = np.zeros((len(x), len(shares)), np.int64)
    for at in range(0, len(x), SCORED_ROWS):
        part = slice(at, at + SCORED_ROWS)
        left = sets[0][places[0][part]]
        for table, place in zip(sets[1:], places[1:]):
            left &= table[place[part]]
        left = left.reshape(len(left), words, len(shares))
        bits, word = left[:, -1].copy(), np.full(left[:, 0].shape, words - 1)
        for w in range(words - 2, -1, -1):
            here = left[:, w] != 0
            np.copyto(bits, left[:, w], where=here)
            np.copyto(word, w, where=here)
        leaf[part] = word * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))
    out = np.zeros((len(x), shares.shape[2]))
    for t in range(len(shares)):
        out += shares[t, leaf[:, t]]
    return out


def forest_predict(model, df):
    """The forest's votes, shares and class of every row, as its own `transform` gives them.

    Scored in batches by sets of leaves, each tree in a few words a feature instead of a walk from node to node; forests too
    large for such tables, or with splits on categories, are walked. Trees grown by forest.py walk whole batches themselves.
    """
    if isinstance(model, forest.Forest):
        voted = model.votes(df)
    else:
        spark = df.sparkSession
        found = _leaf_sets(model, spark)
        if found is None:
            return model.transform(df).withColumn("dendrite_type", F.col("prediction").cast("int"))
        shared = spark.sparkContext.broadcast(found)

        @F.pandas_udf("array<double>")
        def votes(features: pd.Series) -> pd.Series:
            return pd.Series(list(_votes(np.stack(features.to_numpy()), *shared.value)) if len(features) else [])

        voted = df.withColumn("_votes", votes(vector_to_array("features")))
    total = F.aggregate("_votes", F.lit(0.0), lambda s, v: s + v)
    scored = voted.withColumn("_total", total)
    return scored.select(
        *df.columns, array_to_vector("_votes").alias("rawPrediction"),
        array_to_vector(F.transform("_votes", lambda v: F.when(F.col("_total") == 0, v).otherwise(v / F.col("_total")))).alias("probability"),
        (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias("prediction")).withColumn(
        "dendrite_type", F.col("prediction").cast("int"))


def feature_importance(model, spark, columns=CLASSIFIER_FEATURES):
    rows = list(zip(columns, map(float, model.featureImportances.toArray())))
    return importance_rank(spark.createDataFrame(rows, "feature string, importance double"))


def importance_rank(df):
    return df.orderBy(F.desc("importance"), "feature")


def save_model(model, path):
    if isinstance(model, forest.Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path):
    return forest.Forest.saved(path) or RandomForestClassificationModel.load(path)


# ---- evaluation ------------------------------------------------------------

def class_distribution(df, label="label"):
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def confusion_matrix(df, *, true="true_type", predicted="predicted_type", classes=(1, 2, 3, 4)):
    """Counts of true by predicted class, predicted ones as columns p1, p2, ..."""
    return df.groupBy(true).agg(*[F.count_if(F.col(predicted) == c).alias(f"p{c}") for c in classes])


def accuracy(df, *, true="true_type", predicted="predicted_type", length="length"):
    """Share of fragments, and of length, with the right class."""
    right = F.col(true) == F.col(predicted)
    return df.agg(
        F.avg(right.cast("double")).alias("accuracy"),
        (F.sum(F.when(right, F.col(length)).otherwise(0)) / F.sum(length)).alias("weighted_accuracy"))


def classification_report(df, *, true="true_type", predicted="predicted_type"):
    """precision, recall, f1 and support per class, then accuracy, macro and weighted rows."""
    hit = F.col(true) == F.col(predicted)
    per = (
        df.select(F.explode(F.array(
            F.struct(F.col(true).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.cast("int").alias("h")),
            F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("r"))
        .groupBy(F.col("r.c").alias("c"))
        .agg(F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.h").alias("hits"))
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = (
        per.withColumn("precision", zero("hits", "predicted")).withColumn("recall", zero("hits", "support"))
        .withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    cols = ["precision", "recall", "f1"]
    acc = F.sum("hits") / F.sum("support")
    return (
        per.select(F.col("c").cast("string").alias("label"), *cols, "support")
        .unionByName(per.agg(*[acc.alias(c) for c in cols], F.sum("support").alias("support")).withColumn("label", F.lit("accuracy")))
        .unionByName(per.agg(*[mean(c) for c in cols], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg")))
        .unionByName(per.agg(*[weighted(c) for c in cols], F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg")))
    )


# ---- balancing -------------------------------------------------------------

CELL_ROWS = 1 << 15
LEAF_ROWS = 512
SAMPLED_ROWS = 1 << 18
ASKED_ROWS = 50_000


def _matrix(column):
    """A list column of a batch as rows of a matrix; 0.0 and -0.0 are one value."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) + 0.0 if len(column) else np.zeros((0, 1))


def _vectors(x):
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _cut_of(x):
    """Widest feature of some vectors and a value of it that leaves some of them below and some not; None if all are equal."""
    lo, hi = np.fmin.reduce(x), np.fmax.reduce(x)
    axis = int(np.nanargmax(hi - lo)) if not np.isnan(hi - lo).all() else 0
    if not hi[axis] > lo[axis]:
        return None
    v = np.sort(x[:, axis][~np.isnan(x[:, axis])])
    middle = v[len(v) // 2]
    return axis, float(middle if middle > v[0] else v[np.searchsorted(v, v[0], "right")])


class _Tree:
    """Cuts of the classes' vectors: inner nodes have an axis and a value, leaves are the cells."""

    def __init__(self, labels):
        self.roots = {label: i for i, label in enumerate(labels)}
        self.axis, self.value, self.low = ([-1] * len(labels) for _ in range(3))

    def _split(self, node, axis, value):
        self.axis[node], self.value[node], self.low[node] = axis, value, len(self.axis)
        for column in (self.axis, self.value, self.low):
            column += [-1, -1]

    def grow(self, node, x, weight, most):
        """Cut a leaf by a sample of its rows, each of which stands for `weight` ones, until the cells have `most`."""
        todo = [(node, x)]
        while todo:
            at, x = todo.pop()
            found = _cut_of(x) if len(x) * weight > most and len(x) > 1 else None
            if found:
                self._split(at, *found)
                over = x[:, found[0]] >= found[1]
                todo += [(self.low[at], x[~over]), (self.low[at] + 1, x[over])]

    def halve(self, node, lo, hi):
        """Cut a leaf in the middle of its box, where the sample tells nothing of it."""
        axis = int(np.nanargmax(np.where(hi > lo, hi - lo, 0.0)))
        middle = (lo[axis] + hi[axis]) / 2
        self._split(node, axis, middle if middle > lo[axis] else hi[axis])

    def packed(self):
        return self.roots, np.array(self.axis), np.array(self.value, float), np.array(self.low)


def _cells_of(tree, labels, x):
    """The cell of every row."""
    roots, axis, value, low = tree
    at = np.array([roots[c] for c in labels.tolist()], np.int64)
    inner = np.flatnonzero(axis[at] >= 0)
    while len(inner):
        n = at[inner]
        at[inner] = low[n] + (x[inner, axis[n]] >= value[n])
        inner = inner[axis[at[inner]] >= 0]
    return at


def _boxes(rows, tree):
    """Per cell its rows and asked rows and its box, as tight as its rows; one row a task and cell goes to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def scan(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            cell = _cells_of(shared.value, batch.column(0), x)
            order = np.argsort(cell, kind="stable")
            cell, x = cell[order], x[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            if total is None:
                size = len(shared.value[1])
                total = np.zeros((2, size), np.int64), np.full((size, x.shape[1]), np.nan), np.full((size, x.shape[1]), np.nan)
            count, lo, hi = total
            c = cell[first]
            count[0, c] += np.diff(np.append(first, len(cell)))
            count[1, c] += np.add.reduceat((batch.column(2).to_numpy() > 0).astype(np.int64)[order], first)
            lo[c], hi[c] = np.fmin(lo[c], np.fmin.reduceat(x, first)), np.fmax(hi[c], np.fmax.reduceat(x, first))
        if total is not None:
            count, lo, hi = total
            c = np.flatnonzero(count[0])
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(count[0, c]), pa.array(count[1, c]), _vectors(lo[c]), _vectors(hi[c])],
                                             names=["cell", "n", "asked", "lo", "hi"])

    found = rows.select("label", "vec", "times").mapInArrow(scan, "cell long, n long, asked long, lo array<double>, hi array<double>")
    size = len(rows.select("vec").first()["vec"])
    side = lambda f, c: F.array(*[f(F.nanvl(F.get(c, F.lit(i)), F.lit(None))) for i in range(size)])
    return found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"), side(F.min, "lo").alias("lo"), side(F.max, "hi").alias("hi"))


def _grown(rows, cell_rows):
    """A tree over (label, vec, times) whose cells have at most `cell_rows` rows that are not all equal, and its boxes in the driver.

    Its cuts come from at most SAMPLED_ROWS rows at a time; all rows are counted, and cells that are still too large are cut again.
    The driver holds the sample and a box a cell, some 150 bytes for thousands of rows.
    """
    tree = _Tree([r["label"] for r in rows.select("label").distinct().collect()])
    while True:
        packed = tree.packed()
        boxes = {r["cell"]: (r["n"], r["asked"], np.array(r["lo"], float), np.array(r["hi"], float)) for r in _boxes(rows, packed).collect()}
        large = {c: b for c, b in boxes.items() if b[0] > cell_rows and (b[3] > b[2]).any()}
        if not large:
            return tree, boxes
        total = sum(b[0] for b in large.values())
        share = min(1.0, 0.9 * SAMPLED_ROWS / total)
        shared, wanted = rows.sparkSession.sparkContext.broadcast(packed), np.array(sorted(large))

        def inside(batches):
            for batch in batches:
                if batch.num_rows:
                    cell = _cells_of(shared.value, batch.column(0), _matrix(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "vec"]).filter(pa.array(np.isin(cell, wanted)))

        drawn = rows.select("label", "vec").mapInArrow(inside, "cell long, vec array<double>")
        drawn = (drawn if share == 1 else drawn.sample(share, seed=SEED)).limit(SAMPLED_ROWS).toArrow()
        x, cell = _matrix(drawn.column(1)), drawn.column(0).to_numpy()
        for c, (n, _, lo, hi) in large.items():
            mine = x[cell == c]
            size = len(tree.axis)
            if len(mine):
                tree.grow(c, mine, n / len(mine), cell_rows if share == 1 else cell_rows / 2)
            if len(tree.axis) == size:
                tree.halve(c, lo, hi)


def kd_cells(pool, cell_rows=CELL_ROWS):
    """Cells of at most `cell_rows` distinct vectors over all features, per class: (rows with their cell `path`, [boxes])."""
    rows = pool.withColumn("times", F.lit(1).cast("long"))
    tree, boxes = _grown(rows, cell_rows)
    shared = pool.sparkSession.sparkContext.broadcast(tree.packed())

    @F.pandas_udf("long")
    def path(label: pd.Series, vec: pd.Series) -> pd.Series:
        return pd.Series(_cells_of(shared.value, label.to_numpy(), np.stack(vec.to_numpy())) if len(vec) else np.zeros(0, int))

    box = pool.sparkSession.createDataFrame([(int(c), int(n), lo.tolist(), hi.tolist()) for c, (n, _, lo, hi) in boxes.items()],
                                            "path long, n long, lo array<double>, hi array<double>")
    return pool.withColumn("path", path("label", "vec")), [box]


def _outside(q, lo, hi):
    """Squared distances of vectors to boxes."""
    out = np.zeros((len(q), len(lo)))
    for a in range(q.shape[1]):
        out += np.maximum(0.0, np.maximum(lo[:, a] - q[:, a, None], q[:, a, None] - hi[:, a])) ** 2
    return out


def _close(q, y, k, reach):
    """(i, j, gap) of vectors of y that differ from those of q by at most `reach` (None: by the distance of the k-th that differs)."""
    centre = (np.fmin.reduce(y) + np.fmax.reduce(y)) / 2
    centre[~np.isfinite(centre)] = 0.0
    parts, z = [], y - centre
    length = (z * z).sum(1)
    longest = np.nanmax(length, initial=0.0)
    for at in range(0, len(q), 512):
        w = q[at:at + 512] - centre
        mine = (w * w).sum(1)
        d = mine[:, None] + length[None] - 2 * (w @ z.T)
        off = 1e-12 * (mine + longest)
        if reach is None:  # one more than k, as a vector may find itself
            most = np.partition(d, min(k, len(y) - 1), axis=1)[:, min(k, len(y) - 1)] + 2 * off
            most[np.isnan(most)] = np.inf
        else:
            most = reach[at:at + 512] ** 2 * (1 + 1e-12) + off
        i, j = np.nonzero(d <= most[:, None])
        gap = np.sqrt(((q[at + i] - y[j]) ** 2).sum(1))
        keep = gap > 0
        parts.append((at + i[keep], j[keep], gap[keep]))
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _first(i, j, gap, k):
    """Of the found, the k best of each i, in order of gap, then of vector."""
    order = np.lexsort((j, gap, i))
    i, j, gap = i[order], j[order], gap[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], gap[keep]


def _nearest(q, y, k, reach=None):
    """(i, j, gap): the k nearest others of every q in y, whose rows are distinct and sorted; no farther than `reach`, if given.

    y is cut into leaves; a leaf is looked into by those whose ball touches its box.
    """
    if not len(q) or not len(y):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    leaves, todo = [], [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        found = _cut_of(y[rows]) if len(rows) > LEAF_ROWS else None
        if found is None:
            leaves.append(np.sort(rows))
        else:
            over = y[rows, found[0]] >= found[1]
            todo += [rows[over], rows[~over]]
    lo, hi = (np.stack([f.reduce(y[rows]) for rows in leaves]) for f in (np.fmin, np.fmax))
    parts = []
    for at in range(0, len(q), 4096):
        part = q[at:at + 4096]
        out, found = _outside(part, lo, hi), []
        if reach is None:
            own = np.argmin(out, axis=1)
            most = np.full(len(part), np.inf)
            for leaf in np.unique(own):
                mine = np.flatnonzero(own == leaf)
                i, j, gap = _first(*_close(part[mine], y[leaves[leaf]], k, None), k)
                found.append((mine[i], leaves[leaf][j], gap))
                last = np.flatnonzero(np.bincount(i, minlength=len(mine)) >= k)
                ends = np.searchsorted(i, last, "right") - 1
                most[mine[last]] = gap[ends]
            out[np.arange(len(part)), own] = np.inf
        else:
            most = reach[at:at + 4096]
        touched = (out <= (most ** 2 * (1 + 1e-9))[:, None]) & np.isfinite(out)
        for leaf in np.flatnonzero(touched.any(0)):
            mine = np.flatnonzero(touched[:, leaf])
            i, j, gap = _close(part[mine], y[leaves[leaf]], k, most[mine])
            found.append((mine[i], leaves[leaf][j], gap))
        i, j, gap = _first(*(np.concatenate(f) for f in zip(*found)), k) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        parts.append((at + i, j, gap))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _distinct(x, copies):
    """Distinct rows in order, their copies, and the place of every row among them."""
    order = np.lexsort(x.T[::-1])
    x, c = x[order], copies[order]
    new = np.append(True, (x[1:] != x[:-1]).any(1))[:len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], np.add.reduceat(c, np.flatnonzero(new)) if len(x) else c, place


def _dealt(rows, tree, boxes):
    """Every row to its cell: (path, part, kind, row_id, times, vec, copies).

    Kind 0 are vectors of a cell, equal ones of a batch together; kind 1 are asked rows, with copies where they stand for a vector as well. A cell that many ask is shared out: all its vectors go to every part, each asked row to one.
    """
    parts = np.ones(len(tree.axis), np.int64)
    for c, (_, asked, *_) in boxes.items():
        parts[c] = max(1, -(-asked // ASKED_ROWS))
    shared = rows.sparkSession.sparkContext.broadcast((tree.packed(), parts))

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            packed, parts = shared.value
            x, (row_id, times, copies_of) = _matrix(batch.column(1)), (batch.column(c).to_numpy() for c in (2, 3, 4))
            cell = _cells_of(packed, batch.column(0), x)
            many = parts[cell]
            asked = times > 0
            plain = np.flatnonzero(~asked | (many > 1))
            named = np.column_stack([cell[plain], x[plain]])
            v, copies, _ = _distinct(named, copies_of[plain])
            at = v[:, 0].astype(np.int64)
            again = np.repeat(np.arange(len(v)), parts[at])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
            a = np.flatnonzero(asked)
            none = np.zeros(len(again), np.int64)
            columns = [np.concatenate(c) for c in (
                (at[again], cell[a]), (part, row_id[a] % many[a]), (none, np.ones(len(a), np.int64)), (none, row_id[a]), (none, times[a]))]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), _vectors(np.concatenate([v[again, 1:], x[a]])),
                 pa.array(np.concatenate([copies[again], np.where(many[a] == 1, copies_of[a], 0)]))],
                names=["path", "part", "kind", "row_id", "times", "vec", "copies"])

    return rows.select("label", "vec", "row_id", "times", "copies").mapInArrow(
        deal, "path long, part long, kind long, row_id long, times long, vec array<double>, copies long")


def _met(rows, tree, visits, parts):
    """The vectors (path, part, vec, copies) of visited cells that lie in a box around the balls from one other cell."""
    size = len(tree.axis)
    cells = visits["path"].to_numpy()
    order = np.argsort(cells, kind="stable")
    first = np.searchsorted(cells[order], np.arange(size + 1))
    lo, hi = (_matrix(visits[c])[order] for c in ("lo", "hi"))
    shared = rows.sparkSession.sparkContext.broadcast((tree.packed(), first, lo, hi, parts))

    def meet(batches):
        for batch in batches:
            packed, first, lo, hi, parts = shared.value
            if not batch.num_rows:
                continue
            x, copies = _matrix(batch.column(1)), batch.column(2).to_numpy()
            cell = _cells_of(packed, batch.column(0), x)
            kept = []
            for at in range(0, len(x), 2048):
                mine = cell[at:at + 2048]
                n = first[mine + 1] - first[mine]
                row = np.repeat(np.arange(len(mine)), n)
                box = np.arange(len(row)) + np.repeat(first[mine] - np.cumsum(n) + n, n)
                inside = np.ones(len(row), bool)
                for a in range(x.shape[1]):
                    v = x[at + row, a]
                    inside &= (v >= lo[box, a]) & (v <= hi[box, a])
                kept.append(at + np.unique(row[inside]))
            keep = np.concatenate(kept)
            v, copies, _ = _distinct(np.column_stack([cell[keep], x[keep]]), copies[keep])
            at = v[:, 0].astype(np.int64)
            again = np.repeat(np.arange(len(v)), parts[at])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
            yield pa.RecordBatch.from_arrays([pa.array(at[again]), pa.array(part), _vectors(v[again, 1:]), pa.array(copies[again])],
                                             names=["path", "part", "vec", "copies"])

    return rows.select("label", "vec", "copies").mapInArrow(meet, "path long, part long, vec array<double>, copies long")


_NEAR = pa.list_(pa.struct([("gap", pa.float64()), ("other", pa.list_(pa.float64())), ("copies", pa.int64())]))
_NEAR_DDL = "array<struct<gap:double,other:array<double>,copies:bigint>>"


def _lists(n, i, j, gap, y, copies):
    """The found of each of n vectors as a list in order."""
    ends = np.append(0, np.cumsum(np.bincount(i, minlength=n))).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(gap, pa.float64()), _vectors(y[j]), pa.array(copies[j], pa.int64())], names=["gap", "other", "copies"])
    return pa.ListArray.from_arrays(pa.array(ends), found)


def _answered(rows, k, made, cell_rows=CELL_ROWS):
    """(label, made) of every asked row: `made` is a column of row_id, times, vec, twins and near, its k nearest other vectors in order.

    `rows` are (label, vec, row_id, times, copies), read several times; those with times > 0 ask. They are dealt to cells once; a task
    answers the rows of a cell from its vectors. Rows whose ball touches the box of another cell visit it in a second deal, to which
    a cell sends only the vectors near to its visitors.
    """
    spark = rows.sparkSession
    tree, boxes = _grown(rows, cell_rows)
    cells = np.array(sorted(boxes))
    of = np.full(len(tree.axis), -1)
    for i, root in enumerate(tree.roots.values()):
        todo = [root]
        while todo:
            at = todo.pop()
            of[at] = i
            todo += [tree.low[at], tree.low[at] + 1] if tree.axis[at] >= 0 else []
    lo, hi = (np.stack([boxes[c][side] for c in cells.tolist()]) for side in (2, 3))
    shared = spark.sparkContext.broadcast((cells, of[cells], lo, hi, list(tree.roots)))

    def answer(table):
        cells, of, lo, hi, labels = shared.value
        path = table.column("path")[0].as_py()
        y, copies, place = _distinct(_matrix(table.column("vec")), table.column("copies").to_numpy())
        asks = np.flatnonzero(table.column("kind").to_numpy() == 1)
        places, at = np.unique(place[asks], return_inverse=True)
        q = y[places]
        real = np.flatnonzero(copies > 0)
        y, n = y[real], copies[real]
        i, j, gap = _nearest(q, y, k)
        count = np.bincount(i, minlength=len(q))
        reach = np.full(len(q), np.inf)
        reach[count >= k] = gap[(np.cumsum(count) - 1)[count >= k]]
        here = np.searchsorted(cells, path)
        others = np.flatnonzero((of == of[here]) & (cells != path))
        visit = [[] for _ in range(len(q))]
        order = np.argsort(reach)
        for first in range(0, len(q), 1024):
            mine = order[first:first + 1024]
            a, b = np.fmin.reduce(q[mine]), np.fmax.reduce(q[mine])
            far = np.zeros(len(others))
            for c in range(q.shape[1]):
                far += np.maximum(0.0, np.maximum(lo[others, c] - b[c], a[c] - hi[others, c])) ** 2
            near = others[far <= reach[mine].max() ** 2 * (1 + 1e-9)]
            r, c = np.nonzero(_outside(q[mine], lo[near], hi[near]) <= (reach[mine] ** 2 * (1 + 1e-9))[:, None])
            for r, c in zip(r.tolist(), cells[near[c]].tolist()):
                visit[mine[r]].append(c)
        lead = np.zeros(len(asks), bool)
        lead[np.unique(at, return_index=True)[1]] = True
        take = pa.array(at)
        return pa.table({
            "label": pa.array([labels[of[here]]] * len(asks), label_type), "own": pa.array(np.full(len(asks), path)), "own_part": table.column("part").take(pa.array(asks)),
            "at": take, "lead": pa.array(lead), "row_id": table.column("row_id").take(pa.array(asks)), "times": table.column("times").take(pa.array(asks)),
            "vec": _vectors(q[at]) if len(q) else pa.array([], pa.list_(pa.float64())), "twins": pa.array(copies[places][at]), "reach": pa.array(reach[at]),
            "near": _lists(len(q), i, j, gap, y, n).take(take).cast(_NEAR), "visit": pa.array(visit, pa.list_(pa.int64())).take(take)})

    label = rows.schema["label"].dataType.simpleString()
    label_type = rows.select("label").limit(0).toArrow().schema.field(0).type
    first = _dealt(rows, tree, boxes).groupBy("path", "part").applyInArrow(
        answer, f"label {label}, own long, own_part long, at long, lead boolean, row_id long, times long, vec array<double>, twins long, "
                f"reach double, near {_NEAR_DDL}, visit array<bigint>")
    settled = F.size("visit") == 0
    at = ["own", "own_part", "at"]
    first = cut(first.select("label", F.when(settled, made).alias("made"), F.when(~settled, F.struct(
        *at, "lead", "row_id", "times", "vec", "twins", "reach", "near", F.when(F.col("lead"), F.col("visit")).alias("visit"))).alias("open")))
    done = first.filter("open is null").select("label", "made")
    waiting = first.filter("open is not null").select("label", "open.*")
    visits = waiting.filter("lead").select(F.explode("visit").alias("path"), *at, "vec", "reach")
    size = lo.shape[1]
    wide = F.col("reach") * (1 + 1e-9)
    balls = visits.groupBy("path", "own").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.get("vec", F.lit(i)) - wide) for i in range(size)]).alias("lo"),
        F.array(*[F.max(F.get("vec", F.lit(i)) + wide) for i in range(size)]).alias("hi")).toArrow()
    if not balls.num_rows:
        return done
    asked = np.bincount(balls["path"].to_numpy(), balls["n"].to_numpy(), minlength=len(tree.axis))
    parts = np.maximum(1, -(-asked // ASKED_ROWS)).astype(np.int64)
    many = spark.sparkContext.broadcast(parts)

    @F.pandas_udf("long")
    def shares(path: pd.Series) -> pd.Series:
        return pd.Series(many.value[path.to_numpy()])

    visits = visits.withColumn("part", F.pmod(F.xxhash64(*at), shares("path")))

    def look(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({**{c: a.column(c).slice(0, 0) for c in at}, "more": pa.array([], _NEAR)})
        y, copies, _ = _distinct(_matrix(b.column("vec")), b.column("copies").to_numpy())
        i, j, gap = _nearest(_matrix(a.column("vec")), y, k, a.column("reach").to_numpy())
        return pa.table({**{c: a.column(c) for c in at}, "more": _lists(a.num_rows, i, j, gap, y, copies).cast(_NEAR)})

    key = ["path", "part"]
    found = visits.groupBy(*key).cogroup(_met(rows, tree, balls, parts).groupBy(*key)).applyInArrow(
        look, f"own long, own_part long, at long, more {_NEAR_DDL}")
    found = found.filter(F.size("more") > 0).groupBy(*at).agg(F.flatten(F.collect_list("more")).alias("more"))
    late = waiting.join(found, at, "left").withColumn("near", F.slice(F.array_sort(F.concat(
        "near", F.coalesce("more", F.array().cast(_NEAR_DDL)))), 1, k))
    return done.unionByName(late.select("label", made.alias("made")))


def nearest_same_class(pool, wanted, k, cell_rows=CELL_ROWS):
    """Exact k nearest distinct vectors of the same class: (label, vec, near), near in order of gap, then of vector.

    `pool` has (label, vec, copies), one row per distinct vector; `wanted` the (label, vec) to answer.
    """
    asked = wanted.select("label", "vec").distinct().withColumn("times", F.lit(1).cast("long"))
    rows = cut(pool.join(asked, ["label", "vec"], "left").select(
        "label", "vec", F.xxhash64("vec").alias("row_id"), F.coalesce("times", F.lit(0).cast("long")).alias("times"), F.col("copies").cast("long").alias("copies")))
    return _answered(rows, k, F.struct("vec", "near"), cell_rows).select("label", "made.*")


def _thresholds(rows):
    """(label, each, upto, part) a class: every row is copied `each` times, those with a row_id below `upto` once more, and `part` of
    those that have it.

    Rows are counted by the first bits of their ids, then by the ids that share those of the last one copied.
    """
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    need = F.max("n").over(Window.partitionBy(F.lit(1))) - F.col("n")
    want = counts.withColumn("need", need).filter("label is not null").select(
        "label", F.floor(F.col("need") / F.col("n")).alias("each"), (F.col("need") % F.col("n")).alias("left"))

    def last(counted, at, want):
        """Where the wanted number of rows ends, and how many of them are there."""
        before = F.sum("c").over(Window.partitionBy("label").orderBy(at)) - F.col("c")
        left = F.col("left") - F.col("_off")
        return counted.withColumn("_off", before).join(want, "label").filter((left >= 0) & (left < F.col("c"))).select(
            "label", "each", at, left.alias("left"))

    first = cut(last(rows.groupBy("label", F.shiftright("row_id", 52).alias("b")).agg(F.count(F.lit(1)).alias("c")), "b", want))
    inside = rows.join(first.select("label", "b"), (rows["label"] == first["label"]) & (F.shiftright("row_id", 52) == first["b"]), "left_semi")
    ids = inside.groupBy("label", "row_id").agg(F.count(F.lit(1)).alias("c"))
    return cut(last(ids, "row_id", first.drop("b")).withColumnsRenamed({"row_id": "upto", "left": "part"}))


def smote(df, key, *, label="label", k=5, seed=SEED):
    """Bring every class to the size of the largest with points between near neighbours.

    Each synthetic row lies at a random share of the way from a row to one of its k nearest rows of
    the same class. Choices are hashed from the row's key, so the result does not move with
    partitioning. Identical vectors are counted once in the neighbour search. `df` is read several times.
    """
    rows = df.select(F.xxhash64(F.lit(seed), *key).alias("row_id"), F.col(label).cast("int").alias("label"),
                     vector_to_array("features").alias("vec"))
    bounds = _thresholds(rows)
    rows = rows.join(bounds, "label").withColumn("times", (F.col("each") + (F.col("row_id") < F.col("upto")).cast("long")).cast("long"))
    tied = (F.col("row_id") == F.col("upto")) & (F.col("part") > 0)
    if not bounds.filter("part > 0").isEmpty():  # some of several rows with one key
        place = F.row_number().over(Window.partitionBy("label").orderBy("vec"))
        some = rows.filter(tied).withColumn("times", (F.col("each") + (place <= F.col("part")).cast("long")).cast("long"))
        rows = rows.filter(~tied).unionByName(some)
    rows = rows.select("label", "vec", "row_id", "times", F.lit(1).cast("long").alias("copies"))
    # Twins come first (their distance is 0); the pick then runs through the other vectors by their copies.
    drawn = lambda copy, name: F.xxhash64(F.lit(seed), "row_id", copy, F.lit(name))
    step = lambda pick: F.aggregate(
        "near", F.struct((pick - F.col("twins") + 1).alias("left"), F.col("vec").alias("at")),
        lambda acc, v: F.struct(
            (acc["left"] - F.when(acc["left"] < 0, 0).otherwise(v["copies"])).alias("left"),
            F.when(acc["left"] >= 0, v["other"]).otherwise(acc["at"]).alias("at")))["at"]
    mixed = lambda copy: F.zip_with("vec", step(F.pmod(drawn(copy, "n"), F.lit(k))), lambda p, q: p + (
        F.pmod(drawn(copy, "s"), F.lit(1 << 30)) / float(1 << 30)) * (q - p))
    made = F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), mixed)
    if rows.isEmpty():
        return df.select(*key, F.col(label).cast("int").alias("label"), "features")
    new = _answered(rows, k, made).select("label", F.explode("made").alias("vec"))
    new = new.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in key], "label", array_to_vector("vec").alias("features"))
    return df.select(*key, F.col(label).cast("int").alias("label"), "features").unionByName(new)
