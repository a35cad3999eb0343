"""Active-learning selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.common import checkpoint
from voxloom.functions.scalars import euclidean
from voxloom.operators.cluster import kmeans
from voxloom.operators.ordered import ranked
from voxloom.operators.vectors import closest_per_cluster, mean_distances, reduce_pca, standardize, with_centroid_distance


def select_for_labelling(rows: DataFrame, label: str, prob: str, per_cluster: int = 3, many: int = 10) -> DataFrame:
    """Of each cluster of (id, vec, label, prob) the row nearest its centroid, the least certain one, and the one farthest
    from both: label, id, reason.

    If the least certain row is the nearest one, clusters of more than 5 rows give the row of the largest mean distance to
    the others as their third (`edge_boundary`). Two per cluster if there are more than `many` clusters. Clusters smaller than that are taken whole
    (`small_cluster`). Noise (-1) and null labels don't count; a null or NaN probability counts as 1. Ties go
    to the smaller id. Every choice is an aggregate, so a large cluster is no hot task.
    """
    data = rows.where(F.col(label).isNotNull() & (F.col(label) != -1)).select("id", "vec", F.col(label).alias("c"), F.when(F.isnan(prob), 1.0).otherwise(F.coalesce(F.col(prob).cast("double"), F.lit(1.0))).alias("p"))
    d = with_centroid_distance(data, "c", "vec", "d").withColumn("d", F.round("d", 9))
    sizes = d.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("d", "id"))["id"].alias("center"), F.min(F.struct("p", "id"))["id"].alias("unsure"))
    take = min(per_cluster, 2) if sizes.count() > many else per_cluster
    tagged = d.join(sizes, "c")
    small = tagged.where(F.col("n") < take).select("c", "id", F.lit("small_cluster").alias("reason"))
    large = sizes.where(F.col("n") >= take)
    got = small.union(large.select("c", F.col("center").alias("id"), F.lit("centroid").alias("reason")))
    if take > 1:
        got = got.union(large.where("unsure <> center and n > 1").select("c", F.col("unsure").alias("id"), F.lit("uncertain").alias("reason")))
    if take > 2:
        at = lambda who, out: data.select(F.col("id").alias(who), F.col("vec").alias(out))
        far = data.join(large.where("n > 2"), "c").join(at("center", "v1"), "center").join(at("unsure", "v2"), "unsure").where("id <> center and id <> unsure")
        gap = F.round(F.least(euclidean(F.col("vec"), F.col("v1")), euclidean(F.col("vec"), F.col("v2"))), 9)
        got = got.union(far.groupBy("c").agg(F.max(F.struct(gap.alias("g"), (-F.col("id")).alias("neg")))["neg"].alias("neg")).select("c", (-F.col("neg")).alias("id"), F.lit("boundary_diverse").alias("reason")))
        # where the least certain row is the central one, two are chosen so far; the third is the row farthest from all on average
        edge = large.where((F.col("n") > 5) & (F.col("unsure") == F.col("center"))).select("c", "center")
        todo = data.join(edge, "c")
        if not edge.isEmpty():
            taken = got.select("c", "id")
            apart = mean_distances(todo.select("id", "vec", F.col("c").cast("string").alias("g"))).join(todo.select("id", "c"), "id").join(taken, ["c", "id"], "left_anti")
            got = got.union(apart.groupBy("c").agg(F.max(F.struct(F.round("mean_dist", 9).alias("g"), (-F.col("id")).alias("neg")))["neg"].alias("neg")).select("c", (-F.col("neg")).alias("id"), F.lit("edge_boundary").alias("reason")))
    return got.select(F.col("c").alias(label), "id", "reason")


def top_per_group_then_global(rows: DataFrame, group: str, score: str, per_group: int, total: int) -> DataFrame:
    """T4: the `per_group` best rows of each group, filled up to `total` with the best of the rest: id, group, score, step."""
    w = Window.partitionBy(group).orderBy(F.desc(score), "id")
    first = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_group).select("id", group, score)
    head = first.orderBy(F.desc(score), "id").limit(total).withColumn("step", F.lit("group"))
    left = total - head.count()
    rest = rows.join(head.select("id"), "id", "left_anti").orderBy(F.desc(score), "id").limit(max(0, left)).select("id", group, score).withColumn("step", F.lit("global"))
    return head.unionByName(rest)


def selection_by_recording(rows: DataFrame, recording: str, score: str, per_recording: int = 3) -> DataFrame:
    """The rows of (id, recording, score, start_ms, stop_ms) of highest score in each recording, with rank and times in
    seconds (0.0 where the name held none); ties go to the smaller id, null scores come last."""
    top = ranked(rows.where(F.col(recording).isNotNull()), [recording], [F.col(score).desc_nulls_last(), F.col("id")], "rank").where(F.col("rank") <= per_recording)
    sec = lambda c: F.coalesce(F.col(c) / 1000.0, F.lit(0.0))
    return top.select("id", recording, score, "rank", sec("start_ms").alias("start"), sec("stop_ms").alias("stop"))


def fourier_features(vec: Column, width: int, features: int = 128, gamma: float | None = None, seed: int = 42) -> Column:
    """Random Fourier features of an RBF kernel exp(-gamma |x - y|^2)."""
    gamma = gamma or 1.0 / width
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=math.sqrt(2 * gamma), size=(width, features)), rng.uniform(0, 2 * math.pi, features)

    @F.pandas_udf("array<double>")
    def lift(v: pd.Series) -> pd.Series:
        return pd.Series(list(math.sqrt(2.0 / features) * np.cos(np.stack(v.to_list()) @ w + b))) if len(v) else v

    return lift(vec.cast("array<double>"))


def uncertainty(rows: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """1 - largest class probability of a kernel logistic model fitted to the labels of (id, vec, label)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    head = rows.select(F.size("vec").alias("n")).first()
    if head is None:
        return rows.select("id", F.lit(0.0).alias("uncertainty"))
    data = rows.withColumn("features", array_to_vector(fourier_features(F.col("vec"), head["n"], seed=seed))).withColumn("label", F.col(label).cast("double"))
    data = checkpoint(data)
    model = LogisticRegression(maxIter=50, regParam=1e-3, family="multinomial").fit(data.select("features", "label"))
    return model.transform(data).select("id", label, F.round(1 - F.array_max(vector_to_array("probability")), 9).alias("uncertainty")) if label != "label" else model.transform(data).select("id", F.round(1 - F.array_max(vector_to_array("probability")), 9).alias("uncertainty"))


def svm_uncertainty(rows: DataFrame, label: str, features: int = 128, seed: int = 42) -> DataFrame:
    """1 - largest class probability of an RBF support vector machine fitted to the labels of (id, vec, label).

    The kernel is lifted by random Fourier features; each class has a linear machine against the rest, whose margins a
    logistic curve (Platt) turns into probabilities that are scaled to sum to 1. The number of classes is small.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    head = rows.select(F.size("vec").alias("n")).first()
    if head is None:
        return rows.select("id", F.lit(0.0).alias("uncertainty"))
    data = rows.select("id", F.col(label).alias("__y"), array_to_vector(fourier_features(F.col("vec"), head["n"], features, seed=seed)).alias("features"))
    scored = checkpoint(data)
    classes = [r[0] for r in scored.where("__y is not null").select("__y").distinct().orderBy("__y").collect()]
    for c, value in enumerate(classes):
        one = scored.withColumn("label", (F.col("__y") == value).cast("double"))
        margin = LinearSVC(maxIter=30, regParam=1e-3, rawPredictionCol="raw", predictionCol="said").fit(one.where("label is not null").select("features", "label")).transform(one)
        margin = margin.select("*", F.array(vector_to_array("raw")[1]).alias("m")).withColumn("margin", array_to_vector("m"))
        platt = LogisticRegression(featuresCol="margin", maxIter=30, probabilityCol="p", rawPredictionCol="r", predictionCol="q").fit(margin.where("label is not null").select("margin", "label")).transform(margin)
        scored = checkpoint(platt.select(*scored.columns, vector_to_array("p")[1].alias(f"__p{c}")))
    if len(classes) < 2:
        return scored.select("id", F.lit(0.0).alias("uncertainty"))
    p = [F.col(f"__p{c}") for c in range(len(classes))]
    total = sum(p[1:], p[0])
    return scored.select("id", F.round(1 - F.greatest(*p) / total, 9).alias("uncertainty"))


def hybrid_selection(vectors: DataFrame, total: int = 20, k: int = 10, n_init: int = 10, seed: int = 42) -> DataFrame:
    """Standardise, reduce, k-means, uncertainty of a kernel model, then the best of each cluster and of the rest."""
    z = standardize(vectors, "vec", "z").select("id", F.col("z").alias("vec"))
    reduced = reduce_pca(z, "vec", 0.95, 50).select("id", F.col("reduced").alias("vec"))
    found = kmeans(reduced, k, n_init, seed)
    scored = uncertainty(found, "cluster", seed)
    return top_per_group_then_global(scored, "cluster", "uncertainty", max(1, total // k), total)


def random_uncertainty(vectors: DataFrame, total: int = 20, classes: int = 10, seed: int = 42) -> DataFrame:
    """S3: uncertainty under pseudo-labels drawn by hash."""
    rows = vectors.withColumn("pseudo", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(classes)))
    return uncertainty(rows, "pseudo", seed).orderBy(F.desc("uncertainty"), "id").limit(total).select("id", "uncertainty")


def representatives(vectors: DataFrame, total: int = 20, k: int = 10, n_init: int = 10, seed: int = 42) -> DataFrame:
    """The rows nearest to the k-means centres."""
    return closest_per_cluster(kmeans(vectors, k, n_init, seed), "cluster", max(1, total // k)).select("id", "cluster", "rank")


def stratified_split(df: DataFrame, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark about `test_share` of each label's rows, at least one, as test: adds `is_test`. The order is a hash of the id."""
    rows = ranked(df, [label], [F.xxhash64("id", F.lit(seed)), F.col("id")], "__rn", "__n")
    return rows.withColumn("is_test", F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") * test_share))).drop("__rn", "__n")


def nested_speakers(labels: DataFrame, label: str, first: int = 2, seed: int = 42) -> DataFrame:
    """Growing subsets of the labels in hashed order: subset size, label."""
    w = Window.partitionBy().orderBy(F.xxhash64(label, F.lit(seed)), label)
    order = labels.select(label).where(F.col(label).isNotNull()).distinct().withColumn("k", F.row_number().over(w))
    n = order.count()
    return order.withColumn("subset", F.explode(F.sequence(F.greatest(F.col("k"), F.lit(first)), F.lit(max(n, first))))).where(F.col("subset") <= n).select("subset", label)


def synthetic_clusters(spark, n: int = 500, width: int = 64, clusters: int = 5, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Unit-norm centres with noise: id, vec, label."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    label = np.arange(n) % clusters
    x = centres[label] + noise * rng.normal(size=(n, width)) / math.sqrt(width)
    return spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id bigint, vec array<double>, label int")
