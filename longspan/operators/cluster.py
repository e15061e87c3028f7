"""Clustering of short vectors by direction, its validation, and principal scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.sources.workspace import written


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bound(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``c``, which is computed once a row; a lambda computes an expression from outside anew for every element."""
    return F.transform(F.array(c), then)[0]


def unit(v: Column) -> Column:
    return bound(norm(v), lambda size: F.transform(v, lambda x: x / F.when(size > 1e-12, size).otherwise(1.0)))


def directions(df: DataFrame, vector: str, key: str) -> DataFrame:
    """``df`` with directions for vectors, dealt by ``key``, so that one large file is not one task, and written once for the scans of a fit."""
    dealt = df.repartition(key).sortWithinPartitions(key)  # in order, so that a fit's draws do not depend on which rows come first
    return written(dealt.withColumn(vector, unit(F.col(vector))), "directions")


def masked_cosine(a: Column, b: Column, least: int = 4) -> Column:
    """Cosine over places known in both, null below ``least`` of them."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, p: s + f(p))
    size = F.sqrt(total(lambda p: p["x"] * p["x"]) * total(lambda p: p["y"] * p["y"]))
    return F.when((F.size(both) >= least) & (size > 1e-12), total(lambda p: p["x"] * p["y"]) / F.nullif(size, F.lit(0.0)))


def spherical_kmeans(df: DataFrame, vector: str, k: int, restarts: int = 30, iterations: int = 100, seed: int = 1) -> list[list[float]]:
    """Centroids of the best of several runs of k-means on ``directions``, which are read once a run.

    They are not cached here: of rows that are, a run keeps no vectors but decodes them at every step.
    """
    rows = df.where(norm(F.col(vector)) > 1e-12).select(array_to_vector(unit(F.col(vector))).alias("_x"))
    models = [KMeans(featuresCol="_x", k=k, distanceMeasure="cosine", maxIter=iterations, seed=seed + i).fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return sorted([[float(x) for x in c / max(np.linalg.norm(c), 1e-12)] for c in best.clusterCenters()])


def assign(df: DataFrame, vector: str, centroids: list[list[float]], out: str = "cluster") -> DataFrame:
    """The centroid with the largest cosine, the first of equals; a constant table of k vectors."""
    table = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centroids])
    cos = bound(unit(F.col(vector)), lambda u: F.transform(table, lambda c: dot(u, c)))
    return df.withColumn(out, bound(cos, lambda x: F.array_position(x, F.array_max(x)) - 1))


def silhouette(df: DataFrame, vector: str, label: str) -> float:
    """Mean silhouette by squared-cosine distance in linear work; null with fewer than two clusters."""
    rows = df.select(array_to_vector(unit(F.col(vector))).alias("_x"), F.col(label).cast("int").alias("_c"))
    return ClusteringEvaluator(featuresCol="_x", predictionCol="_c", distanceMeasure="cosine").evaluate(rows)


def exact_silhouette(df: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """key, silhouette with cosine distance.

    Distances to a cluster's members average to one minus the dot product with
    the mean direction, so sums of directions per cluster replace pairs of rows.
    """
    rows = df.select(key, F.col(label).alias("c"), unit(F.col(vector)).alias("u"))
    flat = rows.select("c", F.posexplode("u").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("s"))
    sums = flat.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("v")).select("c", F.transform("v", lambda p: p["s"]).alias("total"))
    sums = sums.join(rows.groupBy("c").agg(F.count("u").alias("m")), "c")
    clusters = sums.agg(F.collect_list(F.struct("c", "total", "m")).alias("clusters"))  # clusters are few
    d = rows.join(F.broadcast(clusters), F.lit(True))
    same = F.get(F.filter("clusters", lambda k: k["c"] == F.col("c")), F.lit(0))  # null without a label
    own = bound(same, lambda k: F.when(k["m"] > 1, (k["m"] - dot(F.col("u"), k["total"])) / F.nullif(k["m"] - 1, F.lit(0))))
    away = F.array_min(F.transform(F.filter("clusters", lambda k: k["c"] != F.col("c")), lambda k: 1 - dot(F.col("u"), k["total"]) / k["m"]))
    s = d.select(key, own.alias("a"), away.alias("b")).groupBy(key).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return s.select(key, F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))).alias("silhouette"))


def principal_scores(df: DataFrame, columns: list[str], key: list[str], k: int = 3) -> DataFrame:
    """Scores on the first k components of z-scored columns with gaps at zero; signs make the largest loading positive."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    scaled = [F.coalesce((F.col(c) - F.lit(stats[f"a_{c}"])) / F.lit(stats[f"s_{c}"] if (stats[f"s_{c}"] or 0) > 1e-12 else 1.0), F.lit(0.0)) for c in columns]
    rows = df.select(*key, array_to_vector(F.array(*scaled)).alias("_x"))
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(rows)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    y = vector_to_array("_y")
    return model.transform(rows).select(*key, *[(y[i] * s).alias(f"pc{i + 1}") for i, s in enumerate(signs)])
