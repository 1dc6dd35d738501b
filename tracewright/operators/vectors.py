"""Vectors, clusters and experiment statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    """Zeros but for the place of value in the vocabulary; all zeros for an unknown one."""
    return F.array(*(F.when(value.eqNullSafe(F.lit(v)), 1.0).otherwise(0.0) for v in vocabulary))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, centroid: mean of each dimension, pre-aggregated by label and dimension."""
    long = vectors.select(label, F.posexplode(vector).alias("dim", "x"))
    mean = long.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"), F.max("dim").alias("last_dim")).drop("last_dim")


def assign(vectors: DataFrame, cents: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, cluster, similarity: the centroid of the largest cosine. Centroids are as few as labels and broadcast."""
    flat = cents.select(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")).alias("s")).agg(F.collect_list("s").alias("all"))
    scored = vectors.select(key, vector).crossJoin(F.broadcast(flat))  # one row
    best = F.array_max(F.transform("all", lambda s: F.struct(F.round(cosine(F.col(vector), s["c"]), 9).alias("similarity"), (-s["l"]).alias("neg"))))
    return scored.select(key, best.alias("b")).select(key, (-F.col("b.neg")).alias("cluster"), "b.similarity")


def ranked(vectors: DataFrame, cents: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, cluster, rank, similarity: all centroids by their cosine, as few as labels and broadcast."""
    flat = cents.select(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")).alias("s")).agg(F.collect_list("s").alias("all"))
    scored = vectors.select(key, vector).crossJoin(F.broadcast(flat))  # one row
    by = F.array_sort(F.transform("all", lambda s: F.struct((-F.round(cosine(F.col(vector), s["c"]), 9)).alias("far"), s["l"].alias("cluster"))))
    return scored.select(key, F.posexplode(by).alias("at", "s")).select(key, "s.cluster", (F.col("at") + 1).alias("rank"), (-F.col("s.far")).alias("similarity"))


def kmeans(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """key, cluster by k-means over standardised vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    return KMeans(k=k, seed=seed, initSteps=5).fit(scaled).transform(scaled).select(key, F.col("prediction").alias("cluster"))


def dtw(a: list[float], b: list[float]) -> float:
    """Dynamic time warping distance of two series (root of the least sum of squares along a path): the table's cells are
    taken by falling diagonals, each at once."""
    import numpy as np

    x, y = np.asarray(a, float), np.asarray(b, float)
    n, m = len(x), len(y)
    if not n or not m:
        return 0.0 if n == m else math.inf
    back, last = np.full(n + 1, math.inf), np.full(n + 1, math.inf)  # by the place in a, from 1
    back[0] = 0.0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        now = np.full(n + 1, math.inf)
        now[i] = (x[i - 1] - y[d - i - 1]) ** 2 + np.minimum(back[i - 1], np.minimum(last[i - 1], last[i]))
        back, last = last, now
    return math.sqrt(last[n])


@pandas_udf(T.DoubleType())
def dtw_distance(a, b):
    import pandas as pd

    return pd.Series([dtw(x, y) for x, y in zip(a, b, strict=True)])


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


def p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_test(rows: DataFrame, group: str, value: str, control: str, treatment: str) -> DataFrame:
    """n, means, change in per cent, pooled t, degrees of freedom and Cohen's d (population variances) of two groups."""
    g = {}
    for tag, name in (("c", control), ("t", treatment)):
        own = F.when(F.col(group) == name, F.col(value))
        g |= {f"n_{tag}": F.count(own), f"mean_{tag}": F.avg(own), f"var_{tag}": F.var_samp(own), f"pop_{tag}": F.var_pop(own)}
    x = rows.agg(*(c.alias(k) for k, c in g.items()))
    df = F.col("n_c") + F.col("n_t") - 2
    pooled = ((F.col("n_c") - 1) * F.col("var_c") + (F.col("n_t") - 1) * F.col("var_t")) / df
    spread = F.sqrt(((F.col("n_c") - 1) * F.col("pop_c") + (F.col("n_t") - 1) * F.col("pop_t")) / df)
    gain = F.col("mean_t") - F.col("mean_c")
    return x.select("n_c", "n_t", F.round("mean_c", 4).alias("mean_c"), F.round("mean_t", 4).alias("mean_t"), F.round(100 * gain / F.col("mean_c"), 4).alias("change_pct"), F.round(gain / F.sqrt(pooled * (1 / F.col("n_c") + 1 / F.col("n_t"))), 4).alias("t"), df.alias("df"), F.round(gain / spread, 4).alias("cohens_d"))


def cluster_sequences(events: DataFrame, k: int = 4, key: str = "session_id") -> DataFrame:
    """key, cluster: sessions by the share of each type of event, types in the order of their names."""
    names = sorted(r["type"] for r in events.select("type").distinct().collect())  # as few as there are types
    shares = [F.avg((F.col("type") == n).cast("double")).alias(f"s{i}") for i, n in enumerate(names)]
    per = events.groupBy(key).agg(*shares)
    return kmeans(per.select(key, F.array(*(f"s{i}" for i in range(len(names)))).alias("v")), k, key, "v")


def library(sequences: DataFrame, clusters: DataFrame, key: str = "session_id", least: int = 3) -> DataFrame:
    """cluster, frequency, mean_length, representative: clusters of sequences of least members or more; the member whose
    length is nearest to the mean stands for each."""
    x = sequences.join(clusters, key)
    per = x.groupBy("cluster").agg(F.count("*").alias("frequency"), F.avg("length").alias("mean")).where(f"frequency >= {least}")
    near = x.join(per, "cluster").groupBy("cluster", "frequency", "mean").agg(F.min_by(key, F.struct(F.abs(F.col("length") - F.col("mean")), F.col(key))).alias("representative"))
    return near.select("cluster", "frequency", F.round("mean", 4).alias("mean_length"), "representative")
