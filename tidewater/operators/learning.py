"""Clustering of zones and linear regression on their features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.distributions import f_sf, t_two_sided

CLUSTER_FEATURES = ("duration", "macd_amplitude", "hist_amplitude", "price_range_pct", "correlation_price_hist")


def scaled(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """z_{column} with population deviation; missing counts as 0, a constant column becomes 0."""
    f = features.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    s = f.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    f = f.crossJoin(F.broadcast(s))  # one row
    z = {f"z_{c}": (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns}
    return f.withColumns(z).drop(*[f"{k}_{c}" for k in "ms" for c in columns])


def cluster_zones(features: DataFrame, k: int = 3, columns: tuple[str, ...] = CLUSTER_FEATURES, seed: int = 42) -> DataFrame:
    """features with z-scores and cluster (k-means; labels depend on the start)."""
    columns = tuple(c for c in (*columns, "num_peaks", "num_troughs") if c in features.columns)
    z = VectorAssembler(inputCols=[f"z_{c}" for c in columns], outputCol="__v").transform(scaled(features, columns))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", initSteps=5).fit(z)
    return model.transform(z).drop("__v")


def cluster_profiles(clustered: DataFrame, columns: tuple[str, ...] = CLUSTER_FEATURES) -> DataFrame:
    """Size, means and deviations, commonest type and shares of bull and bear of each cluster."""
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))], F.mode("type", deterministic=True).alias("type"), (F.count_if(F.col("type") == "bull") / F.count(F.lit(1))).alias("bull_ratio"), (F.count_if(F.col("type") == "bear") / F.count(F.lit(1))).alias("bear_ratio"))


def feature_importance(clustered: DataFrame) -> DataFrame:
    """Population variance of the cluster means of each scaled feature."""
    z = [c for c in clustered.columns if c.startswith("z_")]
    means = clustered.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in z])
    v = means.agg(*[F.var_pop(c).alias(c) for c in z])
    return v.select(F.explode(F.array(*[F.struct(F.lit(c[2:]).alias("feature"), F.col(c).alias("importance")) for c in z])).alias("s")).select("s.*")


def silhouette(clustered: DataFrame) -> float | None:
    """Mean silhouette with squared distances, which needs but one pass and the clusters' sums."""
    z = [c for c in clustered.columns if c.startswith("z_")]
    v = VectorAssembler(inputCols=z, outputCol="__v").transform(clustered)
    if v.select("cluster").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(featuresCol="__v", predictionCol="cluster", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(v)


def cluster_quality(clustered: DataFrame) -> dict:
    """Calinski-Harabasz, Davies-Bouldin and silhouette from sums of squares; nothing pairwise over rows."""
    z = [c for c in clustered.columns if c.startswith("z_")]
    means = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in z])
    d = sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in z)
    own = clustered.join(F.broadcast(means), "cluster").groupBy("cluster").agg(F.first("n").alias("n"), F.sum(d).alias("within"), F.avg(F.sqrt(d)).alias("scatter"), *[F.first(f"m_{c}").alias(c) for c in z]).collect()
    k, n = len(own), sum(r["n"] for r in own)
    c = np.array([[r[x] for x in z] for r in own])
    size = np.array([r["n"] for r in own], dtype=float)
    if k < 2 or n <= k:
        return {"clusters": k, "calinski_harabasz": None, "davies_bouldin": None, "silhouette": None}
    centre = (c * size[:, None]).sum(0) / n
    between, within = float((size * ((c - centre) ** 2).sum(1)).sum()), sum(r["within"] for r in own)
    s = np.array([r["scatter"] for r in own])
    apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    return {"clusters": k, "calinski_harabasz": between / (k - 1) / (within / (n - k)) if within else math.inf, "davies_bouldin": float(((s[:, None] + s[None]) / apart).max(1).mean()), "silhouette": silhouette(clustered)}


def ols(df: DataFrame, y: str, x: list[str]) -> dict:
    """Least squares with a constant from the sums of products (one aggregation, whatever the rows): coefficients,
    errors, t, p, R2, F, AIC, BIC, variance inflation of each predictor (through the origin), condition number."""
    names = [*x, y]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    r = d.agg(F.count(F.lit(1)), *[F.sum(c) for c in names], *[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).first()
    n, p = r[0], len(x)
    if n < p + 2:
        raise ValueError(f"{n} rows are too few for {p} predictors")
    total = dict(zip(names, r[1:]))
    cross = {}
    for (a, b), v in zip(pairs, r[1 + len(names) :]):
        cross[a, b] = cross[b, a] = v
    g = np.empty((p + 1, p + 1))
    g[0, 0] = n
    g[0, 1:] = g[1:, 0] = [total[c] for c in x]
    g[1:, 1:] = [[cross[a, b] for b in x] for a in x]
    t = np.array([total[y], *[cross[c, y] for c in x]])
    inverse = np.linalg.pinv(g)
    b = inverse @ t
    rss = max(0.0, float(cross[y, y] - b @ t))
    tss = float(cross[y, y] - total[y] ** 2 / n)
    s2 = rss / (n - p - 1)
    se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0))
    tv = np.divide(b, se, out=np.zeros_like(b), where=se > 0)
    r2 = 1 - rss / tss if tss > 0 else 0.0
    fv = (r2 / p) / ((1 - r2) / (n - p - 1)) if r2 < 1 else math.inf
    like = -n / 2 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1)
    vif = {}
    for i, c in enumerate(x):
        rest = [j for j in range(p) if j != i]
        if not rest:
            vif[c] = 1.0
            continue
        gx = g[1:, 1:]
        explained = gx[i, rest] @ np.linalg.pinv(gx[np.ix_(rest, rest)]) @ gx[rest, i]
        vif[c] = float(gx[i, i] / (gx[i, i] - explained)) if gx[i, i] > explained else math.inf
    label = ["const", *x]
    return {
        "n": n, "r2": r2, "r2_adjusted": 1 - (1 - r2) * (n - 1) / (n - p - 1), "coefficients": dict(zip(label, b.tolist())), "errors": dict(zip(label, se.tolist())), "t": dict(zip(label, tv.tolist())),
        "p_values": {c: t_two_sided(float(v), n - p - 1) for c, v in zip(label, tv)}, "f": fv, "f_p": f_sf(fv, p, n - p - 1) if math.isfinite(fv) else 0.0,
        "aic": 2 * (p + 1) - 2 * like, "bic": math.log(n) * (p + 1) - 2 * like, "vif": vif, "condition": float(math.sqrt(np.linalg.cond(g))),
    }


def duration_regression(features: DataFrame, x: tuple[str, ...] = ("macd_amplitude", "hist_amplitude", "price_range_pct")) -> dict:
    return ols(features, "duration", [c for c in x if c in features.columns])


def return_regression(features: DataFrame, x: tuple[str, ...] = ("duration", "macd_amplitude", "hist_amplitude", "correlation_price_hist")) -> dict:
    return ols(features, "price_return", [c for c in x if c in features.columns])
