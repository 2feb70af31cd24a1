"""Clustering of windows without labels, and how well clusters agree with labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .stats import seed_of

#: Cells that linkage takes at most; a coarser grid keeps under it.
MAX_CELLS = 2_000
#: Starts of k-means.
STARTS = 12


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 1, out: str = "cluster", restarts: int = STARTS) -> DataFrame:
    """df with the cluster of each row, by Spark's own distributed k-means: the best of `restarts` starts."""
    d = df.withColumn("__v", array_to_vector(F.col(vector)))
    v = d.select("__v").persist()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol=out, maxIter=20).fit(v) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        v.unpersist()
    return best.transform(d).drop("__v")


def grid_cells(df: DataFrame, cols: list[str], width: list[float]) -> DataFrame:
    """(cell coordinates, n, means): rows by the cell of a grid that they lie in."""
    cells = [F.floor(F.col(c) / w).cast("bigint").alias(f"i_{c}") for c, w in zip(cols, width, strict=True)]
    return df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


def average_linkage(x: np.ndarray, weight: np.ndarray, clusters: int) -> np.ndarray:
    """Labels when the two clusters of least mean distance merge until `clusters` are left. Weighted points count as that many."""
    n = len(x)
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    w, label, alive = weight.astype(float).copy(), np.arange(n), n
    while alive > max(1, clusters):
        i, j = divmod(int(d.argmin()), n)
        if not np.isfinite(d[i, j]):
            break
        i, j = min(i, j), max(i, j)
        row = (w[i] * d[i] + w[j] * d[j]) / (w[i] + w[j])
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i, :], d[:, i] = row, row
        d[j, :], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        w[i] += w[j]
        label[label == j] = i
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def linkage_of_cells(cells: DataFrame, cols: list[str], clusters: int) -> DataFrame:
    """(cell coordinates, n, cluster). Cells are few by construction: more than MAX_CELLS is an error that asks for a coarser grid."""
    if cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; use a coarser grid")
    ids = [f"i_{c}" for c in cols]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ids).reset_index(drop=True)
        pdf["cluster"] = average_linkage(pdf[cols].to_numpy(), pdf["n"].to_numpy(), clusters)
        return pdf[[*ids, "n", "cluster"]]

    return cells.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(run, ", ".join(f"{i} bigint" for i in ids) + ", n bigint, cluster bigint")


def agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row: adjusted Rand index and purity, from the table of counts."""
    c = df.groupBy(truth, cluster).agg(F.count(F.lit(1)).alias("n"))
    two = lambda x: x * (x - 1) / 2
    rows = c.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"), F.sum("n").alias("all"))
    cols = c.groupBy(cluster).agg(F.sum("n").alias("n"), F.max("n").alias("top")).agg(F.sum(two(F.col("n"))).alias("b"), F.sum("top").alias("top"))
    cells = c.agg(F.sum(two(F.col("n"))).alias("ab"))
    j = cells.crossJoin(rows).crossJoin(cols)  # one row each
    want = F.col("a") * F.col("b") / two(F.col("all"))
    return j.select(((F.col("ab") - want) / ((F.col("a") + F.col("b")) / 2 - want)).alias("ari"), (F.col("top") / F.col("all")).alias("purity"))


def cocluster_p(ca: np.ndarray, cb: np.ndarray, sizes: np.ndarray, draws: int, seed: int) -> tuple[float, float, float]:
    """Share of pairs of a row of a and one of b that lie in one cluster, its mean when labels are shuffled over all rows, and the p-value.

    Counts of two labels by cluster under a shuffle are drawn without rows: a's from the clusters, b's from what a leaves.
    """
    na, nb = int(ca.sum()), int(cb.sum())
    rng = np.random.default_rng(seed)
    pa = rng.multivariate_hypergeometric(sizes, na, size=draws, method="marginals")
    null = np.array([a @ rng.multivariate_hypergeometric(sizes - a, nb, method="marginals") for a in pa]) / (na * nb)
    own = float(ca @ cb) / (na * nb)
    return own, float(null.mean()), float((1 + (null >= own - 1e-12).sum()) / (draws + 1))


def cocluster(df: DataFrame, truth: str, cluster: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(a, b, together, expected, p) of pairs of labels a < b: do they share clusters more than shuffled labels do? From the table of counts."""
    c = df.where(F.col(truth).isNotNull() & F.col(cluster).isNotNull()).groupBy(F.col(truth).alias("l"), F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("l", "c", "n")))
    one = c.agg(lines.alias("t"))  # one row: the table has a number for each label and cluster
    one = one.select("t", F.array_sort(F.array_distinct(F.transform("t", lambda r: r["l"]))).alias("ls"), F.array_sort(F.array_distinct(F.transform("t", lambda r: r["c"]))).alias("cs"))
    total = lambda keep: F.transform("cs", lambda k: F.aggregate(F.filter("t", lambda r: keep(r) & (r["c"] == k)), F.lit(0).cast("bigint"), lambda x, r: x + r["n"]))
    whole = one.withColumn("sizes", total(lambda r: F.lit(True)))
    x = whole.select("t", "cs", "ls", "sizes", F.explode("ls").alias("a")).withColumn("na", total(lambda r: r["l"] == F.col("a")))
    x = x.withColumn("b", F.explode(F.filter("ls", lambda l: l > F.col("a"))))
    j = x.withColumn("nb", total(lambda r: r["l"] == F.col("b"))).select("a", "b", "na", "nb", "sizes").repartition("a", "b")

    def run(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        got = [cocluster_p(np.asarray(x), np.asarray(y), np.asarray(z), draws, seed_of((k, l), seed)) for k, l, x, y, z in zip(a, b, na, nb, sizes, strict=True)]
        return pd.DataFrame(got, columns=["together", "expected", "p"])

    run.__annotations__ = dict.fromkeys(("a", "b", "na", "nb", "sizes"), pd.Series) | {"return": pd.DataFrame}
    return j.select("a", "b", F.pandas_udf(run, "together double, expected double, p double")("a", "b", "na", "nb", "sizes").alias("o")).select("a", "b", "o.*")


#: Rows of a slab at most, parts on each side while slabs are smaller, and distances that are in memory together.
SLAB_ROWS, SIDE, CELLS = 65_536, 6, 1 << 21
#: Share of the squared lengths below which a squared distance is taken from the differences, as a product of matrices would lose its digits.
CLOSE = 1e-4


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all of y."""
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)
    d = x @ y.T
    d *= -2
    d += xx
    d += yy
    i, j = np.nonzero(~(d > CLOSE * (xx + yy)))
    step = max(1, CELLS // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        d[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def cluster_distances(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """(id, c, other, total): of each row, in cluster c, the sum of its distances to all rows of cluster `other`.

    A slab of rows stays in its task, and a part of all rows streams past it; no pair is written. A row moves once for each slab and part, whose numbers
    don't grow until slabs are full.
    """
    path = scratch(df.sparkSession, "rows")
    df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    n = rows.count()
    side = max(1, min(SIDE, math.ceil(n / 1024)))
    slabs = max(side, math.ceil(n / SLAB_ROWS))
    parts = max(1, math.ceil(side * side / slabs))
    own = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    kept = rows.select("id", "c", "v", own(slabs, 0).alias("s"), each(parts).alias("p"))
    passing = rows.select("id", "c", "v", own(parts, 1).alias("p"), each(slabs).alias("s"))
    meet = lambda d, first: d.select((F.col("s") * parts + F.col("p")).alias("cell"), F.lit(first).alias("side"), "id", "c", "v")
    met = meet(kept, 0).unionByName(meet(passing, 1)).repartitionById(slabs * parts, "cell").sortWithinPartitions("cell", "side", "c")
    kind = rows.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held, totals, b = None, [], [], {}, None

        def out() -> pa.RecordBatch:
            n, kind = len(own), b.schema.field(3).type
            ids, cs = ([r[i] for _ in totals for r in own] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cs, kind), pa.array([k for k in totals for _ in range(n)], kind), pa.array(np.concatenate(list(totals.values())) if totals else [], pa.float64())], names=["id", "c", "other", "total"])

        for b in batches:
            cell, first, cs = b.column(0).to_numpy(), b.column(1).to_numpy() == 0, b.column(3).to_pylist()
            # rows are in order of cell, side and cluster
            cuts = [0, *(i for i in range(1, b.num_rows) if cell[i] != cell[i - 1] or first[i] != first[i - 1] or not first[i] and cs[i] != cs[i - 1]), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if cell[lo] != at:
                    if own:
                        yield out()
                    at, own, held, totals = cell[lo], [], [], {}
                y = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if first[lo]:
                    own += zip(part.column(2).to_pylist(), cs[lo:hi], strict=True)
                    held.append(y)
                elif own:
                    held = [np.concatenate(held)] if len(held) > 1 else held
                    x = held[0]
                    step = max(1, CELLS // len(y))
                    add = np.concatenate([distances(x[j : j + step], y).sum(1) for j in range(0, len(x), step)])
                    totals[cs[lo]] = totals.get(cs[lo], 0.0) + add
        if own:
            yield out()

    got = met.mapInArrow(run, f"id bigint, c {kind}, other {kind}, total double")
    return got.groupBy("id", "c", "other").agg(F.sum("total").alias("total"))


def silhouette(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """One row (n, silhouette): the mean over rows of (b - a) / max(a, b), a the mean distance to the others of its cluster, b the least mean distance to another cluster. A cluster of one row counts 0; null with fewer than two clusters. Work grows as the square of the rows; a caller with very many gives a sample."""
    d = cluster_distances(df, vector, cluster)
    size = d.where(F.col("c") == F.col("other")).groupBy(F.col("other").alias("__o")).agg(F.count(F.lit(1)).alias("m"))
    mean = d.join(size, d["other"] == size["__o"]).withColumn("own", F.col("c") == F.col("other"))
    row = mean.groupBy("id").agg(F.max(F.when(F.col("own"), F.col("m"))).alias("m"), F.max(F.when(F.col("own") & (F.col("m") > 1), F.col("total") / (F.col("m") - 1))).alias("a"), F.min(F.when(~F.col("own"), F.col("total") / F.col("m"))).alias("b"))
    top = F.greatest("a", "b")
    one = F.when(F.col("b").isNotNull(), F.when((F.col("m") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0))
    return row.agg(F.count(F.lit(1)).alias("n"), F.avg(one).alias("silhouette"))
