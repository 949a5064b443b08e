"""Centroid clustering: plain Lloyd over integer vectors, whose distances, sums and means are exact, so that the result doesn't depend on how rows are dealt."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import forget, written

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components are held within this, whatever their size: a squared distance of vectors of SIZE components then fits in 64 bits.
MOST = 1 << 27


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors of exactly `size` components, none null or non-finite: v holds floor(scale * x) of each as 32-bit integers, little-endian. What lies beyond MOST is set to it."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(np.stack(x["v"].to_list()).astype(np.float64) * scale), -MOST, MOST).astype("<i4")
                yield pd.DataFrame({"vec_id": x["vec_id"].astype("Int64"), "v": [row.tobytes() for row in v]})

    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col).cast("array<double>")
    fits = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == size) & ~F.exists("v", odd))
    return fits.mapInPandas(whole, "vec_id long, v binary")


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """The k of rows (vec_id, v) with the smallest hex SHA-256 of `seed:vec_id`, in that order: null ids last, ties by the components' bytes. Fewer rows, fewer centroids."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("v")]
    found = rows.orderBy(*order).limit(k).select("v").collect()
    return _matrix(pd.Series([r["v"] for r in found])) if found else np.zeros((0, SIZE), np.int64)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row: a centroid at a time, in 64-bit integers; of equal distances the lowest number."""
    far = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = v - c
        far[:, k] = np.einsum("ij,ij->i", d, d)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(v)), cluster]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), -1).astype(np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Every partition adds up its own vectors, a row for each centroid and component; groupBy adds these. No more than that many sums reach the driver, which divides them exactly."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    n, size = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((n, size), np.int64), np.zeros(n, np.int64)
        for x in batches:
            if len(x):
                v = _matrix(x["v"])
                cluster, _ = _nearest(v, sent.value)
                for k in np.unique(cluster):
                    total[k] += v[cluster == k].sum(axis=0)
                    count[k] += (cluster == k).sum()
        for k in np.flatnonzero(count):
            yield pd.DataFrame({"cluster": np.int32(k), "at": np.arange(size, dtype=np.int32), "n": count[k], "s": total[k]})

    added = rows.select("v").mapInPandas(sums, "cluster int, at int, n long, s long")
    out = centroids.copy()
    for r in added.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    sent.unpersist()
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of rows (vec_id, v)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                cluster, distance = _nearest(_matrix(x["v"]), sent.value)
                yield pd.DataFrame({"vec_id": x["vec_id"].astype("Int64"), "cluster": cluster.astype(np.int32), "distance": distance})

    return rows.mapInPandas(assign, "vec_id long, cluster int, distance long")


def lloyd(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """The centroids after so many rounds, from first_centroids. A round that moves none ends them, for all later ones would be the same."""
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, moved(rows, centroids)
        if np.array_equal(before, centroids):
            break
    return centroids


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the kept vectors, as a written table, and the centroids.

    Vectors of another size, or with a null, NaN or infinite component, and null ones are left out; null and repeated ids and equal rows keep a row each; other columns aren't read; an empty
    table gives an empty one and no centroids. Equal distances: the smaller number. A centroid that no vector is nearest to stays where it is.
    """
    rows = written(kept_vectors(vectors, id_col, vec_col, size), "vectors")
    centroids = lloyd(rows, k, rounds, seed)
    out = written(assigned(rows, centroids), "assigned")
    forget(rows)
    return out, centroids


def cluster_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector; odd ones as clustered has them. Sums beyond 64 bits are null. Centroids are a row each, so their join is broadcast."""
    out, centroids = clustered(vectors)
    told = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    total = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    inertia = out.groupBy("cluster").agg(total("distance").alias("own")).withColumn("all", F.expr("CAST((SUM(own) OVER ()) AS DECIMAL(38,0))"))
    names = vectors.sparkSession.createDataFrame(told, "cluster int, centroid_sha256 string")
    each = inertia.join(F.broadcast(names), "cluster").select("cluster", F.expr("try_cast(own AS BIGINT)").alias("cluster_inertia"), F.expr("try_cast(all AS BIGINT)").alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
