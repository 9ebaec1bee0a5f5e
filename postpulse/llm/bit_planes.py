"""Centroid clustering of 64-component integer vectors held as bit planes.

Component x becomes floor(scale * x). Plane i of a vector is one 64-bit word whose bit c is
bit i of component c in two's complement, so ``dot(v, z) = sum_ij w_i w_j popcount(v_i & z_j)``
with w_i = 2^i and a negative weight for the last plane, the sign. Squared distances follow from
the dot product and both norms; everything is integer arithmetic, so nothing depends on the order
of rows. A vector keeps as many planes as its own components need (11 within +-1).

The planes are written once and read by every round. A round is one scan: each task adds up its
own vectors per centroid, so k partial sums a task are what moves, and only the k centroids
(k x 64 numbers) reach the driver. No row is shuffled, whatever many rows are equal.

Defined results: a vector that is null, has another length, or holds a null or non-finite
component is left out; repeated rows count each; rows of equal id are ordered by their planes
when first centroids are chosen; a null id hashes as the empty string; fewer vectors than ``k``
give as many centroids; an empty table gives an empty result. Components beyond +-2^27 after
scaling raise ValueError: their squared distance may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import landed

DIMS = 64
LARGEST = 1 << 27
STEP = 4096              # vectors compared at a time


def widths(values: np.ndarray) -> np.ndarray:
    """Planes that each vector needs, the sign among them."""
    largest = np.maximum(values, ~values).max(axis=1, initial=0)
    return np.frexp(largest.astype(np.float64))[1].astype(np.int64) + 1


def to_planes(values: np.ndarray) -> np.ndarray:
    """(n, 64) integers as (n, planes) words of 64 bits, the last plane being the sign."""
    bits = (values[:, None, :] >> np.arange(widths(values).max(initial=1))[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(n: int) -> np.ndarray:
    w = np.int64(1) << np.arange(n, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integers again."""
    out = np.zeros((len(planes), DIMS), dtype=np.int64)
    for i, w in enumerate(weights(planes.shape[1])):
        raw = np.ascontiguousarray(planes[:, i]).view(np.uint8).reshape(-1, 8)
        out += w * np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
    return out


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of every vector of ``a`` with every one of ``b``, both as planes."""
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for i, wi in enumerate(wa):
        for j, wj in enumerate(wb):
            out += wi * wj * np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64)
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """Exact squared lengths, by popcounts of a vector's planes with each other."""
    w = weights(planes.shape[1])
    out = np.zeros(len(planes), dtype=np.int64)
    for i, wi in enumerate(w):
        for j in range(i, len(w)):
            n = np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
            out += (1 if i == j else 2) * wi * w[j] * n
    return out


class Centroids:
    """k integer vectors with their planes and norms."""

    def __init__(self, values: list[list[int]]):
        self.values = np.array(values, dtype=np.int64).reshape(-1, DIMS)
        self.planes = to_planes(self.values)
        self.norms = norms(self.planes)

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller one) and the squared distance."""
        number, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(planes), STEP):
            part = planes[lo:lo + STEP]
            d = norms(part)[:, None] - 2 * dot_products(part, self.planes) + self.norms
            best = d.argmin(axis=1)
            number.append(best)
            distance.append(d[np.arange(len(part)), best])
        return np.concatenate(number), np.concatenate(distance)

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.values[i].tolist())).encode()).hexdigest()


def pack_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, planes) of the rows whose vector is whole."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"),
                     F.col(vector_col).cast("array<double>").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch["vector"]), DIMS))
            x = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            good = np.isfinite(x.astype(np.float64)).all(axis=1)      # a null reads as NaN
            x = np.floor(scale * x[good].astype(np.float64))
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST} after scaling")
            values = x.astype(np.int64)
            planes, wide = to_planes(values), widths(values)
            flat = planes[np.arange(planes.shape[1]) < wide[:, None]].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)
            yield pa.record_batch({
                "vec_id": batch["vec_id"].filter(pa.array(good)),
                "planes": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return rows.mapInArrow(pack, "vec_id long, planes array<long>")


def plane_groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, planes) of a batch, one group per number of planes."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).view("<u8")
    ends = np.cumsum(sizes)
    for p in np.unique(sizes):
        rows = np.flatnonzero(sizes == p)
        yield rows, flat[(ends[rows] - p)[:, None] + np.arange(p)]


def first_centroids(packed: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of seed and id."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = packed.select(key.alias("key"), "planes").orderBy("key", "planes").limit(k).collect()
    return [from_planes(np.array([r["planes"]], dtype=np.int64).view("<u8"))[0].tolist()
            for r in rows]


def sums_by_centroid(packed: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and componentwise sums per centroid; k rows a task are shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.values)
        n, sums = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for batch in batches:
            for _, planes in plane_groups(batch["planes"]):
                number, _ = centroids.nearest(planes)
                n += np.bincount(number, minlength=k)
                values = from_planes(planes)
                for c in np.unique(number):
                    sums[c] += values[number == c].sum(axis=0)
        yield pa.record_batch({"cluster": pa.array(range(k), pa.int32()), "n": pa.array(n),
                               "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    parts = packed.select("planes").mapInArrow(add, "cluster int, n long, sums array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(DIMS)]).alias("sums"))
    return {r["cluster"]: (r["n"], [int(x) for x in r["sums"]]) for r in whole.collect()}


def assign(packed: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) per vector."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.zeros(batch.num_rows, np.int32)
            distance = np.zeros(batch.num_rows, np.int64)
            for rows, planes in plane_groups(batch["planes"]):
                number[rows], distance[rows] = centroids.nearest(planes)
            yield pa.record_batch({"vec_id": batch["vec_id"], "cluster": pa.array(number),
                                   "distance": pa.array(distance)})

    return packed.mapInArrow(place, "vec_id long, cluster int, distance long")


def cluster_vectors(spark: SparkSession, df: DataFrame, k: int, rounds: int, seed: str = "",
                    scale: int = 1024, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """Lloyd's rounds from hashed first centroids, then one more assignment.

    Returns per kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256 (of the components as decimal integers joined by ``,``), cluster_size.
    """
    packed = landed(spark, pack_vectors(df, id_col, vector_col, scale), "bit-planes")
    columns = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
               "centroid_sha256 string, cluster_size long")
    start = first_centroids(packed, k, seed)
    if not start:
        return spark.createDataFrame([], columns)
    centroids = Centroids(start)
    for _ in range(rounds):
        values = centroids.values.tolist()
        for c, (n, sums) in sums_by_centroid(packed, centroids).items():
            if n:
                values[c] = [s // n for s in sums]
        if values == centroids.values.tolist():
            break                      # every further round would give the same
        centroids = Centroids(values)
    placed = landed(spark, assign(packed, centroids), "bit-plane-clusters")
    found = placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"),
        F.count(F.lit(1)).alias("n")).collect()        # k rows
    per = [(r["cluster"], int(r["inertia"]), r["n"], centroids.digest(r["cluster"])) for r in found]
    stats = spark.createDataFrame(per, "cluster int, cluster_inertia long, cluster_size long, "
                                       "centroid_sha256 string")
    total = F.lit(sum(p[1] for p in per)).cast("long").alias("inertia")
    return placed.join(F.broadcast(stats), "cluster").select(       # k rows, a parameter
        "vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256",
        "cluster_size")
