"""Clustering of 64-dimensional vectors around centroids, by bit planes and popcounts.

The components are integers. Bit b of all 64 components of a vector is packed into one unsigned
64-bit number, the plane b; the highest plane is that of the sign and weighs -2^b. The dot product
of two vectors is the sum over pairs of planes of weight times weight times popcount(plane AND
plane), and distances follow from dot products: exact integers throughout, in any order of summing.

How many planes there are follows from the least and greatest component of all vectors. Planes are
written once; a round is one scan of them. Each task keeps one sum per centroid and component, so a
round shuffles some hundred numbers per task and the driver sees no vector but the centroids.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newstide.llm.vectors import extent, finite, scaled
from newstide.sources.layout import written

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
# Vectors whose popcounts are in memory at once.
ROWS = 2048


def plane_count(low: int, high: int) -> int:
    """Bits of two's complement that hold ``low`` and ``high``."""
    return max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1


def plane_weights(n: int) -> np.ndarray:
    weights = np.left_shift(np.int64(1), np.arange(n, dtype=np.int64))
    weights[-1] = -weights[-1]
    return weights


def to_planes(vectors: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) unsigned planes of (rows, 64) integers; component k is bit k."""
    bits = (vectors[:, None, :] >> np.arange(n, dtype=np.int64)[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(len(vectors), n)


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integer vectors of their planes."""
    rows, n = planes.shape
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(rows, n, 8), axis=2,
                         bitorder="little")
    return np.einsum("rbk,b->rk", bits.astype(np.int64), plane_weights(n))


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot product of each row with ``other``: planes of one vector, or one row of them each."""
    other = other[:, None, :] if other.ndim == 2 else other
    weights = plane_weights(planes.shape[1])
    counts = np.bitwise_count(planes[:, :, None] & other).astype(np.int64)
    return (counts @ weights) @ weights


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equals) and |c|^2 - 2 v.c of it."""
    centroid_planes = to_planes(centroids, planes.shape[1])
    norms = (centroids * centroids).sum(axis=1)
    lead = np.stack([norm - 2 * dots(planes, one)
                     for norm, one in zip(norms, centroid_planes)], axis=1)
    cluster = lead.argmin(axis=1)
    return cluster, np.take_along_axis(lead, cluster[:, None], axis=1)[:, 0]


def _blocks(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for start in range(0, len(column), ROWS):
        part = column.slice(start, ROWS).to_pylist()
        yield np.frombuffer(b"".join(part), "<u8").reshape(len(part), n)


def _packer(n: int):
    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        out = []
        for start in range(0, len(vectors), ROWS):
            part = vectors.slice(start, ROWS).flatten().to_numpy(zero_copy_only=False)
            out += [row.tobytes() for row in to_planes(part.reshape(-1, WIDTH), n)]
        return pa.array(out, pa.binary())

    return pack


def _sums(n: int, centroids: np.ndarray):
    """Per task one row per non-empty cluster: number of vectors and sums of components."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), WIDTH), np.int64)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for planes in _blocks(batch.column(0), n):
                cluster, _ = nearest(planes, centroids)
                np.add.at(total, cluster, from_planes(planes))
                count += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used], pa.int64()),
             pa.array(total[used].tolist(), pa.list_(pa.int64()))], schema=schema)

    return sums


def moved(planes: DataFrame, n: int, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; empty ones stay."""
    parts = planes.select("planes").mapInArrow(_sums(n, centroids),
                                               "cluster int, n bigint, sums array<bigint>")
    found = (parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
             .groupBy("cluster", "at").agg(F.sum("part").alias("total"), F.sum("n").alias("n")))
    out = centroids.copy()
    for row in found.collect():  # a number per centroid and component
        out[row["cluster"], row["at"]] = row["total"] // row["n"]
    return out


def _assign(n: int, centroids: np.ndarray):
    kind = pa.struct([("cluster", pa.int32()), ("distance", pa.int64())])

    @F.arrow_udf("cluster int, distance bigint")
    def assign(planes: pa.Array) -> pa.Array:
        clusters, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in _blocks(planes, n):
            cluster, lead = nearest(block, centroids)
            clusters.append(cluster)
            distances.append(lead + dots(block, block))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(clusters), pa.int32()),
             pa.array(np.concatenate(distances), pa.int64())], fields=list(kind))

    return assign


def cluster_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE,
                    seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of 64 components, none null, NaN or infinite; component x becomes
    floor(scale * x). The ``k`` vectors whose ids have the smallest SHA-256 of ``seed:id`` are the
    first centroids (equal ids: the smaller vector first; rows without an id are kept and assigned
    but never a first centroid, unless too few rows have one). With fewer kept vectors there are
    fewer centroids, with none no rows. Rounds end early once nothing moves, as later ones would
    change nothing. Repeated rows count each. Scaled components have to be within 2^27 of 0, else
    a ``ValueError`` says so.
    """
    vector = embeddings[vector_col]
    whole = F.when(F.size(vector) == WIDTH, finite(vector)).otherwise(False)
    kept = (embeddings.where(whole)
            .select(embeddings[id_col].alias("vec_id"), scaled(vector, scale).alias("v")))
    n = plane_count(*extent(kept, "v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = (kept.withColumn("digest", digest)
             .orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect())
    planes = written(kept.select("vec_id", _packer(n)("v").alias("planes")), "planes")
    if not first:
        return planes.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), []
    centroids = np.array([row["v"] for row in first], np.int64)
    for _ in range(rounds):
        before, centroids = centroids, moved(planes, n, centroids)
        if np.array_equal(before, centroids):
            break
    found = planes.withColumn("a", _assign(n, centroids)("planes")).select("vec_id", "a.*")
    return found, centroids.tolist()


def clusters_with_inertia(embeddings: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256; nulls, ties, repeated rows and empty tables as in ``cluster_vectors``."""
    found, centroids = cluster_vectors(embeddings, **options)
    found = written(found, "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint")
    inertia = {row["cluster"]: row["inertia"] for row in
               found.groupBy("cluster").agg(total.alias("inertia")).collect()}

    def per_cluster(values: dict, kind: str):
        pairs = [F.lit(x) for key in sorted(values) for x in (key, values[key])]
        made = F.create_map(*pairs) if pairs else F.create_map()
        return made.cast(f"map<int,{kind}>")[F.col("cluster")]

    digests = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
               for k, c in enumerate(centroids)}
    return found.select("vec_id", "cluster", "distance",
                        per_cluster(inertia, "bigint").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
                        per_cluster(digests, "string").alias("centroid_sha256"))
