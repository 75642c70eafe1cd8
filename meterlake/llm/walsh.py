"""Centroid clustering by progressive search in the Walsh-Hadamard domain.

The transform of whole numbers by signs alone is exact and keeps squared distances up to a known factor. Of a vector and
the centroids, coefficient differences are added up from coarse to fine: what is summed so far, and the lengths of the
vectors' rests, bound every distance from both sides; the centroid that leads early on is compared in full. A centroid
whose lower bound is above another's upper bound is strictly worse and goes. The others are summed over all coefficients,
so the nearest one is exact, ties included.

The transform is linear: sums of transformed vectors are transformed sums, so rounds need the transformed vectors only.
Each task adds up its vectors by cluster, and a round brings one row a centroid to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.session import materialize

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
SEED = "1:"
#: Scaled components may be this large, so that all sums of squares are exact in 64 bits.
LARGEST = 1 << 24
#: After so many coefficients the centroid that leads is compared in full, which bounds the nearest one's distance.
LEADING = 8
#: Vectors that are compared at once.
BLOCK = 4096


@cache
def sequency(dims: int) -> np.ndarray:
    """The transform's rows from coarse to fine: by how often their signs change."""
    signs = np.array([[bin(i & j).count("1") & 1 for j in range(dims)] for i in range(dims)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def butterflies(vectors: np.ndarray) -> np.ndarray:
    n, dims = vectors.shape
    half = 1
    while half < dims:
        pairs = vectors.reshape(n, -1, 2, half)
        vectors = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, dims)
        half *= 2
    return vectors


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients of whole-number vectors (a row each), coarse ones first."""
    return butterflies(vectors)[:, sequency(vectors.shape[1])]


def inverse(spectra: np.ndarray) -> np.ndarray:
    dims = spectra.shape[1]
    natural = np.empty_like(spectra)
    natural[:, sequency(dims)] = spectra
    return butterflies(natural) // dims


def nearest(spectra: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (the first of equals), its squared distance, and how many coefficients were compared."""
    n, dims = spectra.shape
    so_far = np.zeros((n, len(centroids)), np.int64)
    open_ = np.ones(so_far.shape, bool)
    reached = np.full(n, np.inf)
    start, compared = 0, 0
    while start < dims:
        end = max(1, 2 * start)
        row, c = np.nonzero(open_)
        gap = spectra[row, start:end] - centroids[c, start:end]
        so_far[row, c] += (gap * gap).sum(1)
        compared += gap.size
        if end == LEADING:
            leader = np.where(open_, so_far, np.iinfo(np.int64).max).argmin(1)
            gap = spectra[:, end:] - centroids[leader, end:]
            reached = (so_far[np.arange(n), leader] + (gap * gap).sum(1)) * (1 + 1e-9) + 1
            compared += gap.size
        if end < dims:
            rest_v = np.sqrt((spectra[:, end:].astype(float) ** 2).sum(1))[:, None]
            rest_c = np.sqrt((centroids[:, end:].astype(float) ** 2).sum(1))[None, :]
            # widened by more than the rounding of these floats
            least = so_far + (rest_v - rest_c) ** 2 * (1 - 1e-9) - 1e-9 * (so_far + (rest_v + rest_c) ** 2) - 1
            most = so_far + (rest_v + rest_c) ** 2 * (1 + 1e-9) + 1e-9 * so_far + 1
            open_ &= least <= np.minimum(reached, np.where(open_, most, np.inf).min(1))[:, None]
        start = end
    whole = np.where(open_, so_far, np.iinfo(np.int64).max)
    cluster = whole.argmin(1)
    return cluster, whole[np.arange(n), cluster] // dims, compared


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch and their column ``spectrum`` as rows of an array."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, part.column("spectrum").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def whole_numbers(vector: Column, dims: int, scale: int) -> Column:
    """``vector`` as an array of floor(scale * component), or null where it has another length or a null or non-finite one."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = (F.size(vector) == dims) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall(doubles, lambda x: F.abs(x * scale) < LARGEST)
    scaled = F.transform(doubles, lambda x: F.floor(x * scale).cast("int"))
    return F.when(F.coalesce(fine, F.lit(False)), F.when(fits, scaled).otherwise(
        F.raise_error(F.lit(f"scaled components must be below {LARGEST}")).cast("array<int>")))


def spectra(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """key, values, spectrum (array<int>) of the kept vectors."""
    kept = vectors.select(F.col(f"`{key}`").alias("key"), whole_numbers(F.col(f"`{vector}`"), dims, scale).alias("values")).where("values IS NOT NULL")
    schema = T.StructType([*kept.schema.fields, T.StructField("spectrum", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            made = transform(values).astype(np.int32).ravel()
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(made) + 1, dims), pa.int32()), pa.array(made))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("values"), column], names=["key", "values", "spectrum"])

    return kept.mapInArrow(run, schema)


def cluster_sums(data: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, sums of their coefficients) of each centroid that has any, added up in the tasks first."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, found in blocks(batches, dims):
            cluster = nearest(found, centroids)[0]
            np.add.at(sums, cluster, found)
            counts += np.bincount(cluster, minlength=k)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has]), pa.array(sums[has].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = data.select("spectrum").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dims))).alias("sums"))
    return [(r.cluster, r.n, r.sums) for r in total.collect()]  # a row a centroid


def first_centroids(data: DataFrame, k: int, seed: str) -> np.ndarray:
    """Spectra of the ``k`` vectors with the least sha256 of seed and key, ascending; equal keys by their components."""
    rank = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = data.select(rank.alias("rank"), "values", "spectrum").orderBy("rank", "values").limit(k).collect()
    return np.array([r.spectrum for r in rows], np.int64)


def assign(data: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, cluster, distance of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in blocks(batches, dims):
            cluster, distance, _ = nearest(found, centroids)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"])

    data = data.select("key", "spectrum")
    return data.mapInArrow(run, T.StructType([data.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
                    dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every kept vector, and the centroids' whole-number components.

    ``dims`` is a power of two. Kept are vectors of ``dims`` components, none null or non-finite; their components become
    floor(scale * x). Rows with equal keys are vectors of their own; a null key counts as the empty text where keys are
    hashed. With fewer vectors than ``k`` each is a first centroid; without any there are no rows and no centroids.
    Scaled components of ``LARGEST`` or more raise an error, for their distances need not fit 64 bits.
    """
    data = materialize(spectra(vectors, key, vector, dims, scale), "spectra")
    centroids = first_centroids(data, k, seed)
    if not len(centroids):
        return data.selectExpr("key", "0 AS cluster", "0L AS distance"), np.empty((0, dims), np.int64)
    for _ in range(rounds):
        values = inverse(centroids)
        for c, n, sums in cluster_sums(data, centroids):
            values[c] = inverse(np.array([sums], np.int64))[0] // n
        centroids = transform(values)
    return assign(data, centroids), inverse(centroids)


def op13(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of ``embeddings``."""
    assigned, centroids = cluster_vectors(vectors)
    assigned = materialize(assigned, "assigned")
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    rows = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("key", "vec_id").join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def assignment_sql(of: str, name: str) -> str:
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"{name} AS (SELECT k.at, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': {square}, 'c': c.c}}) AS best FROM kept k CROSS JOIN {of} c GROUP BY k.at)"


def round_sql(r: int) -> str:
    """Centroids c<r + 1> from c<r>."""
    return f"""{assignment_sql(f"c{r}", f"a{r}")},
    p{r} AS (SELECT best.c AS c, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{r}, range(1, {DIMS + 1}) t(i) GROUP BY 1, 2),
    c{r + 1} AS (SELECT c.c, coalesce((SELECT list(x ORDER BY i) FROM p{r} p WHERE p.c = c.c), c.v) AS v FROM c{r} c)"""


SQL = f"""WITH kept AS (
    SELECT row_number() OVER () AS at, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
    s AS (SELECT sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept),
    c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT * FROM s ORDER BY h, v LIMIT {CENTROIDS})),
    {", ".join(round_sql(r) for r in range(ROUNDS))},
    {assignment_sql(f"c{ROUNDS}", "a")}
SELECT a.vec_id, a.best.c AS cluster, CAST(a.best.d AS BIGINT) AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} c ON c.c = a.best.c"""
