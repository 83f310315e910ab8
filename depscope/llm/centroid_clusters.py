"""Clusters of vectors around centroids of whole numbers: float32 screening, exact decisions.

Vectors become whole numbers, floor(scale * x) for each component, and everything that decides is exact: distances and
sums are 64-bit integers, so the result doesn't depend on the machine, the partitions or the order of rows.

1. Vectors are checked and rounded by native columns and written once.
2. Each round is one pass. A task holds some thousand vectors as a float32 matrix and multiplies it with all centroids.
   |q - c|^2 without |q|^2, which all centroids share, is |c|^2 - 2 q.c. A float32 product of length n is off by at most
   g * |q| * |c|, g = n'u / (1 - n'u) with u = 2^-24 and n' = n + 2 (two roundings when whole numbers become floats),
   in whatever order it is summed. That gives each centroid an interval that holds its true value.
3. Centroids whose interval starts above the least upper end are out. Where one is left, it is the nearest. Else the
   distances to all that are left are computed in integers, and of equal ones the lowest number wins.
4. Tasks emit a count and sums for each centroid, one row each; Spark adds them. Only the centroids pass the driver.

Defined cases: a vector that is null, of another length, or with a null or non-finite component is not kept; a vector
whose number is null is kept, but is a first centroid only after all others; equal numbers are told apart by their
components, and repeated rows count each for itself; fewer vectors than centroids give as many centroids as there are
vectors; an empty table gives an empty result; components beyond 2^27 in whole numbers raise, since squared distances
would leave 64 bits; columns of any name are left out by the operator, which reads two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import picked
from .scratch import written

#: Whole numbers up to this keep squared distances of some thousand components within 64 bits.
MOST = 1 << 27
#: Vectors in a matrix.
BLOCK = 4096
_UNIT = 2.0**-24
#: Roundings in double precision are covered many times over.
_SLACK = 1 + 2.0**-40


def whole_vectors(vectors: DataFrame, size: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, q): the kept vectors in whole numbers."""
    source = picked(vectors, id_col, vector_col).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    good = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # false for NaN too
    large = lambda x: F.abs(x) * scale > MOST - 1
    whole = lambda x: F.when(large(x), F.raise_error(F.lit(f"a component is beyond {MOST} in whole numbers")).cast("int")).otherwise(F.floor(x * scale).cast("int"))
    return source.where((F.size("vector") == size) & good).select("id", F.transform("vector", whole).alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of their numbers, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.select("q", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of q, both exact; of equal ones the lowest number."""
    size = q.shape[1]
    gamma = (size + 2) * _UNIT / (1 - (size + 2) * _UNIT)
    norms = np.einsum("ij,ij->i", centroids, centroids)
    product = (q.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    value = norms.astype(np.float64) - 2 * product
    own = np.sqrt(np.einsum("ij,ij->i", q, q).astype(np.float64)) * _SLACK
    other = np.sqrt(norms.astype(np.float64)) * _SLACK
    # the product's error twice, and that of three roundings to double
    error = (2 * gamma * _SLACK * own)[:, None] * other + (norms.astype(np.float64) + 2 * np.abs(product)) * 2.0**-50
    left = value - error <= (value + error).min(1)[:, None]
    row, number = np.nonzero(left)  # by row, then by number
    gap = q[row] - centroids[number]
    distance = np.einsum("ij,ij->i", gap, gap)
    first = np.searchsorted(row, np.arange(len(q)))
    least = np.minimum.reduceat(distance, first)
    at = np.flatnonzero(distance == least[row])
    at = at[np.searchsorted(row[at], np.arange(len(q)))]
    return number[at], distance[at]


def _matrices(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            yield piece, piece.column(at).flatten().to_numpy().astype(np.int64).reshape(-1, size)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the mean of its vectors, rounded down; those without vectors stay."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, q in _matrices(batches, 0, size):
            number, _ = nearest(q, centroids)
            order = np.argsort(number, kind="stable")
            present, first = np.unique(number[order], return_index=True)
            total[present] += np.add.reduceat(q[order], first)
            count += np.bincount(number, minlength=k)
        seen = np.flatnonzero(count)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), *[pa.array(total[seen, j]) for j in range(size)]], names=["number", "n", *[f"s{j}" for j in range(size)]])

    schema = "number long, n long, " + ", ".join(f"s{j} long" for j in range(size))
    sums = kept.select("q").mapInArrow(run, schema).groupBy("number").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(size)])
    out = centroids.copy()
    for row in sums.collect():
        out[row["number"]] = np.array(row[2:], np.int64) // row["n"]
    return out


def clusters(vectors: DataFrame, k: int, rounds: int, size: int, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((id, cluster, distance) of every kept vector, (cluster, n, cluster_inertia, inertia, centroid) of every centroid with vectors)."""
    spark = vectors.sparkSession
    kept = written(whole_vectors(vectors, size, scale, id_col, vector_col), "whole-vectors", 4096)
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, q in _matrices(batches, 1, size):
            number, distance = nearest(q, centroids)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
        for _, q in _matrices(batches, 0, size):
            number, distance = nearest(q, centroids)
            np.add.at(count, number, 1)
            np.add.at(inertia, number, distance)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), pa.array(inertia[seen])], names=["number", "n", "inertia"])

    found = kept.mapInArrow(assign, f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long")
    sums = kept.select("q").mapInArrow(totals, "number long, n long, inertia long").groupBy("number").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).collect()
    whole = sum(r["inertia"] for r in sums)
    rows = [(int(r["number"]), r["n"], r["inertia"], whole, [int(x) for x in centroids[r["number"]]]) for r in sums]
    return found, spark.createDataFrame(rows, "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>")


K, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, about = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), K, ROUNDS, SIZE, SCALE, SEED)
    # one row for each of the 16 centroids
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    about = F.broadcast(about.select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256")))
    return found.join(about, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds() -> str:
    """The passes as SQL: pairs of a vector and a centroid, the nearest by (distance, number), means rounded down."""
    pair = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = []
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, min({{'d': d, 'c': c}}) AS best FROM (SELECT v.rid, c.c, {pair} AS d FROM v, c{i} c) GROUP BY rid)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT best.c AS c, j, count(*) AS n, CAST(sum(q[j]) AS BIGINT) AS s FROM a{i} JOIN v USING (rid), (SELECT unnest(range(1, {SIZE} + 1)) AS j) GROUP BY 1, 2)")
            parts.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM s{i} GROUP BY 1)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))")
    return ", ".join(parts)


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v ORDER BY 1 LIMIT {K}),
{_rounds()},
t AS (SELECT best.c AS c, CAST(sum(best.d) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY 1)
SELECT v.vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM t) AS BIGINT) AS inertia,
    sha256(array_to_string(z.q, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (rid) JOIN t ON t.c = best.c JOIN c{ROUNDS} z ON z.c = best.c
"""
