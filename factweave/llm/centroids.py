"""Centroid clustering over a VA-file: few-bit cells bound the distance to every centroid, vectors are fetched where the bounds overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import materialise

DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Bits of a cell, and the most vectors that the cells' edges are fitted on, a hashed sample. Every vector is put into cells.
BITS, FIT_VECTORS = 4, 20_000
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integral(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of `vectors` (vec_id, embedding) with exactly `dimensions` components, all finite: q is floor(scale * x)."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.coalesce((F.size("embedding") == dimensions) & finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale)).alias("q"))


class Cells:
    """Edges of the cells of every dimension, outer ones included: cell c of dimension d holds the integers from edges[d, c] to edges[d, c + 1] - 1."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        inner = np.ceil(np.quantile(sample, np.linspace(0, 1, (1 << bits) + 1)[1:-1], axis=0)).astype(np.int64).T
        # An edge beyond the extremes would leave an empty cell, which is harmless.
        self.edges = np.column_stack([low, np.clip(inner, low[:, None], high[:, None] + 1), high + 1])

    def of(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(edge[1:-1], q[:, d], "right") for d, edge in enumerate(self.edges)]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared difference between each centroid's component and a value of each cell: (dimension, cell, centroid)."""
        first, last = self.edges[:, :-1, None], self.edges[:, 1:, None] - 1
        c = centroids.T[:, None, :]
        low = np.maximum(0, np.maximum(first - c, c - last))
        high = np.maximum(np.abs(first - c), np.abs(last - c))
        return low**2, high**2


def _two_a_byte(cells: np.ndarray) -> np.ndarray:
    return cells[:, 0::2] | cells[:, 1::2] << 4


def _one_a_byte(held: np.ndarray) -> np.ndarray:
    return np.stack([held & 15, held >> 4], axis=2).reshape(len(held), -1)


def _fixed(column: pa.Array, width: int, kind) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers, without copying it."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, at).reshape(len(column), width)


def exact(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((q[:, None, :] - centroids[None]) ** 2).sum(axis=2)


def assign(cells: np.ndarray, vectors: np.ndarray, centroids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """(nearest centroid of each vector, the smaller number on ties; how many vectors were fetched for it).

    A centroid whose least possible distance exceeds another's greatest is out. Only vectors with several centroids left are
    read, and measured exactly.
    """
    low, high = (np.zeros((len(cells), len(centroids)), np.int64) for _ in "ab")
    for d in range(cells.shape[1]):
        low += tables[0][d][cells[:, d]]
        high += tables[1][d][cells[:, d]]
    left = low <= high.min(axis=1)[:, None]
    out = left.argmax(axis=1)
    unsure = np.flatnonzero(left.sum(axis=1) > 1)
    for at in range(0, len(unsure), 1024):
        rows = unsure[at : at + 1024]
        distance = np.where(left[rows], exact(vectors[rows], centroids), np.iinfo(np.int64).max)
        out[rows] = distance.argmin(axis=1)
    return out, len(unsure)


def _index(cells: Cells):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held = pa.array([r.tobytes() for r in _two_a_byte(cells.of(q))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array([r.tobytes() for r in q], pa.binary())], ["vec_id", "cells", "vector"])

    return run


def _moves(cells: Cells, before: np.ndarray | None, now: np.ndarray):
    """What one task's vectors that changed their centroid add to the sums of the new one and take from the old one's: (cluster, dimension,
    total), where the number after the last dimension is the count. Vectors that stay are not read."""
    tables = cells.tables(now)
    old_tables = cells.tables(before) if before is not None else None

    def run(batches):
        k, width = now.shape
        totals, read = np.zeros((k, width + 2), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, q = _one_a_byte(_fixed(batch.column(0), width // 2, np.uint8)), _fixed(batch.column(1), width, np.int64)
            new, fetched = assign(held, q, now, tables)
            old = assign(held, q, before, old_tables)[0] if before is not None else np.full(len(new), -1)
            moved = np.flatnonzero(new != old)
            read += fetched
            for c in range(k):
                came, left = q[moved[new[moved] == c]], q[moved[old[moved] == c]]
                totals[c, :width] += came.sum(axis=0) - left.sum(axis=0)
                totals[c, width] += len(came) - len(left)
        totals[0, width + 1] = read
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), width + 2)), pa.array(np.tile(np.arange(width + 2, dtype=np.int32), k)),
                                          pa.array(totals.ravel())], ["cluster", "dimension", "total"])

    return run


def _assigned(cells: Cells, centroids: np.ndarray):
    tables = cells.tables(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                width = centroids.shape[1]
                q = _fixed(batch.column(2), width, np.int64)
                cluster, _ = assign(_one_a_byte(_fixed(batch.column(1), width // 2, np.uint8)), q, centroids, tables)
                distance = ((q - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, fit: int = FIT_VECTORS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; see `integral` for which are kept.

    The centroids start as the vectors with the smallest SHA-256 of `1:<vec_id>` (of `1:` without an id), ties by components; with
    fewer vectors there are fewer. Each round moves a centroid to the floor of its vectors' mean; an empty one stays. Equal
    distances go to the smaller number. Rows that repeat are vectors of their own. An empty table gives an empty result. Sums are
    kept in 64 bits.

    A round is one scan of the VA-file, without a shuffle but for one row of totals for each centroid and dimension. Cells and
    vectors lie in one table: a join that fetched only the needed vectors would read and shuffle that table as well. What is
    saved is the measuring: vectors that are sure of their centroid and keep it are never touched.
    """
    spark = vectors.sparkSession
    rows = integral(vectors)
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = rows.withColumn("h", hashed).orderBy("h", "q").limit(centroids).collect()
    if not seeds:
        return spark.createDataFrame([], SCHEMA)
    extremes = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("q")[d]).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(DIMENSIONS)]).first()
    low, high = (np.array([extremes[f"{name}{d}"] for d in range(DIMENSIONS)], np.int64) for name in ("low", "high"))
    wide = 1 << 30
    share = int(min(1.0, fit / extremes["n"]) * wide)
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(1), "vec_id", "q"), F.lit(wide)) < share).select("q").limit(2 * fit).toArrow()["q"].to_pylist()
    cells = Cells(np.array(sample or [r["q"] for r in seeds], np.int64), low, high)
    index = materialise(rows.mapInArrow(_index(cells), "vec_id long, cells binary, vector binary"), "va-file")
    now, before = np.array([r["q"] for r in seeds], np.int64), None
    sums = [[0] * (DIMENSIONS + 2) for _ in seeds]
    for _ in range(rounds):
        moves = index.select("cells", "vector").mapInArrow(_moves(cells, before, now), "cluster int, dimension int, total long")
        for r in moves.groupBy("cluster", "dimension").agg(F.sum("total").alias("total")).collect():  # at most centroids x (dimensions + 2)
            sums[r["cluster"]][r["dimension"]] += r["total"]
        before, now = now, np.array([[x // s[DIMENSIONS] for x in s[:DIMENSIONS]] if s[DIMENSIONS] else old for s, old in zip(sums, now.tolist(), strict=True)], np.int64)
    found = materialise(index.mapInArrow(_assigned(cells, now), "vec_id long, cluster int, distance long"), "va-assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    of_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", of_cluster([inertia.get(c, 0) for c in range(len(now))], "long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"))


def _sql() -> str:
    """The rounds written out one after the other, for vectors that all have ids of their own."""
    kept = """WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT q AS c, CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS k FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)"""
    steps = [kept]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (SELECT vec_id, any_value(q) AS q, arg_min(k, [d, k]) AS k, min(d) AS d
  FROM (SELECT vec_id, q, CAST(k AS BIGINT) AS k, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q, c)]) AS BIGINT) AS d FROM v, c{i}) GROUP BY vec_id)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT k, list(f ORDER BY p) AS c FROM (SELECT k, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f
  FROM (SELECT k, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY k, p)) GROUP BY k),
c{i + 1} AS (SELECT coalesce(m{i}.c, c{i}.c) AS c, c{i}.k FROM c{i} LEFT JOIN m{i} ON m{i}.k = c{i}.k)""")
    last = f"a{ROUNDS}"
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST({last}.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{ROUNDS} ON {last}.k = c{ROUNDS}.k"""


SQL = _sql()
