"""Nearest neighbours by adaptive dimension scan: lists of rotated vectors in column blocks, candidates given up early."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.session import materialise

#: Most vectors the lists are fitted on, a hashed sample; every vector is put into a list.
FIT_VECTORS = 20_000
MOST_LISTS = 4_096
PROBES = 32
#: Share of the lists that a query probes at least, or its neighbours are lost as the lists grow in number.
PROBE_SHARE = 0.75
BLOCK_VECTORS = 4_096
COLUMNS = 16
#: Slack of the test: a larger value gives up later.
EPSILON = 2.1
NEAREST = 10
SEED = 3


def usable(vectors: DataFrame) -> DataFrame:
    """`vectors` (vec_id, embedding) that take part: not null, of finite components that are not all zero, with an id."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False)))


def fit_lists(vectors: DataFrame, count: int, most: int = FIT_VECTORS, seed: int = SEED) -> np.ndarray:
    """Centres of about sqrt(count) lists by k-means on the sample."""
    wide = 1 << 30
    share = int(min(1.0, most / max(1, count)) * wide)
    sample = vectors.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(wide)) < share).select("vec_id", "embedding").toArrow()
    data = np.array(sample["embedding"].to_pylist(), float)
    if not len(data):
        data = np.array(vectors.select("embedding").limit(1).toArrow()["embedding"].to_pylist(), float)
    data = np.unique(data, axis=0)
    lists = max(1, min(MOST_LISTS, math.isqrt(count), len(data)))
    centres = data[np.random.default_rng(seed).permutation(len(data))[:lists]]
    for _ in range(10):
        near = _nearest(data, centres, 1)[:, 0]
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=lists)
        np.add.at(sums, near, data)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(data: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros((len(data), count), np.int64)
    norms = (centres**2).sum(axis=1)
    for at in range(0, len(data), 4096):
        distance = norms - 2 * data[at : at + 4096] @ centres.T
        out[at : at + 4096] = np.argsort(distance, axis=1, kind="stable")[:, :count]
    return out


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scan(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, turned: list[np.ndarray], turn: np.ndarray, nearest: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of one block, by (distance, id). `turned` holds the rotated vectors in blocks of columns.

    After each block of columns, a candidate whose distance so far, scaled up to all dimensions, exceeds the distance of the
    nearest-th by more than chance allows is given up. What is left is measured on the original vectors.
    """
    q = query @ turn
    dimensions = len(query)
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    for at in range(0, len(ids), 512):
        alive = np.arange(at, min(at + 512, len(ids)))
        limit = best_d[nearest - 1] if len(best_d) >= nearest else np.inf
        if np.isfinite(limit):
            partial, done = np.zeros(len(alive)), 0
            for block in turned[:-1]:
                width = block.shape[1]
                partial += ((block[alive] - q[done : done + width]) ** 2).sum(axis=1)
                done += width
                keep = partial * (dimensions / done) <= (limit * (1 + epsilon / math.sqrt(done))) ** 2
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        alive = alive[ids[alive] != own]
        if not len(alive):
            continue
        best_d = np.append(best_d, np.sqrt(((vectors[alive] - query) ** 2).sum(axis=1)))
        best_i = np.append(best_i, ids[alive])
        order = np.lexsort((best_i, best_d))[:nearest]
        best_d, best_i = best_d[order], best_i[order]
    return best_d, best_i


def search(vectors: DataFrame, every: int = 100, nearest: int = NEAREST, probes: int | None = None, epsilon: float = EPSILON, block_vectors: int = BLOCK_VECTORS,
           seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `nearest` candidates of each query, a vector whose vec_id is divisible by `every`.

    Vectors of another length than the most frequent take no part. Lists are dealt in hashed blocks of about `block_vectors`, so
    a list that holds most vectors is many tasks; a query goes to each block of the lists it probes, and every block returns its
    nearest, which are ranked by (score, vec_id). By default PROBE_SHARE of the lists are probed, and PROBES at least. With at
    most `probes` lists the search is complete.
    """
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    dimensions, count = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("embedding") == dimensions)
    centres = fit_lists(rows, count, seed=seed)
    probed = min(probes or max(PROBES, math.ceil(PROBE_SHARE * len(centres))), len(centres))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                data = np.array(batch.column(1).values.to_numpy(zero_copy_only=False)).reshape(-1, dimensions)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                lists = _nearest(data, centres, probed)
                asks = ids % every == 0
                to = pa.array([row if ask else row[:1] for row, ask in zip(lists.tolist(), asks.tolist(), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), to], ["vec_id", "embedding", "lists"])

    index = materialise(rows.mapInArrow(assign, "vec_id long, embedding array<double>, lists array<long>"), "index")
    blocks = index.groupBy(F.col("lists")[0].alias("list")).agg(F.ceil(F.count(F.lit(1)) / block_vectors).cast("int").alias("blocks"))
    placed = index.select("vec_id", "embedding", F.col("lists")[0].alias("list")).join(blocks, "list")
    placed = placed.select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "embedding")
    asked = index.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.explode("lists").alias("list")).join(blocks, "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    turn = rotation(dimensions, seed)

    def search_block(held: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if held.num_rows and queries.num_rows:
            ids = held["vec_id"].to_numpy()
            data, wanted = (np.array(c.combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(-1, dimensions) for c in (held["embedding"], queries["query"]))
            turned = [np.ascontiguousarray((data @ turn[:, at : at + COLUMNS])) for at in range(0, dimensions, COLUMNS)]
            for query, own in zip(wanted, queries["query_id"].to_pylist(), strict=True):
                distances, found = scan(query, own, ids, data, turned, turn, nearest, epsilon)
                out[0].extend([own] * len(found))
                out[1].extend(found.tolist())
                out[2].extend(distances.tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = placed.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInArrow(search_block, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
