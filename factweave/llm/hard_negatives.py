"""Hard-negative mining by lists that the anchors of a cluster share, sorted by an angular upper bound and walked until that certifies the end."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.session import materialise

EVERY, SHIFTED, SCALE, POSITIVES, NEGATIVES = 50, 7, 256, 5, 3
#: Most anchors that the clusters are fitted on, a hashed sample, and most clusters.
FIT_ANCHORS, MOST_CLUSTERS = 20_000, 16
#: A list is walked in segments, each GROWTH times as long as all before, the first of about FIRST rows.
FIRST, GROWTH = 1_024, 8
#: Rows of a list, and members of a cluster, that one task compares at a time.
BLOCK_ROWS, PACK_MEMBERS = 8_192, 1_024
SEED = 5
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LEAST, _MOST = -(1 << 62), 1 << 62


def integral(vectors: DataFrame, shifted: int = SHIFTED, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, one for each vec_id: q is floor(scale * x), the label is shifted where vec_id is divisible."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(e, lambda x: F.floor(x * scale)).alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.int64, len(column) * width, at).reshape(len(column), width) if len(column) else np.zeros((len(column), width), np.int64)


def _flat(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def fit_clusters(anchors: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """Directions of at most `count` clusters, by spherical k-means."""
    size = np.linalg.norm(anchors, axis=1)
    data = np.unique(anchors[size > 0] / size[size > 0, None], axis=0)
    if not len(data):
        return np.zeros((1, anchors.shape[1]))
    centres = data[np.random.default_rng(seed).permutation(len(data))[:count]]
    for _ in range(10):
        near = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def bounds(vectors: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """What no inner product of a row with a member of length one of each cluster exceeds: the row's length times the cosine of its
    angle to the centre less the widest angle of a member. A little is added for rounding."""
    data = vectors.astype(float)
    size = np.linalg.norm(data, axis=1)
    cosine = (data @ centres.T) / np.where(size > 0, size, 1)[:, None]
    angle = np.arccos(np.clip(cosine, -1, 1))
    return size[:, None] * (np.cos(np.clip(angle - reach[None], 0, math.pi)) + 1e-9)


def inner(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products: in doubles where all sums are below 2^53, in integers otherwise."""
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if small else a @ b.T


def walk(rows: dict, members: dict, same: bool, most: int, small: bool) -> tuple[list, list, list, list]:
    """(anchor, need, vec_id, score) of the best `most` rows of one block for each need of each member.

    `rows` are sorted by bound. A member reads them down to the first whose bound is below all it still needs: the rest can't
    reach that score.
    """
    out: tuple[list, list, list, list] = ([], [], [], [])
    best = members["best"]
    wanted = np.array([min(b) for b in best], float)
    limit = np.where(members["size"] > 0, wanted / np.where(members["size"] > 0, members["size"], 1), np.where(wanted > 0, np.inf, -np.inf))
    ends = np.searchsorted(-rows["bound"], -limit, "right")
    order = np.argsort(-ends, kind="stable")
    for at in range(0, len(order), 256):
        group = order[at : at + 256]
        group = group[ends[group] > 0]
        if not len(group):
            break
        scores = inner(members["vector"][group], rows["vector"][: ends[group[0]]], small)
        for u, score in zip(group.tolist(), scores, strict=True):
            end = ends[u]
            score, ids = score[:end], rows["vec_id"][:end]
            fits = (rows["label"][:end] == members["label"][u]) == same
            fits &= (ids != members["vec_id"][u]) & (score >= min(best[u]))
            fits = np.flatnonzero(fits)
            for need, cap, least in zip(members["need"][u], members["cap"][u], best[u], strict=True):
                found = fits[(score[fits] <= cap) & (score[fits] >= least)]
                if len(found) > most:
                    edge = np.partition(score[found], len(found) - most)[len(found) - most]
                    found = found[score[found] >= edge]
                found = found[np.lexsort((ids[found], -score[found]))[:most]]
                out[0].extend([members["vec_id"][u]] * len(found))
                out[1].extend([need] * len(found))
                out[2].extend(ids[found].tolist())
                out[3].extend(score[found].tolist())
    return out


class Lists:
    """The shared list of every cluster, and its members. A list is not written out: a row knows its bound in each list, from which
    follow the segment it lies in and whether any member may still need it."""

    def __init__(self, rows: DataFrame, every: int, first: int, growth: int, block_rows: int, pack_members: int, most_clusters: int):
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width"), F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("most"),
                         F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
        self.count, self.width, self.anchors = facts["n"], max(1, facts["width"] or 0), facts["anchors"]
        self.small = (facts["most"] or 0) ** 2 * self.width < 1 << 53
        self.block_rows, self.pack_members = block_rows, pack_members
        if not self.anchors:
            return
        width = self.width
        wide = 1 << 30
        chosen = rows.filter((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(wide)) < int(min(1.0, FIT_ANCHORS / self.anchors) * wide)))
        padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))
        sample = np.array(chosen.select(padded.alias("q")).limit(2 * FIT_ANCHORS).toArrow()["q"].to_pylist(), float).reshape(-1, width)
        centres = fit_clusters(sample if len(sample) else np.zeros((1, width)), max(1, min(most_clusters, math.isqrt(self.anchors))))

        def members(batches):
            for batch in batches:
                q = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(batch.num_rows, width)
                size = np.linalg.norm(q.astype(float), axis=1)
                cosine = q @ centres.T / np.where(size > 0, size, 1)[:, None]
                cluster = cosine.argmax(axis=1)
                angle = np.where(size > 0, np.arccos(np.clip(cosine[np.arange(len(q)), cluster], -1, 1)), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _flat(q), pa.array(size * (1 + 1e-9)), pa.array(cluster.astype(np.int32)), pa.array(angle)],
                                                 ["vec_id", "label", "vector", "size", "cluster", "angle"])

        whole = rows.select("vec_id", "label", padded.alias("q"))
        self.members = materialise(whole.filter(F.col("vec_id") % every == 0).mapInArrow(
            members, "vec_id long, label long, vector binary, size double, cluster int, angle double"), "anchors")
        spread = {r["cluster"]: r for r in self.members.groupBy("cluster").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect()}
        self.reach = np.array([spread[c]["angle"] + 1e-6 if c in spread else 0.0 for c in range(len(centres))])
        self.packs = {c: -(-r["n"] // pack_members) for c, r in spread.items()}
        reach = self.reach

        def index(batches):
            for batch in batches:
                q = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(batch.num_rows, width)
                each = bounds(q, centres, reach) if len(q) else np.zeros((0, len(centres)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _flat(q), pa.array(each.tolist(), pa.list_(pa.float64()))], ["vec_id", "label", "vector", "bounds"])

        self.index = materialise(whole.mapInArrow(index, "vec_id long, label long, vector binary, bounds array<double>"), "bounds")
        shares = [1.0]
        while self.count * shares[0] / growth >= first:
            shares.insert(0, shares[0] / growth)
        # The bound at which each segment of each list ends; the last has no end.
        each = self.index.select(F.posexplode("bounds").alias("cluster", "bound")).groupBy("cluster")
        ends = {r["cluster"]: r["ends"] for r in each.agg(F.percentile_approx("bound", [1 - s for s in shares[:-1]] or [0.5], 10_000).alias("ends")).collect()}
        self.segments = [{c: ends[c][i] if i < len(shares) - 1 else -math.inf for c in self.packs} for i in range(len(shares))]

    def segment(self, number: int, limits: dict[int, float]) -> DataFrame:
        """(cluster, vec_id, label, vector, bound) of the rows of one segment whose bound reaches the limit of their cluster."""
        above = self.segments[number - 1] if number else {}
        bound = F.col("at.bound")
        wanted = F.lit(False)
        for c, limit in limits.items():
            held = (F.col("at.cluster") == c) & (bound >= float(max(limit, self.segments[number][c])))
            wanted = wanted | ((held & (bound < float(above[c]))) if number else held)
        at = F.explode(F.transform("bounds", lambda b, i: F.struct(i.alias("cluster"), b.alias("bound")))).alias("at")
        return self.index.select("vec_id", "label", "vector", at).filter(wanted).select("at.cluster", "vec_id", "label", "vector", bound.alias("bound"))

    def best(self, needs: DataFrame, same: bool, most: int) -> DataFrame:
        """(anchor, need, vec_id, score) of the `most` best rows for every need (anchor, need, cap, least): label equal to the anchor's
        or not, score from `least` to `cap`, higher scores first, ties by vec_id.

        One round for each segment. After it, a need is as demanding as the worst of its best rows, and a list is only walked on
        by members whose need its next bound can meet. Rounds follow the logarithm of the number of rows.
        """
        width, small = self.width, self.small
        top = None
        state = needs.withColumn("best", F.col("least"))
        for number in range(len(self.segments)):
            if number:
                reached = top.groupBy("anchor", "need").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).filter(F.col("n") == most)
                state = needs.join(reached, ["anchor", "need"], "left").withColumn("best", F.coalesce("worst", "least"))
            by_anchor = state.groupBy("anchor").agg(F.collect_list(F.struct("need", "cap", "best")).alias("needs"), F.min("best").alias("wanted"))
            size = F.col("size")
            limit = F.when(size > 0, F.col("wanted") / size).when(F.col("wanted") > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
            active = self.members.join(by_anchor, F.col("vec_id") == F.col("anchor")).withColumn("limit", limit)
            active = materialise(active.select("vec_id", "label", "vector", "size", "cluster", F.col("needs.need").alias("need"), F.col("needs.cap").alias("cap"),
                                               F.col("needs.best").alias("best"), "limit"), "walkers")
            limits = {r["cluster"]: r["limit"] for r in active.groupBy("cluster").agg(F.min("limit").alias("limit")).collect()}
            if number:
                limits = {c: x for c, x in limits.items() if self.segments[number - 1][c] > x}
            if not limits:
                break
            rows = self.segment(number, limits)
            blocks = {r["cluster"]: -(-r["n"] // self.block_rows) for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
            if not blocks:
                continue
            of_cluster = lambda values: F.element_at(F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, v)]), F.col("cluster"))
            dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), of_cluster(blocks)).cast("int"))
            dealt = dealt.withColumn("pack", F.explode(F.sequence(F.lit(0), of_cluster(self.packs) - 1)))
            walkers = active.filter(F.col("cluster").isin(list(blocks))).withColumn("pack", F.pmod(F.xxhash64(F.lit(2), "vec_id"), of_cluster(self.packs)).cast("int"))
            walkers = walkers.withColumn("block", F.explode(F.sequence(F.lit(0), of_cluster(blocks) - 1)))

            def compare(held: pa.Table, asking: pa.Table) -> pa.Table:
                out = ([], [], [], [])
                if held.num_rows and asking.num_rows:
                    bound = held["bound"].to_numpy()
                    order = np.argsort(-bound, kind="stable")
                    rows = {"bound": bound[order], "vec_id": held["vec_id"].to_numpy()[order], "label": held["label"].to_numpy()[order], "vector": _matrix(held["vector"].combine_chunks(), width)[order]}
                    members = {"vec_id": asking["vec_id"].to_numpy(), "label": asking["label"].to_numpy(), "size": asking["size"].to_numpy(), "vector": _matrix(asking["vector"].combine_chunks(), width),
                               "need": asking["need"].to_pylist(), "cap": asking["cap"].to_pylist(), "best": asking["best"].to_pylist()}
                    out = walk(rows, members, same, most, small)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                return pa.table([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["anchor", "need", "vec_id", "score"])

            keys = ["cluster", "block", "pack"]
            found = dealt.groupBy(*keys).cogroup(walkers.groupBy(*keys)).applyInArrow(compare, "anchor long, need int, vec_id long, score long")
            found = found if top is None else top.unionByName(found)
            rank = F.row_number().over(Window.partitionBy("anchor", "need").orderBy(F.desc("score"), "vec_id"))
            top = materialise(found.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank"), "walked")
        return top if top is not None else needs.sparkSession.createDataFrame([], "anchor long, need int, vec_id long, score long")


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, first: int = FIRST, growth: int = GROWTH, block_rows: int = BLOCK_ROWS,
         pack_members: int = PACK_MEMBERS, most_clusters: int = MOST_CLUSTERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of every anchor and positive.

    Anchors are the rows whose vec_id is divisible by `every`; a positive is one of the anchor's best `positives` rows of its label;
    its negatives are the best `negatives` rows of other labels that score from half to 95 % of it. The result is exact.

    Rows without id or label, or with a null vector or a component that is null or not finite take no part. A vec_id is one row:
    repeats count once, and of different rows that share an id the one with the smallest label, then components, stands for it.
    Shorter vectors are filled up with zeros. An anchor alone with its label, or whose positives all score below zero, has no
    rows. Scores are kept in 64 bits. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    lists = Lists(materialise(integral(vectors), "integral"), every, first, growth, block_rows, pack_members, most_clusters)
    if not lists.anchors:
        return spark.createDataFrame([], SCHEMA)
    needs = lists.members.select(F.col("vec_id").alias("anchor"), F.lit(0).alias("need"), F.lit(_MOST).alias("cap"), F.lit(_LEAST).alias("least"))
    found = lists.best(needs, True, positives)
    order = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    found = materialise(found.select("anchor", order.alias("need"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    cap, least = F.expr("positive_score div 100 * 95 + positive_score % 100 * 95 div 100"), F.expr("positive_score div 2 + positive_score % 2")
    needs = found.select("anchor", "need", cap.alias("cap"), least.alias("least")).filter((score >= 0) & (F.col("least") <= F.col("cap")))
    hard = lists.best(materialise(needs, "needs"), False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor", "need").orderBy(F.desc("score"), "vec_id"))
    hard = hard.select("anchor", "need", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(found, ["anchor", "need"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same result for vectors of one length that all have ids of their own.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same),
h AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS n
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND p.n <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM h WHERE n <= 3
"""
