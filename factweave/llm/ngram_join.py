"""Near-duplicate documents by n-gram Jaccard similarity: a MinHash LSH forest and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import components, row_key
from factweave.session import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 8
TARGET_RECALL = 0.998
#: Texts of a candidate group that one task compares at a time.
BLOCK_TEXTS = 512
SALTS = 16
SEED = 29

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COLUMNS = 8192


def needed_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """How far matched prefixes are shortened: the deepest level at which a pair of just this similarity meets in some tree often enough."""
    for level in range(depth, 1, -1):
        if 1 - (1 - similarity**level) ** trees >= target:
            return level
    return 1


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def shingles(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Different hashes of runs of `width` words, ascending; a shorter text is one run, a text without words has none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for j in range(width):
        out = (out + hashes[j : j + len(out)]) * _ODD
    return np.unique(_mixed(out))


def _multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factor, shift = rng.integers(0, 1 << 63, size=(2, count), dtype=np.uint64)
    return (factor << np.uint64(1)) | np.uint64(1), shift


def signature(items: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Smallest 32-bit value of each hash function over the items."""
    best = np.full(len(factor), np.uint64((1 << 32) - 1))
    for at in range(0, len(items), 1024):
        part = items[None, at : at + 1024] * factor[:, None] + shift[:, None]
        np.minimum(best, (part >> np.uint64(32)).min(axis=1), out=best)
    return best.astype(np.uint32)


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(doc_id, r1, r2, k1, k2, sig): the key of the row, a 128-bit key of the word sequence and the labels of all trees. The last
    two are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        factor, shift = _multipliers(trees * depth, seed)
        for batch in batches:
            keys: list = []
            labels: list = []
            for text in batch.column(1):
                hashes = word_hashes(text.as_py())
                if not len(hashes):
                    keys.append((None, None))
                    labels.append(None)
                    continue
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist())
                labels.append(signature(shingles(hashes, width), factor, shift).astype(">u4").tobytes())
            k1, k2 = zip(*keys, strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(labels, pa.binary())],
                                             ["doc_id", "r1", "r2", "k1", "k2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *row_key())
    return rows.mapInArrow(sign, "doc_id long, r1 long, r2 long, k1 long, k2 long, sig binary")


def forest_links(texts: DataFrame, level: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(a, b) of texts (id, sig) that follow one another below a common node of `level` values in some tree.

    Each tree is the sorted list of its labels: two neighbours share their longest prefix, and all texts below a node stand
    together, so neighbours connect them. All trees are sorted by range over all tasks; a node of any size may span tasks,
    and only the first and last label of each task come to the driver.
    """
    rows = texts.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    width = 4 * depth
    rows = rows.select(F.col("tree").cast("int"), F.substring(F.col("sig"), F.col("tree") * width + 1, F.lit(width)).alias("label"), "id")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")

    def common(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
        same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
        return np.logical_and.accumulate(same, axis=1).sum(axis=1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "edge", "tree", "label", "a", "b"]

        def out(edge: int, tree: list, label: list, a: list, b: list) -> pa.RecordBatch:
            part = TaskContext.get().partitionId()
            return pa.RecordBatch.from_arrays([pa.array([part] * len(a), pa.int32()), pa.array([edge] * len(a), pa.int32()), pa.array(tree, pa.int32()),
                                               pa.array(label, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            raw = batch.column(1).to_pylist()
            label = np.frombuffer(b"".join(raw), ">u4").reshape(-1, depth)
            if last is None:
                yield out(0, [int(tree[0])], [raw[0]], [int(ids[0])], [int(ids[0])])
            else:
                tree, ids = np.concatenate([[last[0]], tree]), np.concatenate([[last[2]], ids])
                label = np.concatenate([np.frombuffer(last[1], ">u4").reshape(1, depth), label])
            at = np.flatnonzero(common(tree, label) >= level)
            if len(at):
                yield out(1, [None] * len(at), [None] * len(at), ids[at].tolist(), ids[at + 1].tolist())
            last = (int(tree[-1]), raw[-1], int(ids[-1]))
        if last is not None:
            yield out(2, [last[0]], [last[1]], [last[2]], [last[2]])

    found = materialise(rows.mapInArrow(walk, "part int, edge int, tree int, label binary, a long, b long"), "forest")
    ends = found.filter("edge != 1").orderBy("part", "edge").collect()
    across = []
    for left, right in zip(ends[1::2], ends[2::2], strict=False):
        if left["tree"] == right["tree"] and left["label"][: 4 * level] == right["label"][: 4 * level]:
            across.append((left["a"], right["a"]))
    links = found.filter("edge = 1").select("a", "b")
    return links.unionByName(texts.sparkSession.createDataFrame(across, "a long, b long")) if across else links


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, over columns of shared items at a time."""
    here, there = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(here, there)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return total

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(shared, flat)
        column[column == len(shared)] = 0
        hit = shared[column] == flat
        order = np.argsort(column[hit], kind="stable")
        return row[hit][order], column[hit][order]

    (row_l, col_l), (row_r, col_r) = cells(left, here), cells(right, there)
    for start in range(0, len(shared), _COLUMNS):
        a, b = np.zeros((len(left), _COLUMNS), np.float32), np.zeros((len(right), _COLUMNS), np.float32)
        for grid, row, col in ((a, row_l, col_l), (b, row_r, col_r)):
            low, high = np.searchsorted(col, [start, start + _COLUMNS])
            grid[row[low:high], col[low:high] - start] = 1
        total += a @ b.T
    return total


def _compared(ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, similarity: float) -> pd.DataFrame:
    """Links of each text within one block, or between two, and the smallest text it is connected to here."""
    low = block == block.min()
    left = np.flatnonzero(low)
    right = left if low.all() else np.flatnonzero(~low)
    inter = _counts([sets[i] for i in left], [sets[i] for i in right])
    size = np.array([len(s) for s in sets], np.float64)
    near = inter * (1 + similarity) >= similarity * (size[left][:, None] + size[right][None, :]) - 1e-6
    if right is left:
        np.fill_diagonal(near, False)
    links = np.zeros(len(ids), np.int64)
    links[left] = near.sum(axis=1)
    if right is not left:
        links[right] = near.sum(axis=0)
    root = ids.copy()
    rows, cols = np.nonzero(near)
    rows, cols = left[rows], right[cols]
    while len(rows):
        low_root = np.minimum(root[rows], root[cols])
        if (low_root == root[rows]).all() and (low_root == root[cols]).all():
            break
        np.minimum.at(root, rows, low_root)
        np.minimum.at(root, cols, low_root)
    return pd.DataFrame({"id": ids, "links": links, "root": root})


def verify(candidates: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(id, links, root): exact links of `candidates` (node, r1, r2, root of a candidate group) with `texts` (r1, r2, text).

    A group of up to `block_texts` texts is compared in one task. A larger one is dealt into hashed blocks, and each pair of
    blocks is a task of its own that returns counts and one connection per text, never pairs.
    """
    sizes = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block_texts).cast("int")
    members = candidates.join(sizes, "root").withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    # Always the same join, whatever the size: the candidates grow with the input.
    with_text = texts.join(members.hint("merge"), ["r1", "r2"]).select(F.col("node").alias("id"), "text", "root", "_block", "_blocks")
    dealt = with_text.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("id", "text", "_block", "root", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(word_hashes(t), width) for t in group["text"]]
        return _compared(group["id"].to_numpy(np.int64), sets, group["_block"].to_numpy(), similarity)

    return dealt.groupBy("root", "_i", "_j").applyInPandas(compare, "id long, links long, root long")


def grouped(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, trees: int = TREES, depth: int = DEPTH,
            target: float = TARGET_RECALL, block_texts: int = BLOCK_TEXTS, seed: int = SEED) -> DataFrame:
    """`near_duplicates` with the key of the row (r1, r2) and `stays`: whether the row stands for its class.

    The row with the smallest doc_id, then row key, stands for its class, one without id only if all are; rows that repeat it do too.
    """
    signed = materialise(signatures(docs, width, trees, depth, seed), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    texts = signed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct(first.alias("row"), "sig")).alias("first"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(texts.select("k1", "k2", "copies", F.col("first.row").alias("first"), F.col("first.sig").alias("sig"), F.monotonically_increasing_id().alias("id")), "texts")
    level = needed_depth(similarity, trees, depth, target)
    groups = components(forest_links(texts, level, trees, depth))
    candidates = groups.join(texts.select(F.col("id").alias("node"), "first.r1", "first.r2"), "node")
    # Rows that repeat both id and text are one text.
    row_texts = docs.select(*row_key(), F.col("text").cast("string").alias("text")).dropDuplicates(["r1", "r2"])
    checked = materialise(verify(candidates, row_texts, similarity, width, block_texts), "verified")
    roots = components(checked.filter("root != id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("id").agg(F.sum("links").alias("links")).filter("links > 0")
    known = texts.drop("sig").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "k1", "k2", "first", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    # Only texts that are linked or repeated need looking up; every key is dealt over SALTS tasks.
    known = known.filter("links > 0 or copies > 1")
    known = known.join(known.groupBy("root").agg(F.min("first").alias("keep")), "root").drop("root", "first")
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = signed.drop("sig").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    stays = F.col("keep").isNull() | ((F.col("keep.r1") == F.col("r1")) & (F.col("keep.r2") == F.col("r2")))
    return rows.join(known, ["k1", "k2", "_salt"], "left").select(
        "doc_id", F.coalesce("keep.doc_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "r1", "r2", stays.alias("stays"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS, trees: int = TREES, depth: int = DEPTH,
                    target: float = TARGET_RECALL, block_texts: int = BLOCK_TEXTS, seed: int = SEED) -> DataFrame:
    """(doc_id, class_id, links, copies) for every row of `docs` (doc_id, text, ...).

    Documents are compared as sets of runs of `width` words (lower case, letters and digits); `class_id` is the smallest
    doc_id that links of at least `similarity` lead to (null if none of them has an id), `links` the number of other different
    texts linked, `copies` the number of rows with the same words. Equal texts are one text before anything is compared. A
    text without words is alone. Rows without id, or of different texts that share one, are compared like all others.
    """
    return grouped(docs, similarity, width, trees, depth, target, block_texts, seed).drop("r1", "r2", "stays")
