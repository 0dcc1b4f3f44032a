"""Best-fit packing of tokenised documents into sequences of fixed length (linear grouping scheme)."""

from __future__ import annotations

import array
import base64
import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.llm.common import BLOCK_ROWS
from factweave.session import materialise

CAPACITY = 1024
END_ID = 2
#: Lengths up to one of these shares of a sequence are small: they fill what the configurations leave. The plan is made for
#: each share from the counts alone, and the one with the fewest sequences is carried out.
SMALL_SHARES = (16, 8, 4, 3, 2)
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 64
BUCKETS = 256

#: Characters tokenised at a time.
CHUNK_CHARS = 2_000_000

# --- Fixed values: how the byte-level tokenizer cuts a text before it merges ---
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same cuts for a text in which no two white-space characters meet; it needs no look-ahead, so it is faster.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

_SPACE_RUN = re.compile(r"\s\s")
_loaded: dict[str, "_Encoder"] = {}


def _added_tokens(ranks_file: str) -> dict[str, int]:
    """Tokens that the tokenizer file beside the ranks takes out of a text before it is cut into words."""
    try:
        with open(ranks_file.rpartition(".")[0] + ".json", encoding="utf-8") as described:
            added = json.load(described).get("added_tokens", [])
    except FileNotFoundError:
        return {}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take spaces or whole words are not supported")
    return {t["content"]: t["id"] for t in added}


class _Encoder:
    """Ids of whole texts, as unsigned 32-bit numbers in little-endian bytes. A text is cut at added tokens, and its parts are encoded alone."""

    def __init__(self, ranks_file: str):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.runs, self.plain = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for name, pattern in (("runs", PATTERN), ("plain", PLAIN_PATTERN)))
        self.added = _added_tokens(ranks_file)
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def encode(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._part(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._part(p) for p in self.cut.split(text) if p)

    def _part(self, text: str) -> bytes:
        ids = array.array("I", (self.runs if _SPACE_RUN.search(text) else self.plain).encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def _encoder(ranks_file: str) -> _Encoder:
    if ranks_file not in _loaded:
        _loaded[ranks_file] = _Encoder(ranks_file)
    return _loaded[ranks_file]


def tokenise(docs: DataFrame, ranks_file: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document of `docs` (doc_id, text).

    A document is its ids and then `end_id`; a null or empty text is that one id. Only a document of more than `capacity` ids
    is cut: all its pieces but the first are full. Repeated rows give repeated pieces; other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_file)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars < CHUNK_CHARS):
                    chars += len(texts[upto] or "")
                    upto += 1
                out: list[list] = [[] for _ in range(6)]
                for key, text in zip(keys[at:upto], texts[at:upto], strict=True):
                    ids = encoder.encode(text or "") + end
                    n = len(ids) // 4
                    count = -(-n // capacity)
                    start, size = 0, n - capacity * (count - 1)
                    for piece in range(count):
                        raw = ids[4 * start : 4 * (start + size)]
                        for column, value in zip(out, (key, piece, start, size, zlib.crc32(raw), raw), strict=True):
                            column.append(value)
                        start, size = start + size, capacity
                at = upto
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(raw, "<u4").astype("int32") for raw in out[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(pieces, PIECE + (", ids array<int>" if keep_ids else ""))


class Plan:
    """Where the r-th item of each length goes, found from the number of items of each length alone.

    A run says: items first..first+count-1 of `length` go to sequences base, base+1, ..., `per` to each, from `offset` on.
    The number of runs depends on the capacity, not on the number of items.
    """

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARES[0]):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.slack: dict[int, list[tuple[int, int]]] = {}
        small = capacity // small_share
        left = self._configurations(counts, small, groups)
        left += [(length, 0, int(counts[length])) for length in range(small, 0, -1) if counts[length]]
        for length, first, count in left:
            self._best_fit(length, first, count)
        self.runs.sort()

    def _configurations(self, counts: np.ndarray, small: int, groups: int) -> list[tuple[int, int, int]]:
        """Pack the large lengths by rounded configurations; what is left over comes back as (length, first, count)."""
        spans = []  # (length, first rank among all large items, count), longest first
        total = 0
        for length in range(self.capacity, small, -1):
            if counts[length]:
                spans.append((length, total, int(counts[length])))
                total += int(counts[length])
        if not total:
            return []
        starts = np.array([s[1] for s in spans])
        lengths = [s[0] for s in spans]

        def length_at(rank: int) -> int:
            return int(np.searchsorted(starts, rank, "right")) - 1

        bounds = sorted({total * g // min(groups, total) for g in range(min(groups, total) + 1)})
        sizes: list[int] = []
        pools: list[list[int]] = []  # the ranks of a group: next and end
        for low, high in zip(bounds, bounds[1:], strict=False):
            size = lengths[length_at(low)]
            if sizes and sizes[-1] == size:
                pools[-1][1] = high
            else:
                sizes.append(size)
                pools.append([low, high])
        demand = np.array([high - low for low, high in pools], float)
        for pattern, times in _few_sizes(np.array(sizes), demand, self.capacity):
            base, members = self.sequences, []
            for group, copies in pattern:
                for _ in range(copies):
                    take = min(times, pools[group][1] - pools[group][0])
                    if take:
                        members.append((pools[group][0], take))
                        pools[group][0] += take
            used = max((take for _, take in members), default=0)
            self.sequences += used
            edges = {0, used}
            for first, take in members:
                edges.add(take)
                at = length_at(first) + 1
                while at < len(spans) and spans[at][1] < first + take:
                    edges.add(spans[at][1] - first)
                    at += 1
            cuts = sorted(edges)
            for low, high in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for first, take in members:
                    if low < take:
                        span = spans[length_at(first + low)]
                        self.runs.append((span[0], first + low - span[1], high - low, base + low, 1, offset))
                        offset += span[0]
                self.slack.setdefault(self.capacity - offset, []).append((base + low, high - low))
        rest = []
        for low, high in pools:
            while low < high:
                length, first, count = spans[length_at(low)]
                upto = min(high, first + count)
                rest.append((length, low - first, upto - low))
                low = upto
        return sorted(rest, reverse=True)

    def _best_fit(self, length: int, first: int, count: int) -> None:
        """Put equal items where the least room is left that takes them, else into new sequences."""
        while count:
            room = min((s for s, segments in self.slack.items() if s >= length and segments), default=None)
            if room is None:
                room, per = self.capacity, self.capacity // length
                base, bins = self.sequences, -(-count // per)
                self.sequences += bins
            else:
                base, bins = self.slack[room].pop()
                per = room // length
            full = min(bins, count // per)
            offset = self.capacity - room
            if full:
                self.runs.append((length, first, full * per, base, per, offset))
                self.slack.setdefault(room - per * length, []).append((base, full))
                first, count, base, bins = first + full * per, count - full * per, base + full, bins - full
            if bins and count:
                self.runs.append((length, first, count, base, count, offset))
                self.slack.setdefault(room - count * length, []).append((base, 1))
                first, count, base, bins = first + count, 0, base + 1, bins - 1
            if bins:
                self.slack.setdefault(room, []).append((base, bins))

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(self.runs, np.int64).reshape(-1, 6)
        return tuple(runs.T)


def best_plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, shares: tuple[int, ...] = SMALL_SHARES) -> Plan:
    """The plan with the fewest sequences over the given shares."""
    return min((Plan(counts, capacity, groups, share) for share in shares), key=lambda plan: plan.sequences)


def _few_sizes(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[list[tuple[int, int]], int]]:
    """Configurations of few sizes and how often to use each: the linear programme by column generation, rounded down."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    use = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        pattern, value = _best_pattern(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, pattern)
        ratio = np.full(n, np.inf)
        np.divide(use, direction, out=ratio, where=direction > 1e-9)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        use = np.maximum(use - ratio[leave] * direction, 0)
        use[leave] = ratio[leave]
        basis[:, leave] = pattern
    found = []
    for column in np.argsort(-use):
        times = int(use[column] + 1e-6)
        if times:
            found.append(([(int(g), int(basis[g, column])) for g in np.flatnonzero(basis[:, column] > 0.5)], times))
    return found


def _best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes within the capacity that is worth most."""
    worth = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    ascending, value = sizes[order], price[order]
    fits = np.searchsorted(ascending, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        worth[room] = worth[room - 1]
        k = fits[room]
        if k:
            gains = worth[room - ascending[:k]] + value[:k]
            best = int(gains.argmax())
            if gains[best] > worth[room] + 1e-12:
                worth[room], took[room] = gains[best], best
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[order[took[room]]] += 1
            room -= int(ascending[took[room]])
    return pattern, float(worth[capacity])


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, shares: tuple[int, ...] = SMALL_SHARES,
         rows_per_bucket: int = BLOCK_ROWS) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with `sequence_id` and a gapless `offset` in it.

    The number of pieces of each length (at most `capacity` rows) is all the driver sees. The plan made from it places the
    r-th piece of a length; that rank is a running count over hashed buckets, so no length meets in one task. Pieces must
    have 1 to `capacity` ids; equal rows are separate pieces. An empty table gives an empty table.
    """
    pieces = materialise(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    length_of, first_of, _, base_of, per_of, offset_of = best_plan(counts, capacity, groups, shares).arrays()
    buckets = max(BUCKETS, int(counts.sum()) // rows_per_bucket + 1)
    placed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by_bucket = placed.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select("_bucket", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Written, so that the two sides of the cogroup share no columns: `count()` would take them from one of them.
    before = materialise(before, "ranks")
    wide = 1 << 48
    keys = length_of * wide + first_of

    def place(rows: pa.Table, ranks: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = rows["length"].to_numpy()
        start = np.zeros(capacity + 1, np.int64)
        start[ranks["length"].to_numpy()] = ranks["before"].to_numpy()
        position = np.arange(len(length))
        rank = position - np.searchsorted(length, length, "left") + start[length]
        run = np.searchsorted(keys, length * wide + rank, "right") - 1
        inside = rank - first_of[run]
        rows = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        rows = rows.append_column("sequence_id", pa.array(base_of[run] + inside // per_of[run], pa.int64()))
        return rows.append_column("offset", pa.array(offset_of[run] + inside % per_of[run] * length, pa.int64()))

    return placed.groupBy("_bucket").cogroup(before.groupBy("_bucket")).applyInArrow(place, PIECE + ", sequence_id long, offset long")
