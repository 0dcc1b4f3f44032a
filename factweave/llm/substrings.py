"""Exact removal of repeated word windows: merged count-min sketches say which windows may repeat, a second pass groups only those.

Everything between the two reads of the texts is packed: a *part* is a run of documents that one task read (bounded in words), its
sketch is a list of cells for each shard of the sketch, and a shard answers every part with those of its cells that are full. So
neither the sketch nor the windows are ever in one place, and what is shuffled is a few bytes for each window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import materialise

WINDOW = 20
#: Words of an anchor. A window is counted by the smallest of the hashes of its anchors, which two equal windows share.
ANCHOR = 8
#: Rows of the sketch, cells of a shard of one row, and cells for each anchor that is counted.
DEPTH, CELLS, CELLS_PER_ANCHOR = 2, 1 << 20, 4
#: Words after which a task begins a new part, bytes of text in a block, windows (before any filter) of a bucket.
PART_WORDS, BLOCK_BYTES, BUCKET_WINDOWS = 1 << 21, 4 << 20, 1 << 19
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 256

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    return x ^ (x >> np.uint64(32))


class Texts:
    """The words of some texts: `starts` and `ends` in `data`, `edges` (first word of each text, and the end)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2]
        self.data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        space = _SPACE[self.data]
        begins = np.zeros(len(self.data) + 1, bool)
        begins[self.offsets] = True
        before, after = np.ones(len(space), bool), np.ones(len(space), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        self.starts = np.flatnonzero(~space & (before | begins[:-1]))
        self.ends = np.flatnonzero(~space & (after | begins[1:])) + 1
        self.edges = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of every word, eight bytes at a time."""
        size = self.ends - self.starts
        out = _mix(size.astype(np.uint64) * _M1 + np.uint64(seed))
        eight = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(16, np.uint8)]), 0, (1,))
        left, done = np.flatnonzero(size <= LONG_WORD), 0
        while len(left):
            part = eight[self.starts[left] + done] & _MASKS[np.minimum(size[left] - done, 8)]
            out[left] = _mix((out[left] ^ part) * _M1 + np.uint64(seed))
            done += 8
            left = left[size[left] > done]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), seed)
        return out

    def windows(self) -> np.ndarray:
        """First words of all windows that lie in one text."""
        room = np.repeat(self.edges[1:], np.diff(self.edges)) - np.arange(len(self))
        return np.flatnonzero(room >= WINDOW)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, by doubling."""
    level, size, out, done = words, 1, None, 0
    need = max(0, len(words) - k + 1)
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            piece = level[done : done + need]
            out = piece if out is None else _mix(out * _M1 + piece)
            done += size
        level = _mix(level[:-size] * _M1 + level[size:]) if len(level) > size else level[:0]
        size *= 2
    return out


def anchors(words: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every anchor that stands for a window, number of the anchor of each window).

    The leftmost of the smallest hashes of a window stands for it, so equal windows have equal anchors at equal places of theirs,
    and different places in the texts: a window occurs no more often than its anchor.
    """
    value = grams(words, ANCHOR)
    at, size, wide = np.arange(len(value)), 1, WINDOW - ANCHOR + 1
    while size < wide and len(value):
        step = min(size, wide - size)
        later = value[step:] < value[:-step]
        value, at = np.where(later, value[step:], value[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    if not len(windows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = at[windows][1:] != at[windows][:-1]
    return value[windows[new]], np.cumsum(new) - 1


def cells(anchor: np.ndarray, row: int, shards: int) -> np.ndarray:
    """Cell of each anchor in a row of the sketch; a shard is a run of CELLS cells."""
    x = _mix(anchor + np.uint64(0xD1B54A32D192ED03 * (row + 1) & (1 << 64) - 1))
    return ((x >> np.uint64(32)) % np.uint64(shards) * np.uint64(CELLS) + (x & np.uint64(CELLS - 1))).astype(np.int64)


def packed(**columns: np.ndarray) -> bytes:
    batch = pa.record_batch([pa.array(v) for v in columns.values()], names=list(columns))
    return _ipc(batch)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _arrays(rows: list[bytes]) -> dict[str, np.ndarray]:
    table = pa.concat_tables([_opened(r) for r in rows])
    return {name: table[name].to_numpy() for name in table.column_names}


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_BLOCK = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("n_words", pa.int64()), ("data", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
_CELLS = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("cells", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _packed_blocks(batches):
    """Blocks (part, block, n_words, data) of the (doc_id, text) rows of one task."""
    first = TaskContext.get().partitionId() << 24
    part, block, words = 0, 0, 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            held = pa.record_batch([batch.column(0).slice(at, to - at), texts.slice(at, to - at)], names=["doc_id", "text"])
            n = len(Texts(held.column(1)))
            if words and words + n > PART_WORDS:
                part, block, words = part + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((first + part, block, n, _ipc(held)), _BLOCK, strict=True)], schema=_BLOCK)
            block, words, at = block + 1, words + n, to


def _part(blocks: pa.Table):
    """(number of documents before, ids, texts as Arrow, Texts) of each block of a part."""
    before = 0
    order = np.argsort(blocks["block"].to_numpy())
    for data in blocks["data"].take(pa.array(order)).to_pylist():
        held = _opened(data)
        ids, texts = held["doc_id"].combine_chunks(), held["text"].combine_chunks()
        yield before, ids, texts, Texts(texts)
        before += len(ids)


def _places(ids: pa.Array, texts: Texts) -> np.ndarray:
    """(has an id, id, tie) of each document: rows of one id and text are one document, of one id and other texts follow a hash of
    the text, and documents without id come first."""
    out = np.zeros(len(ids), [("known", "?"), ("id", "<i8"), ("tie", "<u8")])
    out["known"] = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    out["id"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    out["tie"] = [xxhash.xxh64_intdigest(texts.data[a:b].tobytes()) for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
    return out


def _sketches(shards: int):
    """Partition sketches: the cells of each part, by shard. The highest bit says that the part alone fills the cell."""

    def rows(part: int, found: list[np.ndarray]) -> pa.RecordBatch:
        out, all_anchors = [], np.concatenate(found)
        for row in range(DEPTH):
            cell, times = np.unique(cells(all_anchors, row, shards), return_counts=True)
            value = (cell % CELLS).astype(np.uint32) | ((times > 1).astype(np.uint32) << np.uint32(31))
            held, at = np.unique(cell // CELLS, return_index=True)
            for shard, a, b in zip(held.tolist(), at.tolist(), [*at[1:].tolist(), len(cell)], strict=True):
                out.append((row * shards + shard, part, value[a:b].tobytes()))
        return _rows(_CELLS, out).combine_chunks().to_batches()

    def run(batches):
        now, found = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and found:
                    yield from rows(now, found)
                    found = []
                now = part
                texts = Texts(_opened(data)["text"].combine_chunks())
                anchor, _ = anchors(texts.hashes(1), texts.windows())
                if len(anchor):
                    found.append(anchor)
        if found:
            yield from rows(now, found)

    return run


def _merged(rows: pa.Table) -> pa.Table:
    """One shard of the merged sketch answers every part: (part, shard, cells of the part that were met twice or more)."""
    full = np.zeros(CELLS, np.uint8)
    low = np.uint32((1 << 31) - 1)
    each = [np.frombuffer(c, np.uint32) for c in rows["cells"].to_pylist()]
    for cell in each:
        full[cell & low] = np.minimum(2, full[cell & low] + 1 + (cell >> np.uint32(31)))
    out = []
    for shard, part, cell in zip(rows["shard"].to_pylist(), rows["part"].to_pylist(), each, strict=True):
        answer = (cell & low)[full[cell & low] > 1]
        if len(answer):
            out.append((shard, part, answer.tobytes()))
    return _rows(_CELLS, out)


def _candidates(shards: int, buckets: int):
    """Windows of a part that the sketch holds for repeated, by bucket of their hash, the first of each in the part. The others of
    the part go into a bucket of the part's own: they are removed whatever other parts hold."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows or not answers.num_rows:
            return _rows(_SENT, [])
        part = blocks["part"][0].as_py()
        full = [[] for _ in range(DEPTH)]
        for shard, cell in zip(answers["shard"].to_pylist(), answers["cells"].to_pylist(), strict=True):
            full[shard // shards].append(shard % shards * CELLS + np.frombuffer(cell, np.uint32).astype(np.int64))
        full = [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in full]
        places, found = [], []
        for before, ids, _, texts in _part(blocks):
            places.append(_places(ids, texts))
            words, start = texts.hashes(1), texts.windows()
            anchor, of = anchors(words, start)
            hot = np.ones(len(anchor), bool)
            for row in range(DEPTH):
                hot &= np.isin(cells(anchor, row, shards), full[row])
            start = start[hot[of]] if len(start) else start
            if len(start):
                doc = np.searchsorted(texts.edges, start, "right") - 1
                found.append((grams(words, WINDOW)[start], grams(texts.hashes(2), WINDOW)[start], before + doc, start - texts.edges[doc]))
        if not found:
            return _rows(_SENT, [])
        h1, h2, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
        place, rank = np.unique(np.concatenate(places), return_inverse=True)
        rank = rank[doc]
        order = np.lexsort((start, rank, h2, h1))
        h1, h2, rank, start = h1[order], h2[order], rank[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (rank != rank[lead]) | (start != start[lead])
        out = [(-1 - part, part, packed(rank=rank[later].astype(np.uint32), start=start[later].astype(np.uint32)))] if later.any() else []
        order = np.flatnonzero(new)
        order = order[np.lexsort((start[order], rank[order], h1[order] % np.uint64(buckets)))]
        h1, h2, rank, start = h1[order], h2[order], rank[order], start[order]
        held, at = np.unique(h1 % np.uint64(buckets), return_index=True)
        for bucket, a, b in zip(held.tolist(), at.tolist(), [*at[1:].tolist(), len(h1)], strict=True):
            p = place[rank[a:b]]
            out.append((bucket, part, packed(h1=h1[a:b], h2=h2[a:b], known=p["known"], id=p["id"], tie=p["tie"], rank=rank[a:b].astype(np.uint32), start=start[a:b].astype(np.uint32))))
        return _rows(_SENT, out)

    return run


def _grouped(rows: pa.Table) -> pa.Table:
    """The exact pass over one bucket: the windows (rank, start) of each part that are not the first of their words."""
    if rows["bucket"][0].as_py() < 0:
        return rows.select(_SENT.names).cast(_SENT)
    held = [_arrays([r]) for r in rows["data"].to_pylist()]
    h1, h2, known, ident, tie, rank, start = (np.concatenate([h[c] for h in held]) for c in ("h1", "h2", "known", "id", "tie", "rank", "start"))
    of = np.repeat(np.arange(len(held)), [len(h["h1"]) for h in held])
    order = np.lexsort((start, tie, ident, known, h2, h1))
    h1, h2, known, ident, tie, rank, start, of = (x[order] for x in (h1, h2, known, ident, tie, rank, start, of))
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    for column in (known, ident, tie, start):
        later |= column != column[lead]
    if not later.any():
        return _rows(_SENT, [])
    order = np.flatnonzero(later)
    order = order[np.argsort(of[order], kind="stable")]
    mine, at = np.unique(of[order], return_index=True)
    bucket, parts = rows["bucket"][0].as_py(), rows["part"].to_pylist()
    out = [(bucket, parts[i], packed(rank=rank[order[a:b]], start=start[order[a:b]])) for i, a, b in zip(mine.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True)]
    return _rows(_SENT, out)


def _kept(blocks: pa.Table, removed: pa.Table) -> pa.Table:
    """The result rows of a part."""
    if not blocks.num_rows:
        return _rows(_RESULT, [])
    gone = _arrays(removed["data"].to_pylist()) if removed.num_rows else {"rank": np.zeros(0, np.uint32), "start": np.zeros(0, np.uint32)}
    held = list(_part(blocks))
    _, rank = np.unique(np.concatenate([_places(ids, texts) for _, ids, _, texts in held]), return_inverse=True)
    order = np.argsort(gone["rank"], kind="stable")
    of, start = gone["rank"][order].astype(np.int64), gone["start"][order].astype(np.int64)
    since, until = np.searchsorted(of, rank, "left").tolist(), np.searchsorted(of, rank, "right").tolist()
    out = []
    for before, ids, _, texts in held:
        for i, doc_id in enumerate(ids.to_pylist()):
            words = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().split()
            a, b = since[before + i], until[before + i]
            n = len(words)
            if b > a:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, start[a:b], 1)
                np.add.at(change, start[a:b] + WINDOW, -1)
                stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                words = [words[j] for j in stay]
            out.append((doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
    return _rows(_RESULT, out)


def _schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of `docs` (doc_id, text; other columns are not read).

    A word goes if a window of WINDOW words covers it that also starts earlier: in a document of smaller doc_id or further up in the
    same one. Rows of one doc_id and text are one document, of which every row keeps the same words. Documents that share an
    id but not the text follow a hash of the text; those without id come before all others, in order of that hash. Null and
    empty texts have no words. Windows are equal if 128 bits of hash are. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialise(rows.mapInArrow(_packed_blocks, _schema(_BLOCK)), "window-blocks")
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    # An anchor stands for a run of windows; about two of each WINDOW - ANCHOR + 2 places are anchors.
    shards = max(1, -(-words * 2 * CELLS_PER_ANCHOR // ((WINDOW - ANCHOR + 2) * CELLS)))
    buckets = max(1, -(-words // BUCKET_WINDOWS))
    sketches = blocks.select("part", "data").mapInArrow(_sketches(shards), _schema(_CELLS))
    answers = sketches.groupBy("shard").applyInArrow(_merged, _schema(_CELLS))
    sent = blocks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_candidates(shards, buckets), _schema(_SENT))
    removed = sent.groupBy("bucket").applyInArrow(_grouped, _schema(_SENT))
    return blocks.groupBy("part").cogroup(removed.groupBy("part")).applyInArrow(_kept, _schema(_RESULT))


#: The same result for documents that all have ids of their own.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20),
wins AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS t FROM starts),
gone AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM wins) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM gone),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
