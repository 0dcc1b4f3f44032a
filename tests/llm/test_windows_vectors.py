"""Substring dedup, hard negatives and centroid clustering against plain versions, with the odd cases of their docstrings."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from factweave.llm import centroids, hard_negatives, substrings

TEXTS = "doc_id long, text string, part long, rank int, h1 string"
VECTORS = "vec_id long, embedding array<double>, label int, bound double, cluster int, q string"


def plain_repeats(rows):
    """By definition: every window of every row, the earliest start of its words."""
    def place(doc_id, text):
        data = (text or "").encode()
        return (doc_id is not None, doc_id or 0, xxhash.xxh64_intdigest(data))

    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (doc_id, text), w in zip(rows, words, strict=True):
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, ((True, 1 << 63, 0), 0)), (place(doc_id, text), s))
    out = []
    for (doc_id, text), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (place(doc_id, text), s) for p in range(s, s + 20)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def text_rows():
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(n))
    passage, long_word = some(60), "é" * 700
    texts = [some(100), None, "", "  \t\n ", some(30) + "\x0b" + passage + "\xa0" + some(5), passage, passage + " " + some(25), "same " * 90, "same " * 30 + some(20), some(19), some(20)]
    texts += [f"{some(10)} {long_word} {some(30)}", f"{some(3)} {long_word} " + some(2), some(3000)]
    texts += [texts[-1], "x " + texts[-2]]
    rows = list(enumerate(texts, 1))
    rows += [(None, passage), (None, passage), (None, some(4) + " " + passage), (6, some(2) + " " + passage), (6, passage), (-5, some(50)), (1 << 60, passage[:200])]
    rows += [(100 + i, f"{some(8)} {texts[0]} {some(rng.randint(0, 9))}") for i in range(12)]
    rng.shuffle(rows)
    return rows


def test_substrings(spark):
    rows = text_rows()
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], TEXTS).repartition(4)
    got = sorted(map(str, (tuple(r) for r in substrings.remove_repeats(docs).collect())))
    assert got == sorted(map(str, plain_repeats(rows)))


def test_substrings_in_many_parts(monkeypatch):
    """Many parts, shards and buckets; without Spark, whose workers have sizes of their own."""
    for name, value in (("PART_WORDS", 300), ("BLOCK_BYTES", 900), ("CELLS", 1 << 9)):
        monkeypatch.setattr(substrings, name, value)
    rows = text_rows()
    import pyarrow as pa

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 3)

    monkeypatch.setattr(substrings, "TaskContext", Task)
    batches = [pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["doc_id", "text"])]
    blocks = pa.Table.from_batches(list(substrings._packed_blocks(batches)))
    parts = sorted(set(blocks["part"].to_pylist()))
    assert len(parts) > 3
    sketches = pa.Table.from_batches(list(substrings._sketches(3)(blocks.select(["part", "data"]).to_batches())))
    by = lambda t, c, v: t.filter(pa.compute.equal(t[c], v))
    answers = pa.concat_tables([substrings._merged(by(sketches, "shard", s)) for s in set(sketches["shard"].to_pylist())])
    sent = pa.concat_tables([substrings._candidates(3, 5)(by(blocks, "part", p), by(answers, "part", p)) for p in parts])
    removed = pa.concat_tables([substrings._grouped(by(sent, "bucket", b)) for b in set(sent["bucket"].to_pylist())])
    out = pa.concat_tables([substrings._kept(by(blocks, "part", p), by(removed, "part", p)) for p in parts])
    assert sorted(map(str, (tuple(r.values()) for r in out.to_pylist()))) == sorted(map(str, plain_repeats(rows)))


def test_substrings_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], TEXTS)).count() == 0
    assert substrings.remove_repeats(spark.createDataFrame([(1, None, 1, 1, "")], TEXTS)).first()["n_words"] == 0


def test_no_window_is_lost_by_the_sketch():
    """A window that occurs twice has an anchor that is counted twice, whatever stands around it."""
    rng = np.random.default_rng(1)
    pool = [rng.integers(0, 3, n) for n in (1, 2, 7, 25, 40)] + [np.zeros(50, int)]  # copies, and runs that overlap themselves
    words = np.concatenate([np.tile(pool[i], 1 + 20 * (i < 3)) for i in rng.integers(0, len(pool), 150)]).astype(np.uint64)
    anchor, of = substrings.anchors(substrings._mix(words), np.arange(len(words) - 19))
    windows = [words[i : i + 20].tobytes() for i in range(len(words) - 19)]
    _, at, times = np.unique(anchor, return_inverse=True, return_counts=True)
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    assert any(n > 1 for n in seen.values()) and all(times[at[of[i]]] >= seen[w] for i, w in enumerate(windows))


def vectors(spark, data, labels, extra=()):
    rows = [(i, [float(x) for x in v], int(c), 0.0, 1, "clash") for i, (v, c) in enumerate(zip(data, labels, strict=True))]
    return spark.createDataFrame([*rows, *extra], VECTORS)


def odd_rows(width):
    return [(None, [0.5] * width, 1, 0.0, 1, ""), (901, None, 1, 0.0, 1, ""), (902, [0.1, None] + [0.0] * (width - 2), 1, 0.0, 1, ""), (903, [float("nan")] * width, 1, 0.0, 1, ""),
            (904, [float("inf")] * width, 1, 0.0, 1, "")]


def plain_negatives(data, labels):
    q = np.floor(256 * np.array(data, float)).astype(np.int64)
    labels = [(c + 1) % 10 if i % 7 == 0 else c for i, c in enumerate(labels)]
    out = []
    for a in range(0, len(q), 50):
        score = (q @ q[a]).tolist()
        ranked = sorted((i for i in range(len(q)) if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if labels[i] == labels[a]][:5]:
            hard = [i for i in ranked if labels[i] != labels[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["near", "random", "ties", "large"])
def test_hard_negatives(spark, kind):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((700, 6))
    if kind == "near":  # tight groups, which end early
        data = np.repeat(rng.standard_normal((14, 6)), 50, axis=0) + 0.05 * data
    if kind == "ties":  # a third is one vector, some are zero
        data = np.round(data)
        data[::3], data[1::50], data[100] = data[0], 0, 0
    if kind == "large":  # sums beyond 2^53
        data = np.round(data * (1 << 18)) * 2
    labels = rng.integers(0, 4, 700)
    extra = [*odd_rows(6), (905, [0.1] * 6, None, 0.0, 1, ""), (3, [float(x) for x in data[3]], int(labels[3]), 0.0, 1, "clash")]
    got = hard_negatives.mine(vectors(spark, data, labels, extra), first=20, growth=4, block_rows=64, pack_members=3, most_clusters=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(data, labels)


def test_hard_negatives_odd(spark):
    empty = vectors(spark, [], [])
    assert hard_negatives.mine(empty).count() == 0 and hard_negatives.mine(vectors(spark, [[], []], [1, 1])).count() == 0
    assert hard_negatives.mine(vectors(spark, [[1.0]], [1])).count() == 0
    got = hard_negatives.mine(vectors(spark, [[1.0, 0.0], [2.0], [0.6, 9.0], [1.5, 0.0]], [0, 1, 5, 6])).collect()  # 0 becomes 1; a shorter vector
    assert [tuple(r) for r in got] == [(0, 1, 1, 3, 131072, 98304)]


def test_bounds_hold():
    rng = np.random.default_rng(8)
    members, rows = rng.integers(-300, 300, (60, 8)), rng.integers(-300, 300, (500, 8))
    rows[:5] = 0
    centres = hard_negatives.fit_clusters(members.astype(float), 5)
    unit = members / np.linalg.norm(members, axis=1)[:, None]
    cosine = unit @ centres.T
    cluster = cosine.argmax(axis=1)
    reach = np.array([np.arccos(np.clip(cosine[cluster == c, c], -1, 1)).max(initial=0) + 1e-6 for c in range(len(centres))])
    assert (rows @ unit.T <= hard_negatives.bounds(rows, centres, reach)[:, cluster] + 1e-9).all()


def plain_clusters(ids, data):
    q = [[int(np.floor(64 * float(x))) for x in v] for v in data]
    order = sorted(range(len(q)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), q[i]))
    c = [q[i] for i in order[:16]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, k, strict=True)), j) for j, k in enumerate(c))
    for _ in range(3):
        groups = {}
        for v in q:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else k for j, k in enumerate(c)]
    found = [near(v) for v in q]
    inertia = {j: sum(d for d, k in found if k == j) for _, j in found}
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in zip(ids, found, strict=True))


@pytest.mark.parametrize("kind", ["near", "ties", "few", "wide"])
def test_centroids(spark, kind):
    rng = np.random.default_rng(6)
    data = np.repeat(rng.standard_normal((10, 64)), 20, axis=0) + 0.1 * rng.standard_normal((200, 64))
    if kind == "ties":
        data = rng.integers(0, 2, (200, 64)) / 64
        data[::3] = data[0]
    if kind == "few":
        data = data[:5]
    if kind == "wide":
        data[7] *= 1e6
    ids = [*range(len(data) - 2), 0, None]  # an id that repeats, and none
    data[-2] = data[0]
    rows = [(i, [float(x) for x in v], 1, 0.0, 1, "clash") for i, v in zip(ids, data, strict=True)]
    rows += [*odd_rows(64)[1:], (905, [0.5] * 63, 1, 0.0, 1, "")]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_clusters(ids, data)


def test_centroids_empty(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0


def test_sure_vectors_are_not_fetched():
    """The cells settle most vectors of tight groups, and never give another result than measuring all of them."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-60, 60, (16, 64))
    q = np.repeat(middle, 200, axis=0) + rng.integers(-6, 7, (3200, 64))
    cells = centroids.Cells(q[::3], q.min(axis=0), q.max(axis=0))
    held = cells.of(q)
    assert (centroids._one_a_byte(centroids._two_a_byte(held)) == held).all()
    found, fetched = centroids.assign(held, q, middle, cells.tables(middle))
    assert (found == centroids.exact(q, middle).argmin(axis=1)).all() and fetched < len(q) / 2
