"""Language ID: likelihoods of the text fused with declared language, address suffix and host, all weighed by what they say elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import free_name
from factweave.session import materialise

#: A language is modelled if it is declared for this many training texts, or in a small table for this share of them.
MIN_TEXTS = 5
MIN_SHARE = 0.001
BUCKETS = 1 << 15
#: A long text counts as so many trigrams, because its trigrams are not independent.
MOST_TRIGRAMS = 200
ACCEPT = 0.5
#: Rows that a prior of the next higher level (global, domain) counts as.
HOST_WEIGHT = 20.0
SMOOTHING = 1.0
SALTS = 16
NONE = "und"

_JOIN_BYTES = 1 << 22


def _trigrams(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15)).astype(np.int64)


def train(texts: DataFrame, min_share: float = MIN_SHARE, min_texts: int = MIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probability of each trigram bucket in each, from all `texts` (text, declared) by the declared language.

    Tasks count their own texts; counts are summed by language and bucket. The models grow with the number of declared
    languages, not with the texts. A last column, for no language, gives every bucket the same.
    """
    shares = texts.filter("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    total = shares.agg(F.sum("n")).first()[0] or 0
    languages = sorted(r["declared"] for r in shares.filter(F.col("n") >= min(min_texts, min_share * total)).collect())
    place = {language: i for i, language in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        waiting: dict[str, list[bytes]] = {}

        def add(language: str) -> None:
            raw = waiting.pop(language)
            if language not in counts:
                counts[language] = np.zeros(BUCKETS, np.int64)
            counts[language] += np.bincount(_trigrams(b" ".join(raw)), minlength=BUCKETS)

        for batch in batches:
            size: dict[str, int] = {}
            for text, language in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text and language in place:
                    raw = text.lower().encode()
                    waiting.setdefault(language, []).append(raw)
                    size[language] = size.get(language, 0) + len(raw)
                    if size[language] >= _JOIN_BYTES:
                        add(language)
                        size[language] = 0
            for language in list(waiting):
                add(language)
        for language, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["language", "bucket", "n"])

    counted = texts.select(F.col("text").cast("string"), F.col("declared").cast("string")).mapInArrow(count, "language string, bucket int, n long")
    table = np.full((BUCKETS, len(languages) + 1), 0.5)
    for row in counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[row["bucket"], place[row["language"]]] += row["n"]
    table[:, -1] = 1.0
    return [*languages, NONE], np.log(table / table.sum(axis=0)).astype(np.float32)


def likelihoods(rows: DataFrame, logs: np.ndarray, most: int = MOST_TRIGRAMS) -> DataFrame:
    """`rows` (text last) without text, with `ll`: the log likelihood of the whole text in each language, tempered to `most` trigrams."""
    keys = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", ll array<double>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, logs.shape[1]))
            for i, text in enumerate(batch.column(len(keys))):
                value = text.as_py()
                found = _trigrams(value.lower().encode()) if value else ()
                if len(found):
                    sums = np.zeros(logs.shape[1])
                    for at in range(0, len(found), 1 << 16):
                        sums += logs[found[at : at + (1 << 16)]].sum(axis=0)
                    out[i] = sums * min(1.0, most / len(found))
            flat = pa.array(out.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * logs.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], [*keys, "ll"])

    return rows.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(score, schema)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once for a row however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _softmax(scores: Column) -> Column:
    def scaled(parts: Column) -> Column:
        return _let(_total(parts), lambda total: F.transform(parts, lambda x: x / total))

    def parts_of(s: Column) -> Column:
        return _let(F.array_max(s), lambda top: _let(F.transform(s, lambda x: F.exp(x - top)), scaled))

    return _let(scores, parts_of)


def _summed(parts: DataFrame, *names: str) -> DataFrame:
    """(names..., s): the sums of `parts` (names..., at, s) by names, as an array over the languages."""
    sums = parts.groupBy(*names, "at").agg(F.sum("s").alias("s"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "s")))
    return sums.groupBy(*names).agg(F.transform(in_order, lambda x: x["s"]).alias("s"))


def identify(rows: DataFrame, languages: list[str], logs: np.ndarray, accept: float = ACCEPT, host_weight: float = HOST_WEIGHT,
             smoothing: float = SMOOTHING) -> DataFrame:
    """`rows` (..., declared, suffix, host, domain, text) without text, with `language`, `posterior`, `accepted`.

    What the text alone says is summed by declared language, by suffix, by host and by domain. From these sums come the
    chances of a declaration and of a suffix given the language, and a prior of each host that leans on the prior of its domain,
    which leans on that of all rows. Their product with the likelihood of the text is the posterior. Evidence that is null is
    left out. Sums are rows of (evidence, language) and everything after them works on arrays, so the plan is the same for any
    number of languages. A text without three bytes has language null and is not accepted, nor is one for which no language is likelier
    than none, or whose posterior is below `accept`. Ties go to the language first in order of code points.
    """
    n = len(languages)
    evidence = ["declared", "suffix", "host", "domain"]
    keys = [c for c in rows.columns if c not in ("text", *evidence)]
    ordered = rows.select(*keys, *[F.col(c).cast("string").alias(c) for c in evidence], "text")
    scored = materialise(likelihoods(ordered, logs), "likelihoods")
    marked = scored.withColumns({c: F.coalesce(c, F.lit("\x00")) for c in evidence})
    soft = marked.filter("ll[0] != 0").select(*evidence, F.posexplode(_softmax(F.col("ll"))).alias("at", "s"))
    # Rows with the same evidence are one row for each language from here on, however many they are.
    combined = materialise(soft.groupBy(*evidence, "at").agg(F.sum("s").alias("s")), "evidence")
    totals = {r["at"]: r["s"] for r in combined.groupBy("at").agg(F.sum("s").alias("s")).collect()}
    every = [float(totals.get(i) or 0.0) for i in range(n)]
    whole = sum(every)
    flat = F.lit([(e + smoothing) / (whole + smoothing * n) for e in every])
    weights = F.lit([e + smoothing * n for e in every])

    def given(name: str) -> DataFrame:
        """log P(value | language) by value."""
        sums = _summed(combined.filter(F.col(name) != "\x00"), name)
        return sums.select(name, F.zip_with("s", weights, lambda s, w: F.log((s + smoothing) / w)).alias(f"log_{name}"))

    def prior(parent: Column) -> Column:
        return _let(_total(F.col("s")), lambda total: F.zip_with("s", parent, lambda s, p: (s + host_weight * p) / (total + host_weight)))

    domains = _summed(combined.filter("domain != '\\0'"), "domain").select("domain", prior(flat).alias("prior_domain"))
    hosts = _summed(combined.filter("host != '\\0'"), "host", "domain").join(domains, "domain", "left")
    hosts = hosts.select("host", "domain", prior(F.coalesce("prior_domain", flat)).alias("prior_host"))
    looked = marked.select(*evidence).distinct().join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")
    looked = looked.join(hosts, ["host", "domain"], "left").join(domains, "domain", "left")
    neutral = F.array_repeat(F.lit(0.0), n)
    declared = F.zip_with(F.coalesce("log_declared", neutral), F.coalesce("log_suffix", neutral), lambda a, b: a + b)
    said = F.zip_with(declared, F.coalesce("prior_host", "prior_domain", flat), lambda a, p: a + F.log(p))
    looked = materialise(looked.select(*evidence, said.alias("said")), "said")
    salted = looked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = marked.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    fused = dealt.join(salted, [*evidence, "_salt"], "left").withColumn("p", _softmax(F.zip_with("ll", "said", lambda a, b: a + b)))
    fused = fused.withColumn("posterior", F.array_max("p"))
    best = F.element_at(F.lit(languages), F.array_position("p", F.col("posterior")).cast("int"))
    fused = fused.withColumn("language", F.when((F.get("ll", F.lit(0)) != 0) & (best != NONE), best))
    return fused.select(*keys, "language", F.when(F.get("ll", F.lit(0)) != 0, F.col("posterior")).otherwise(0.0).alias("posterior"),
                        (F.col("language").isNotNull() & (F.col("posterior") >= accept)).alias("accepted"))


def document_rows(docs: DataFrame, *keys: Column) -> DataFrame:
    """Evidence of `docs` (text, lang, source): the language column is the declaration, the source is the host."""
    none = F.lit(None).cast("string")
    return docs.select(*keys, F.col("lang").cast("string").alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain"),
                       F.col("text").cast("string").alias("text"))


def page_rows(pages: DataFrame, *keys: Column) -> DataFrame:
    """Evidence of `pages` (url, html): the lang attribute of the html element, the last label of the host, host and domain."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")

    def known(value: Column) -> Column:
        return F.when(value != "", value)

    return pages.select(*keys, known(declared).alias("declared"), known(F.element_at(labels, -1)).alias("suffix"), known(host).alias("host"), known(domain).alias("domain"), text.alias("text"))


def row_keys(docs: DataFrame) -> list[Column]:
    """A 128-bit key (_k1, _k2) of what a decision about a document rests on, so equal rows share it and others do not."""
    parts = [F.col(c).cast("string") for c in ("doc_id", "text", "lang", "source")]
    flagged = [x for p in parts for x in (p.isNull(), p)]
    return [F.xxhash64(F.lit(1), *flagged).alias("_k1"), F.xxhash64(F.lit(2), *flagged).alias("_k2")]


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, ...) whose language is accepted, unchanged. Texts train the models by `lang`.

    Rows that declare a language too rare for a model stay as well: nothing can be said against it.
    """
    rows = document_rows(docs, *row_keys(docs))
    languages, logs = train(rows.select("text", "declared"))
    rows = rows.withColumn("_modelled", F.col("declared").isNull() | F.col("declared").isin(languages))
    rejected = identify(rows, languages, logs).filter("_modelled and not accepted").select("_k1", "_k2").distinct()
    row = free_name(docs, "_row")
    keyed = docs.select("*", F.struct(*row_keys(docs)).alias(row))
    gone = rejected.select(F.struct("_k1", "_k2").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)
