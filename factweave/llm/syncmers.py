"""Document fingerprints from closed syncmers over words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.session import materialise

K = 4
S = 2
BLOCK_DOCS = 512
_HASH_MASK = (1 << 32) - 1
_START = "\x02"


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S, positions: bool = False) -> DataFrame:
    """`df` with `out`: the hashes of the closed syncmers of column `text`, in order of the text.

    A k-mer of words is chosen if the smallest hash of its inner s-mers is the first or the last one. That depends on the
    k-mer alone, so an edit changes only anchors that overlap it. k-1 start marks stand before the first word, so that every
    text with a word has k-mers. Null and empty texts have no anchors. With `positions` the elements are (position, hash).
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("_words", words)
    padded = F.when(F.size("_words") > 0, F.concat(F.array_repeat(F.lit(_START), k - 1), F.col("_words"))).otherwise(F.col("_words"))
    df = df.withColumn("_h", F.transform(padded, lambda w: F.xxhash64(w))).drop("_words")
    inner = F.transform("_h", lambda h, i: F.xxhash64(h, *[F.get("_h", i + j) for j in range(1, s)]))
    df = df.withColumn("_s", inner)
    span = k - s + 1

    def chosen(i: Column) -> Column:
        edge = F.least(F.get("_s", i), F.get("_s", i + span - 1)) if span > 1 else F.get("_s", i)
        middle = [F.get("_s", i + j) for j in range(1, span - 1)]
        return F.lit(True) if not middle else edge <= (F.least(*middle) if len(middle) > 1 else middle[0])

    starts = F.when(F.size("_h") >= k, F.sequence(F.lit(0), F.size("_h") - k)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_at", F.filter(starts, chosen))

    def anchor(i: Column) -> Column:
        value = F.xxhash64(*[F.get("_h", i + j) for j in range(k)]).bitwiseAND(F.lit(_HASH_MASK))
        return F.struct(i.alias("position"), value.alias("hash")) if positions else value

    return df.withColumn(out, F.transform("_at", anchor)).drop("_h", "_s", "_at")


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """`df` with `out`: the hashes of all anchors of `text`, in order of the text, repeated ones as often as they occur."""
    return with_anchors(df, text, out, k, s)


def fingerprint(sketch: Column) -> Column:
    """The hashes of a sketch as hexadecimal text, 8 digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """`df` with `out`: the share of different anchors that the texts behind two sketches have in common (Dice), counted in full.

    Two texts without anchors are alike (1), one without and one with are not (0).
    """
    common = F.size(F.array_intersect(a, b))
    df = df.withColumn("_total", F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))
    return df.withColumn(out, F.when(F.col("_total") == 0, 1.0).otherwise(2.0 * common / F.col("_total"))).drop("_total")


def with_blocks(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, text, _hash, _tie, _block): blocks of about `block_docs` documents that follow one another by (doc_id, _hash, _tie).

    Spark samples the ranges from the rows, not from the values of the ids: ids may lie any way, be null or repeat. Rows that
    share an id are spread by a hash of the text, rows that share both by their place in the input. Only these keys are sorted by
    range; the first of each range goes to all tasks, and a row finds its block among them by bisection.
    """
    key = F.struct("doc_id", "_hash", "_tie")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    blocks = max(1, -(-docs.count() // block_docs))
    ranged = rows.select("doc_id", "_hash", "_tie").repartitionByRange(blocks, "doc_id", "_hash", "_tie")
    firsts = ranged.groupBy(F.spark_partition_id().alias("_part")).agg(F.min(key).alias("first"))
    bounds = materialise(firsts.agg(F.array_sort(F.collect_list("first")).alias("_bounds")), "bounds")
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(24))])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("_bounds", low + step) <= key, low + step).otherwise(low))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("_block", at.cast("long")).drop("_bounds")


def with_next(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): every document beside the next by doc_id, then a hash of the text; the last
    beside the first.

    Each block is ordered on its own, with a copy of the first document of the block that follows; so the texts move once and no
    task orders all. Null ids come first.
    """
    rows = with_blocks(docs, block_docs)
    # min() of a struct takes a null id as the smallest, as the order below does.
    firsts = rows.groupBy("_block").agg(F.min(F.struct("doc_id", "_hash", "_tie", "text")).alias("first"))
    order = Window.orderBy("_block")
    before = rows.groupBy("_block").agg(F.max("_block").alias("_b")).select(
        "_block", F.lag("_block").over(order).alias("_to"), F.max("_block").over(Window.orderBy(F.lit(0))).alias("_last"))
    donors = firsts.join(before, "_block").select(
        F.coalesce("_to", "_last").alias("_block"), F.col("_to").isNull().alias("_wrap"), F.lit(True).alias("_donor"), "first.doc_id", "first._hash", "first._tie", "first.text")
    own = rows.select("_block", F.lit(False).alias("_wrap"), F.lit(False).alias("_donor"), "doc_id", "_hash", "_tie", "text")
    dealt = with_sketch(own.unionByName(donors).repartition("_block"), "text", "sketch")
    follow = Window.partitionBy("_block").orderBy("_wrap", "_donor", "doc_id", "_hash", "_tie")
    paired = dealt.withColumn("next_text", F.lead("text").over(follow)).withColumn("next_sketch", F.lead("sketch").over(follow))
    return paired.filter("not _donor").drop("_block", "_wrap", "_donor", "_hash", "_tie")


def compare_edits(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per document of `docs` (doc_id, text, ...): its fingerprint, that of its edited text, and how alike they are.

    The edited text ends in as many code points of the next document as a quarter of its own (or all that one has). Null
    texts are empty. Repeated ids are ordered by a hash of the text. Other columns are ignored.
    """
    rows = with_next(docs, block_docs).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    rows = with_likeness(with_likeness(rows, "sketch", "edited_sketch", "near_edited"), "sketch", "next_sketch", "near_next")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"),
                       fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
