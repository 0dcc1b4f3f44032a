"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.llm.common import running
from factweave.llm.common import free_name
from factweave.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all sizes, as a fraction
MAX_EPOCHS = 2
SEED = 17
#: Blocks that the documents of a source and size class are drawn in.
BLOCKS = 64


def words(text: Column) -> Column:
    """Number of runs of characters other than space, tab, newline, vertical tab, form feed and return; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of their code points, null last, get the weights in turn. The level of the water is where targets of
    `weight * level`, clamped at `epochs` times the size, add up to the share of all sizes. In order of size by weight the
    clamped sources come first, so running totals tell which they are; excess that they leave goes to the rest by weight.
    If even all clamped sources hold less than the share, every source is clamped.
    """
    ranked = running(sources, [F.col("source").isNull(), F.col("source")], {}).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")).drop("_rank")
    filled = running(ranked, [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")],
                     {"size_before": F.col("source_size"), "weight_before": F.col("weight")})
    filled = materialise(filled.drop("_rank"), "filled")
    top, bottom = share
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = int(total["size"] or 0), int(total["weight"] or 0)
    exact = "decimal(38,0)"
    room = F.lit(top * size).cast(exact) - bottom * epochs * F.col("size_before")
    over = bottom * epochs * F.col("source_size") * (F.lit(weight).cast(exact) - F.col("weight_before")) < F.col("weight") * room
    filled = filled.withColumn("clamped", over | (F.col("source_size") == 0))
    held = filled.filter("clamped").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, shared = top * size - bottom * epochs * int(held["size"] or 0), weight - int(held["weight"] or 0)
    target = F.when(F.col("clamped"), (epochs * F.col("source_size")).cast("double"))
    if shared:
        target = target.otherwise(F.col("weight").cast("double") * float(left) / float(bottom * shared))
    return filled.select("source", "source_size", target.alias("target"))


def _drawn(entries: DataFrame) -> DataFrame:
    """The blocks of each source that get one repetition more, so that the words taken follow the fraction all along.

    A source has at most 64 size classes of `BLOCKS` blocks. They are walked from large to small documents; a block is taken
    when that brings the words taken nearest to the fraction of those seen, so what is missing at the end is less than one
    block of the smallest documents.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("size_class")).alias("large"), "block", F.col("size").cast("double").alias("size"))))
    start = F.struct(F.lit(0.0).alias("taken"), F.lit(0.0).alias("seen"), F.array().cast("array<struct<large:int,block:int>>").alias("blocks"))

    def step(state: Column, entry: Column) -> Column:
        seen = state["seen"] + entry["size"]
        take = (entry["size"] > 0) & (state["taken"] + entry["size"] / 2 <= F.col("fraction") * seen)
        return F.struct((state["taken"] + F.when(take, entry["size"]).otherwise(0.0)).alias("taken"), seen.alias("seen"),
                        F.when(take, F.concat(state["blocks"], F.array(F.struct(entry["large"].alias("large"), entry["block"].alias("block")))))
                        .otherwise(state["blocks"]).alias("blocks"))

    grouped = entries.groupBy("source", "fraction").agg(order.alias("entries"))
    chosen = grouped.select("source", F.explode(F.aggregate("entries", start, step)["blocks"]).alias("b"))
    return chosen.select("source", (-F.col("b.large")).alias("size_class"), F.col("b.block").alias("block"), F.lit(1).alias("extra"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text, source, ...) with `size`, `source_size`, `target` and `repeats`.

    Every document is repeated as often as its source's target holds its source's size; the fraction that is left is drawn
    by a seeded hash of id and text within classes of like size. Equal rows hash alike and are taken alike. A null text has
    size 0, null sources are one source, an empty table gives an empty one. Columns of `docs` with a name used here are
    replaced.
    """
    own = ["size", "source_size", "target", "repeats"]
    docs = docs.drop(*own)
    cell = free_name(docs, "_cell")
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size"))).cast("int")).otherwise(-1)
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(BLOCKS)).cast("int")
    sized = docs.withColumn("size", words(F.col("text")).cast("long")).withColumn(cell, F.struct(size_class.alias("size_class"), block.alias("block")))
    entries = materialise(sized.groupBy("source", f"{cell}.size_class", f"{cell}.block").agg(F.sum("size").alias("size")), "entries")
    sources = targets(entries.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    epoch = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = materialise(sources.withColumn("whole", F.floor(epoch).cast("int")).withColumn("fraction", epoch - F.col("whole")), "targets")
    s, e = sources.alias("s"), entries.alias("e")
    known = e.join(s, F.expr("s.source <=> e.source")).select(
        "e.source", "e.size_class", "e.block", "e.size", "s.source_size", "s.target", "s.whole", "s.fraction")
    drawn = _drawn(known.filter("fraction > 0"))
    k, d = known.alias("k"), drawn.alias("d")
    plan = k.join(d, F.expr("k.source <=> d.source and k.size_class = d.size_class and k.block = d.block"), "left").select(
        F.struct("k.source", "k.size_class", "k.block").alias("of"),
        "k.source_size", "k.target", (F.col("k.whole") + F.coalesce("d.extra", F.lit(0))).alias("repeats"))
    plan = materialise(plan, "repeats").alias("p")
    same = F.expr(f"d.source <=> p.of.source and d.`{cell}`.size_class = p.of.size_class and d.`{cell}`.block = p.of.block")
    joined = sized.alias("d").join(plan, same)
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], "d.size", "p.source_size", "p.target", "p.repeats")
