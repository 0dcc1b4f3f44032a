"""Article deduplication: exact keys, title within a week, near-identical headlines within two days.

First-wins rule: in arrival order an article is kept unless it duplicates an earlier *kept* article.

No step lists all pairs of a group. Every rule is expressed with *cells*: sets of articles that are pairwise
duplicates. An exact key is one cell. A rule with a time limit cuts its key into time buckets as wide as the
limit, so the articles of one bucket are a cell and only neighbouring buckets need a time check. A cell can hold at
most one kept article of the batch, hence each round works on one row per cell, however many copies it has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.config import FUZZY_TITLE_SIMILARITY, FUZZY_WINDOW_SECONDS, TITLE_WINDOW_SECONDS
from factweave.functions.text import headline_similarity, normalise_text, organisation_name, tokens_of
from factweave.functions.url import normalise_url, publisher_host
from factweave.operators.groups import connected
from factweave.operators.skew import HOT_ROWS, salted_join, split_join
from factweave.session import materialise, spread

REASONS = ("canonical_url", "normalized_url", "content_hash", "title_hash_same_publisher", "fuzzy_syndication")
KEPT, OPEN, DUPLICATE = "kept", "open", "duplicate"


@dataclass(frozen=True)
class DedupRules:
    """Limits of the rules; `ratio` is the needed overlap as numerator and denominator."""

    title_window: int = TITLE_WINDOW_SECONDS
    fuzzy_window: int = FUZZY_WINDOW_SECONDS
    ratio: tuple[int, int] = FUZZY_TITLE_SIMILARITY
    fuzzy: bool = True
    hot_rows: int = HOT_ROWS
    rounds: int = 3
    group_rows: int = 1_000_000


def with_dedup_keys(articles: DataFrame) -> DataFrame:
    """Add the comparison keys of an article; keys that are already present are kept."""
    c = F.col
    # Normalise each text once; every key below reads the staged columns.
    staged = spread(articles).select(
        "*",
        normalise_text(c("title")).alias("_title"),
        normalise_text(F.coalesce(c("excerpt"), F.lit(""))).alias("_excerpt"),
    ).withColumn("_tokens", F.array_sort(tokens_of(c("_title"))))
    own = {
        "canonical_key": normalise_url(c("canonical_url")),
        "normalized_url": normalise_url(F.coalesce(c("canonical_url"), c("url"))),
        "title_hash": F.md5(F.array_join("_tokens", " ")),
        "content_hash": F.md5(F.concat_ws(" ", "_title", "_excerpt")),
        "publisher_key": F.nullif(organisation_name(c("publisher")), F.lit("")),
        "host_key": publisher_host(c("url")),
        "headline_tokens": F.array_distinct("_tokens"),
    }
    kept = [name for name in articles.columns]
    return staged.select(*kept, *[v.alias(k) for k, v in own.items() if k not in kept])


def known_articles(batch: DataFrame, history: DataFrame) -> DataFrame:
    """History rows that share any of four keys with the batch: one semi join per key, no OR join."""
    parts = []
    for column in ("normalized_url", "canonical_url", "title_hash", "content_hash"):
        wanted = batch.select(column).filter(F.col(column).isNotNull()).distinct()
        parts.append(history.join(wanted, column, "left_semi").select("id"))
    ids = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()
    return history.join(ids, "id", "left_semi")


# ------------------------------------------------------------------------------------------------ fuzzy headlines


def _prefix_length(size: Column, ratio: tuple[int, int]) -> Column:
    """How many of a set's rarest tokens must be looked at so that no partner with enough overlap is missed."""
    num, den = ratio
    needed = F.floor((size * num + (den - 1)) / den)
    return (size - needed + 1).cast("int")


def _token_rows(headlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct token sets (sid, set_id, tokens, n, bits), and one row per token of a set: (sid, token, place, n, bits).

    `place` counts from 0, the rarest token first. `bits` has a bit for each token of the set. Both tables are written; the
    second holds no arrays.
    """
    sid = F.struct(F.xxhash64("set_id").alias("h"), F.xxhash64(F.lit(1), "set_id").alias("l")).alias("sid")
    bits = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda x, t: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))
    sets = headlines.filter(F.size("tokens") > 0).groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    sets = materialise(sets.select(sid, "set_id", "tokens", F.size("tokens").alias("n"), bits.alias("bits")), "headline-sets")
    words = sets.select("sid", "n", "bits", F.explode("tokens").alias("token"))
    frequency = words.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy("_df", "token")) - 1
    # A token that very many sets share makes a large partition, which adaptive execution splits.
    rows = words.join(frequency, "token").select("sid", F.xxhash64("token").alias("token"), place.alias("place"), "n", "bits")
    return sets, materialise(rows, "headline-tokens")


def headline_candidates(headlines: DataFrame, rules: DedupRules = DedupRules()) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of set keys that may be similar, the distinct sets they belong to); see `similar_headlines`.

    Of n tokens of the smaller set, `needed` must lie in the larger. Three filters work on rows without token arrays:
    one of the smaller set's n - needed + 1 rarest tokens is shared (prefix); after the first shared token both have enough tokens
    left (position); and the smaller set has at most n - needed bits that the larger lacks (sketch). Token and days that meet
    very often are dealt out to many tasks.
    """
    num, den = rules.ratio
    sets, tokens = _token_rows(headlines)
    placed = headlines.filter(F.size("tokens") > 0).select(F.struct(F.xxhash64("set_id").alias("h"), F.xxhash64(F.lit(1), "set_id").alias("l")).alias("sid"), "bucket", "fresh").groupBy("sid", "bucket").agg(
        F.max("fresh").alias("fresh"))
    rows = materialise(tokens.join(placed, "sid"), "headline-rows")
    n = F.col("n")
    large = rows.select("token", F.col("sid").alias("b"), (n - F.col("place")).alias("b_left"), n.alias("m"), F.col("bits").alias("b_bits"), F.col("bucket").alias("b_bucket"), F.col("fresh").alias("b_fresh"))
    small = rows.filter(F.col("place") < _prefix_length(n, rules.ratio)).select("token", F.col("sid").alias("a"), "n", (n - _prefix_length(n, rules.ratio) + 1).alias("needed"), F.col("bits").alias("a_bits"),
                                                                              F.col("bucket").alias("a_bucket"), F.col("fresh").alias("a_fresh"))

    def met(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
        both = split_join(many, few, keys, "b", rules.hot_rows)
        ordered = ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))) & (F.col("a_fresh") | F.col("b_fresh"))
        lacking = F.bit_count(F.col("a_bits").bitwiseAND(F.bitwise_not(F.col("b_bits"))))
        return both.filter(ordered & (F.col("b_left") >= F.col("needed")) & (lacking <= n - F.col("needed"))).select("a", "b")

    near = small.filter("a_bucket is not null").withColumn("b_bucket", F.explode(F.array(*[F.col("a_bucket") + d for d in (-1, 0, 1)])))
    # Only sets without a date meet by token alone; two dated sets never do.
    parts = [met(large.filter("b_bucket is not null"), near, ["token", "b_bucket"])]
    undated = rows.filter("bucket is null")
    if not undated.isEmpty():
        parts += [met(large, small.filter("a_bucket is null"), ["token"]), met(large.filter("b_bucket is null"), small.filter("a_bucket is not null"), ["token"])]
    return reduce(DataFrame.unionByName, parts).distinct(), sets


def similar_headlines(headlines: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """Pairs of distinct token sets whose overlap reaches the ratio of the smaller set and that meet in time.

    Input: one row per (set_id, tokens, bucket, fresh). Identical headlines are one set, so copies make no pairs. `fresh` marks
    sets of the current batch; two sets of the known pool are not compared. The tokens of a pair are fetched when it has
    passed all filters of `headline_candidates`.
    """
    num, den = rules.ratio
    pairs, sets = headline_candidates(headlines, rules)
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("set_id").alias(f"{x}_set"), F.col("tokens").alias(f"{x}_tokens"), F.col("n").alias(f"{x}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.filter(shared * den >= F.col("a_n") * num).select(
        F.col("a_set").alias("a"), F.col("b_set").alias("b"), headline_similarity(F.col("a_tokens"), F.col("b_tokens")).alias("similarity"))


# ------------------------------------------------------------------------------------------------ cells


def _cell(kind: str, key: Column, bucket: Column | None = None) -> Column:
    suffix = F.lit("") if bucket is None else F.coalesce(bucket.cast("string"), F.lit("undated"))
    return F.concat_ws("|", F.lit(kind), key, suffix)


def _memberships(keyed: DataFrame, rules: DedupRules) -> DataFrame:
    """(seq, t, status, kind, key, bucket, cell): one row per article and rule it takes part in."""
    c = F.col
    t = F.unix_timestamp(c("published_at").cast("timestamp"))
    week = F.floor(t / rules.title_window)
    days = F.floor(t / rules.fuzzy_window)
    none = F.lit(None).cast("bigint")

    def member(kind, key, bucket=None, when=None):
        row = F.struct(F.lit(kind).alias("kind"), key.alias("key"), (none if bucket is None else bucket).alias("bucket"),
                       _cell(kind, key, bucket).alias("cell"))
        return F.when(key.isNotNull() if when is None else when, row)

    rows = [
        member("canonical", c("canonical_key")),
        member("normalized", c("normalized_url")),
        member("content", c("content_hash")),
        member("title_name", F.concat(c("title_hash"), F.lit("/"), c("publisher_key")), week),
        member("title_host", F.concat(c("title_hash"), F.lit("/"), c("host_key")), week),
    ]
    if rules.fuzzy:
        rows.append(member("fuzzy", c("set_id"), days, c("in_fuzzy")))
    return keyed.select("seq", t.alias("t"), "status", F.explode(F.array_compact(F.array(*rows))).alias("m")).select(
        "seq", "t", "status", "m.*")


def _windows(rules: DedupRules) -> Column:
    return F.create_map(F.lit("title_name"), F.lit(rules.title_window), F.lit("title_host"), F.lit(rules.title_window),
                        F.lit("fuzzy"), F.lit(rules.fuzzy_window))


def _links(cells: DataFrame, similar: DataFrame | None, rules: DedupRules) -> DataFrame:
    """(cell, target, window, similarity): which cells must be looked at for the articles of a cell.

    A cell links to itself; a dated cell to the buckets before and after and to the undated one; an undated cell to
    every bucket of the key. Similar headlines link the same way across two keys.
    """
    keys = cells.select("kind", "key", "bucket", "cell")
    own = keys.select("kind", F.col("key").alias("other"), "key", "bucket", "cell", F.lit(1.0).alias("similarity"))
    if similar is not None:
        both = similar.unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
        fuzzy = keys.filter(F.col("kind") == "fuzzy").join(both.withColumnRenamed("a", "key"), "key").select(
            "kind", F.col("b").alias("other"), "key", "bucket", "cell", "similarity")
        own = own.unionByName(fuzzy)
    own = own.withColumn("window", F.try_element_at(_windows(rules), F.col("kind")))
    target = F.concat_ws("|", "kind", "other")
    timed = F.col("window").isNotNull()
    buckets = F.when(~timed, F.array(F.lit(""))).when(
        F.col("bucket").isNotNull(),
        F.concat(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: (F.col("bucket") + d).cast("string")), F.array(F.lit("undated"))))
    direct = own.withColumn("_bucket", F.explode(buckets)).select(
        "cell", F.concat_ws("|", target, "_bucket").alias("target"), "window", "similarity")
    every = keys.select("kind", F.col("key").alias("other"), F.col("cell").alias("target")).distinct()
    undated = own.filter(timed & F.col("bucket").isNull()).join(every, ["kind", "other"]).select("cell", "target", "window", "similarity")
    return direct.unionByName(undated)


_RANK = {"canonical": 0, "normalized": 1, "content": 2, "title_name": 3, "title_host": 3, "fuzzy": 4}


def _time_ok() -> Column:
    gap = F.abs(F.col("t") - F.col("kept_t"))
    return F.col("window").isNull() | F.col("t").isNull() | F.col("kept_t").isNull() | (gap <= F.col("window"))


def _kept_of(members: DataFrame, known: bool) -> DataFrame:
    """Kept articles a cell offers for comparison: of an untimed cell the earliest, of a timed one those that no earlier one can stand for.

    A cell is looked at from cells of earlier days, of later days or of the same days. From earlier days an article stands for
    all that are later in time and in arrival, from later days for all that are earlier in time and later in arrival. What is left is
    a short staircase on either side. A batch keeps one article of a cell at most, so only `known` articles need it.
    """
    kept = members.filter(F.col("status") == KEPT)
    timed = F.col("kind").isin("title_name", "title_host", "fuzzy")
    first = kept.filter(~timed).groupBy("cell").agg(F.min("seq").alias("kept_seq"), F.min_by("t", "seq").alias("kept_t"))
    every = kept.filter(timed).groupBy("cell", "t").agg(F.min("seq").alias("kept_seq")).select("cell", "kept_seq", F.col("t").alias("kept_t"))
    if known:
        # At most one row a second and cell, so a partition of these windows is as long as the rule's limit.
        before, after = (Window.partitionBy("cell").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("kept_t"), F.desc("kept_t")))
        best = {"_below": F.min("kept_seq").over(before), "_above": F.min("kept_seq").over(after)}
        dated = every.filter("kept_t is not null").withColumns(best).filter("_below is null or _above is null or kept_seq < _below or kept_seq < _above")
        every = every.filter("kept_t is null").unionByName(dated.drop(*best))
    return first.unionByName(every)


def _ordered_pass(rows: pa.Table) -> pa.Table:
    """First-wins over one connected group: (seq, status) by arrival, each article against the one kept in every cell it looks at."""
    kept, out = {}, {}
    names = ("seq", "t", "cell", "target", "window")
    held = rows.select(names).sort_by("seq")
    columns = [held[c].to_pylist() for c in names]
    at, n = 0, held.num_rows
    while at < n:
        seq, t, end, duplicate = columns[0][at], columns[1][at], at, False
        while end < n and columns[0][end] == seq:
            target, window = columns[3][end], columns[4][end]
            if target in kept:
                other = kept[target]
                duplicate = duplicate or window is None or t is None or other is None or abs(t - other) <= window
            end += 1
        if not duplicate:
            kept.update((cell, t) for cell in columns[2][at:end])
        out[seq] = DUPLICATE if duplicate else KEPT
        at = end
    return pa.table({"seq": pa.array(out.keys(), pa.int64()), "_new": pa.array(out.values(), pa.string())})


def _settled_groups(live: DataFrame, links: DataFrame, most_rows: int) -> DataFrame:
    """(seq, _new): the verdict of all open articles whose connected group has at most `most_rows` rows of members and links.

    Open articles have no earlier kept one among those they look at, so only open ones matter to each other.
    """
    members = live.filter(F.col("status") == OPEN).select("seq", "t", "cell")
    cells = materialise(members.select("cell").distinct(), "open-cells")
    between = links.select("cell", "target", "window").join(cells, "cell", "left_semi").join(cells.withColumnRenamed("cell", "target"), "target", "left_semi")
    between = materialise(between.distinct(), "open-links")
    node = lambda c: F.xxhash64(c)
    hubs = members.groupBy("seq").agg(F.min(node("cell")).alias("a"))
    edges = between.select(node("cell").alias("a"), node("target").alias("b")).unionByName(members.select("seq", node("cell").alias("b")).join(hubs, "seq").select("a", "b"))
    roots = connected(edges)
    rows = members.join(between, "cell").withColumn("node", node("cell")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = materialise(rows.select("root", "seq", "t", "cell", "target", "window"), "open-rows")
    small = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_rows).select("root")
    return rows.join(small, "root", "left_semi").groupBy("root").applyInArrow(_ordered_pass, "seq bigint, _new string")


def _verdicts(live: DataFrame, links: DataFrame, known: bool, rules: DedupRules) -> DataFrame:
    """(seq, _dup, _wait) of open articles: whether an earlier kept article is a duplicate, whether an earlier open one may be."""
    waiting = live.filter(F.col("status") == OPEN).groupBy("cell").agg(F.min("seq").alias("open_seq"))
    state = _kept_of(live, known).withColumn("open_seq", F.lit(None).cast("bigint")).unionByName(
        waiting.select("cell", F.lit(None).cast("bigint").alias("kept_seq"), F.lit(None).cast("bigint").alias("kept_t"), "open_seq"))
    seen = links.join(state.withColumnRenamed("cell", "target"), "target").select("cell", "window", "kept_seq", "kept_t", "open_seq").distinct()
    open_members = live.filter(F.col("status") == OPEN).select("cell", "seq", "t")
    checks = salted_join(open_members, seen, "cell", "seq", rules.hot_rows, how="left")
    return checks.groupBy("seq").agg(
        F.max(F.coalesce((F.col("kept_seq") < F.col("seq")) & _time_ok(), F.lit(False))).alias("_dup"),
        F.max(F.coalesce(F.col("open_seq") < F.col("seq"), F.lit(False))).alias("_wait"))


def _with_verdicts(live: DataFrame, decided: DataFrame) -> DataFrame:
    """`live` members with their new status, without duplicates."""
    new = live.join(decided, "seq", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return materialise(new.filter(F.col("status") != DUPLICATE), "dedup-round")


def first_wins(articles: DataFrame, known: DataFrame | None = None, rules: DedupRules = DedupRules()) -> DataFrame:
    """Verdict per batch article: `seq`, `is_duplicate`, `reason`, `matched_seq`, `similarity`.

    `articles` need `seq` (arrival order, unique) and the article columns. `known` articles come before the batch
    and are kept by definition; their `seq` must be below every batch `seq`. All of them take part in
    every rule; to hold the fuzzy rule to articles that share an exact key with the batch, pass `known_articles(batch, history)`.

    Each round decides every article whose earlier neighbours are decided. Copies are settled by the first rounds; what is open
    after `rules.rounds` are chains of articles that depend on one another. These are cut into connected groups, in a number of steps
    that follows the logarithm of a chain, and each group is settled by one pass in arrival order. A group of more than
    `rules.group_rows` rows, too large for one task, goes on with rounds.
    """
    columns = ["seq", "published_at", "canonical_key", "normalized_url", "content_hash", "title_hash", "publisher_key",
               "host_key", "headline_tokens"]
    pool = with_dedup_keys(articles).select(*columns, F.lit(OPEN).alias("status"))
    if known is not None:
        pool = pool.unionByName(with_dedup_keys(known).select(*columns, F.lit(KEPT).alias("status")))
    pool = pool.withColumn("set_id", F.md5(F.array_join("headline_tokens", " "))).withColumn("in_fuzzy", F.lit(True))
    pool = materialise(pool, "dedup-pool")

    similar = None
    if rules.fuzzy:
        days = F.floor(F.unix_timestamp(F.col("published_at").cast("timestamp")) / rules.fuzzy_window)
        headlines = pool.groupBy("set_id", days.alias("bucket")).agg(
            F.first("headline_tokens").alias("tokens"), F.max(F.col("status") == OPEN).alias("fresh"))
        similar = materialise(similar_headlines(headlines, rules), "dedup-similar")

    members = materialise(_memberships(pool, rules), "dedup-members")
    cells = members.groupBy("cell", "kind", "key", "bucket").agg(F.count(F.lit(1)).alias("size"))
    links = _links(cells, similar, rules).join(cells.select(F.col("cell").alias("target"), F.col("size").alias("_n")), "target")
    # A cell with one article and no other cell to look at can decide nothing.
    links = links.withColumn("_others", F.when(F.col("cell") == F.col("target"), F.col("_n") - 1).otherwise(F.col("_n")))
    links = materialise(links.filter(F.col("_others") > 0).select("cell", "target", "window", "similarity"), "dedup-links")
    busy = links.select("cell").unionByName(links.select(F.col("target").alias("cell"))).distinct()
    members = materialise(members.join(busy, "cell", "left_semi"), "dedup-busy")
    all_members = members

    live = members
    # Every round decides the earliest open article at least, so this ends whatever the groups are.
    rounds = 0
    while not live.filter(F.col("status") == OPEN).isEmpty():
        rounds += 1
        verdict = _verdicts(live, links, known is not None, rules)
        duplicate = F.when(F.col("_dup"), F.lit(DUPLICATE))
        if rounds == rules.rounds + 1:
            # Articles kept last are compared first, so that no open article has an earlier kept one.
            live = _with_verdicts(live, verdict.filter("_dup").select("seq", duplicate.alias("_new")))
            live = _with_verdicts(live, _settled_groups(live, links, rules.group_rows))
        else:
            live = _with_verdicts(live, verdict.select("seq", duplicate.when(F.col("_wait"), F.lit(OPEN)).otherwise(F.lit(KEPT)).alias("_new")))

    # Duplicates are the batch members that are no longer alive; name the earliest kept article they match.
    lost = all_members.filter(F.col("status") == OPEN).join(live.select("seq").distinct(), "seq", "left_anti")
    offers = links.join(_kept_of(live, known is not None).withColumnRenamed("cell", "target"), "target")
    rank = F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])
    names = F.array(*[F.lit(r) for r in REASONS])
    best = (
        salted_join(lost.select("cell", "seq", "t", "kind"), offers, "cell", "seq", rules.hot_rows)
        .filter((F.col("kept_seq") < F.col("seq")) & _time_ok())
        .groupBy("seq")
        .agg(F.min(F.struct("kept_seq", F.try_element_at(rank, F.col("kind")).alias("rank"), "similarity")).alias("m"))
        .select("seq", F.element_at(names, F.col("m.rank") + 1).alias("reason"), F.col("m.kept_seq").alias("matched_seq"), F.col("m.similarity").alias("similarity"))
    )
    batch = pool.filter(F.col("status") == OPEN).select("seq")
    return batch.join(best, "seq", "left").select(
        "seq", F.col("reason").isNotNull().alias("is_duplicate"), "reason", "matched_seq", "similarity")


def exact_duplicates(articles: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """Earliest other article with the same URL or content key: `seq`, `matched_seq`, `reason`.

    The earliest member of each key group is an aggregate, so a group of any size costs one row. When several keys
    agree on the same earliest article, the reason listed first wins.
    """
    keyed = with_dedup_keys(articles)
    pairs = [("canonical_url", "canonical_key"), ("normalized_url", "normalized_url"), ("content_hash", "content_hash")]
    long = keyed.select("seq", F.explode(F.array_compact(F.array(*[
        F.when(F.col(column).isNotNull(), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("reason"), F.concat_ws("|", F.lit(name), column).alias("cell")))
        for i, (name, column) in enumerate(pairs)]))).alias("k")).select("seq", "k.*")
    first = long.groupBy("cell").agg(F.min("seq").alias("matched_seq"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    return (
        salted_join(long, first, "cell", "seq", rules.hot_rows)
        .filter(F.col("matched_seq") < F.col("seq"))
        .groupBy("seq")
        .agg(F.min(F.struct("matched_seq", "rank", "reason")).alias("m"))
        .select("seq", "m.matched_seq", "m.reason")
    )
