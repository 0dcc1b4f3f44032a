"""Saved queries: a deterministic plan, and matching articles against it (percolation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import fold_case, fold_literal, tokenise
from factweave.operators.skew import keep_first, salted_join
from factweave.session import materialise, spread

BLANK_SHARES = 32


def query_id(language: Column, region: Column, text: Column) -> Column:
    """language:region:slug, the slug being at most 60 characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-|-$)", "")
    return F.concat_ws(":", language, region, F.substring(slug, 1, 60))


def plan(queries: DataFrame, max_queries: int) -> DataFrame:
    """First query per id in `position` order, then by priority and id, at most `max_queries` (one at least)."""
    keyed = queries.withColumn("query_id", query_id(F.col("language"), F.col("region"), F.col("text")))
    return keep_first(keyed, ["query_id"], "position").orderBy(F.desc("priority"), "query_id").limit(max(1, max_queries))


def expand_plan(seeds: DataFrame, region_hints: DataFrame, regions: list[str], keywords: DataFrame | None = None,
                hints_per_region: int = 3) -> DataFrame:
    """Candidate queries of a scan.

    `seeds` (language, text, kind, sector, category, priority, position): kind 'core' runs worldwide as it is; kind
    'regional' is paired with the first `hints_per_region` place hints (region, hint, hint_position from 0) of each requested region.
    `keywords` (keyword, language, position) become high-priority queries anchored to the industry.
    """
    columns = ["text", "language", "region", "country", "sector", "category", "priority", "position"]
    core = seeds.filter(F.col("kind") == "core").select(
        "text", "language", F.lit("worldwide").alias("region"), F.lit(None).cast("string").alias("country"), "sector", "category", "priority", "position")
    wanted = [r for r in regions if r != "worldwide"]
    hints = region_hints.filter(F.col("region").isin(*wanted) & (F.col("hint_position") < hints_per_region)).select("region", "hint", "hint_position")
    placed = seeds.filter(F.col("kind") == "regional").withColumn("region", F.explode(F.array(*[F.lit(r) for r in wanted]).cast("array<string>")))
    paired = placed.join(hints, "region")
    regional = paired.select(
        F.concat_ws(" ", "text", "hint").alias("text"), "language", "region", F.col("hint").alias("country"), "sector",
        F.lit("regional").alias("category"), "priority", (F.col("position") * 100 + F.col("hint_position") + 100000).alias("position"))
    out = core.unionByName(regional)
    if keywords is not None:
        anchored = F.when(F.col("keyword").rlike("(?i)oil|gas|petro|well|rig|platform|refin|pipeline"), F.col("keyword")).otherwise(
            F.concat(F.col("keyword"), F.lit(" (oil OR gas OR petroleum)")))
        out = out.unionByName(keywords.select(
            anchored.alias("text"), "language", F.lit("worldwide").alias("region"), F.lit(None).cast("string").alias("country"),
            F.lit("unknown").alias("sector"), F.lit("user-keyword").alias("category"), (110 - F.col("position")).alias("priority"),
            (F.col("position") + 1_000_000).alias("position")))
    return out.select(*columns)


def _grams(word: Column) -> Column:
    """The different pieces of one to three characters of a word."""
    starts = F.sequence(F.lit(1), F.length(word))
    pieces = F.transform(starts, lambda i: F.array(*[word.substr(i, F.lit(n)) for n in (1, 2, 3)]))
    return F.array_distinct(F.flatten(pieces))


def _compiled(queries: DataFrame) -> DataFrame:
    """(query_id, phrases, terms): the quoted phrases of each query and the tokens of its whole text, repeats kept."""
    phrases = F.transform(F.regexp_extract_all("text", F.lit('"([^"]+)"'), F.lit(1)), fold_case)
    return queries.select("query_id", F.filter(phrases, lambda x: x != "").alias("phrases"), tokenise(F.regexp_replace("text", '"', "")).alias("terms"))


def _longest_word(phrase: Column) -> Column:
    """The longest piece of a phrase without a space, which lies inside one word of every text that has the phrase."""
    pieces = F.split(phrase, r"\s+")
    return F.array_max(F.transform(pieces, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def _probes(tokens: DataFrame, inside: DataFrame) -> DataFrame:
    """(query_id, needle): of the n tokens of each query, repeats counted, the n // 2 + 1 that the fewest articles can have."""
    counts = inside.groupBy("needle").agg(F.sum("articles").alias("articles"))
    of_query = Window.partitionBy("query_id")
    rare = F.row_number().over(of_query.orderBy(F.coalesce("articles", F.lit(0)), "needle", "place"))
    ranked = tokens.join(counts, "needle", "left").withColumns({"rare": rare, "n": F.count(F.lit(1)).over(of_query)})
    return ranked.filter(F.col("rare") <= F.floor(F.col("n") / 2) + 1).select("query_id", "needle").distinct()


def percolate(articles: DataFrame, queries: DataFrame, exclude=(), max_results: int | None = None) -> DataFrame:
    """(query_id, article_id, hits, terms) for every saved query an article answers; query ids are unique.

    An article answers a query when it contains one of its quoted phrases, or at least half of its tokens as substrings; a
    query without tokens is answered by all. A plan may have any number of queries: a token has no space, so it lies inside one
    word. The different words of all articles meet the different tokens by the first (at most three) characters of the token,
    and articles meet tokens by word. Of n tokens only the rarest n // 2 + 1 are looked up (`_probes`): an article that has none
    of them has fewer than half. All tokens are counted in the texts of the articles found. A phrase is looked up by its longest
    word and then verified in the text. `max_results` keeps the first articles per query in id order.
    """
    plan_rows = materialise(_compiled(queries), "percolate-plan")
    text = fold_case(F.concat_ws(" ", "title", F.coalesce("excerpt", F.lit("")), "publisher"))
    stream = spread(articles).select(F.col("id").alias("article_id"), text.alias("_text"))
    for keyword in exclude:
        if keyword:
            stream = stream.filter(~F.contains("_text", F.lit(fold_literal(keyword))))
    stream = materialise(stream, "percolate-texts")

    tokens = plan_rows.select("query_id", F.posexplode("terms").alias("place", "needle"))
    quoted = plan_rows.select("query_id", F.explode("phrases").alias("phrase")).withColumn("needle", _longest_word(F.col("phrase")))
    needles = tokens.select("needle").unionByName(quoted.select("needle")).filter("needle <> ''").distinct().withColumn("gram", F.substring("needle", 1, 3))
    words = stream.select("article_id", F.explode(F.array_distinct(F.split("_text", r"\s+"))).alias("word")).filter("word <> ''")
    vocabulary = words.groupBy("word").agg(F.count(F.lit(1)).alias("articles")).select("word", "articles", F.explode(_grams(F.col("word"))).alias("gram"))
    inside = vocabulary.join(needles, "gram").filter(F.contains("word", F.col("needle"))).select("word", "articles", "needle").distinct()
    inside = materialise(inside, "percolate-words")
    probes = materialise(_probes(tokens, inside), "percolate-probes")
    wanted = probes.select("needle").unionByName(quoted.select("needle")).distinct()
    seen = materialise(salted_join(words, inside.join(wanted, "needle").select("word", "needle"), "word", "article_id").select("article_id", "needle").distinct(), "percolate-seen")

    able = salted_join(seen, probes, "needle", "article_id").select("query_id", "article_id", F.lit(False).alias("quoted"))
    asked = salted_join(seen, quoted.filter("needle <> ''"), "needle", "article_id").select("query_id", "article_id", "phrase")
    said = stream.join(asked, "article_id").filter(F.contains("_text", F.col("phrase"))).select("query_id", "article_id")
    # Queries that name nothing to look up are compared with every article, a share of the articles at a time.
    blank = plan_rows.filter((F.size("terms") == 0) | F.exists("phrases", lambda x: F.trim(x) == ""))
    blank = blank.select("query_id", "phrases", F.size("terms").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(BLANK_SHARES - 1))).alias("share"))
    shares = stream.withColumn("share", F.pmod(F.xxhash64("article_id"), F.lit(BLANK_SHARES)).cast("int"))
    everyone = shares.join(blank, "share").filter((F.col("n") == 0) | F.exists("phrases", lambda x: F.contains("_text", x)))
    others = said.unionByName(everyone.select("query_id", "article_id")).withColumn("quoted", F.lit(True))

    pairs = able.unionByName(others).groupBy("query_id", "article_id").agg(F.max("quoted").alias("quoted"))
    terms = plan_rows.select("query_id", "terms")
    counted = pairs.join(terms, "query_id").join(stream, "article_id").select(
        "query_id", "article_id", "quoted", F.size("terms").cast("bigint").alias("terms"),
        F.size(F.filter("terms", lambda t: F.contains("_text", t))).cast("bigint").alias("hits"))
    matched = counted.filter("quoted or hits * 2 >= terms").select("query_id", "article_id", "hits", "terms")
    if max_results is None:
        return matched
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("article_id"))
    return matched.withColumn("_r", rank).filter(F.col("_r") <= max_results).drop("_r")
