"""Search API responses to article rows. One job, parameterised by a column mapping per provider."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.url import is_safe_url, publisher_host, unwrap_redirect
from factweave.sources.feeds import EXCERPT_LIMIT, plain_text

UNKNOWN_PUBLISHER = "Unknown publisher"


@dataclass(frozen=True)
class ResponseShape:
    """How one provider's JSON becomes articles.

    `schema` is the DDL of a response, `items` the path of its list; the other fields are Columns over one item
    called `item`. `excerpt=None` means the provider has none.
    """

    provider: str
    schema: str
    items: str
    title: Column
    url: Column
    publisher: Column
    published_at: Column
    excerpt: Column | None = None
    author: Column | None = None
    canonical_url: Column | None = None
    drop_titles: tuple[str, ...] = ()
    default_tier: int = 4
    excerpt_limit: int | None = EXCERPT_LIMIT


def compact_timestamp(text: Column) -> Column:
    """20260912T101500Z, or any ISO instant."""
    compact = F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.coalesce(compact.cast("timestamp_ntz"), iso_instant(text))


def iso_instant(text: Column) -> Column:
    """ISO instant in UTC, NULL when it cannot be read."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def _item(path: str) -> Column:
    return F.col(f"item.{path}")


def event_list_shape() -> ResponseShape:
    """Nested list, compact timestamps, no excerpt."""
    return ResponseShape(
        "event-list", "articles array<struct<url:string,title:string,seendate:string,domain:string,sourcecountry:string>>", "articles",
        _item("title"), _item("url"), F.coalesce(F.col("source_name"), _item("domain")), compact_timestamp(_item("seendate")))


def news_value_shape() -> ResponseShape:
    """`value[]` with name, description and a provider list."""
    return ResponseShape(
        "news-value", "value array<struct<name:string,url:string,description:string,datePublished:string,provider:array<struct<name:string>>>>", "value",
        _item("name"), _item("url"), F.coalesce(F.try_element_at(_item("provider"), F.lit(1))["name"], F.col("source_name")),
        iso_instant(_item("datePublished")), _item("description"))


def page_map_shape() -> ResponseShape:
    """`items[]` with page meta tags: publisher, canonical URL and date come from them."""
    tags = F.try_element_at(_item("pagemap.metatags"), F.lit(1))
    tag = lambda name: F.try_element_at(tags, F.lit(name))
    date = F.coalesce(tag("article:published_time"), tag("og:published_time"), tag("date"), tag("dc.date"))
    canonical = tag("og:url")
    return ResponseShape(
        "page-map", "items array<struct<title:string,link:string,snippet:string,displayLink:string,pagemap:struct<metatags:array<map<string,string>>>>>", "items",
        _item("title"), _item("link"), F.coalesce(tag("og:site_name"), F.col("source_name"), _item("displayLink")),
        iso_instant(date), _item("snippet"), tag("author"), F.when(is_safe_url(canonical), canonical))


def article_list_shape() -> ResponseShape:
    """`articles[]` with a source object; withdrawn rows carry a marker title."""
    return ResponseShape(
        "article-list", "articles array<struct<source:struct<name:string>,author:string,title:string,description:string,url:string,publishedAt:string>>", "articles",
        _item("title"), _item("url"), F.coalesce(_item("source.name"), F.col("source_name")), iso_instant(_item("publishedAt")),
        _item("description"), _item("author"), drop_titles=("[Removed]",), excerpt_limit=None)


def flatten_responses(responses: DataFrame, shape: ResponseShape, body: str = "body", language: str = "language",
                      lookup=None) -> DataFrame:
    """Articles of one provider's responses; unsafe URLs, withdrawn titles and unreadable responses give no row.

    `lookup(df)` may add the catalogue's `source_name` and `source_tier` by URL.
    """
    parsed = responses.select(F.col(language).alias("language"), F.from_json(body, shape.schema, {"mode": "PERMISSIVE"}).alias("r"))
    items = parsed.select("language", F.explode(F.col(f"r.{shape.items}")).alias("item"))
    items = items.filter(shape.url.isNotNull() & shape.title.isNotNull() & is_safe_url(shape.url))
    if shape.drop_titles:
        items = items.filter(~shape.title.isin(*shape.drop_titles))
    items = items.withColumn("url", shape.url)
    if lookup is not None:
        items = lookup(items).drop("is_dedicated")
    else:
        items = items.withColumn("source_name", F.lit(None).cast("string")).withColumn("source_tier", F.lit(shape.default_tier))
    null = F.lit(None).cast("string")
    excerpt = null if shape.excerpt is None else shape.excerpt
    if shape.excerpt is not None and shape.excerpt_limit:
        excerpt = F.substring(excerpt, 1, shape.excerpt_limit)
    publisher = F.coalesce(shape.publisher, publisher_host(F.col("url")), F.lit(UNKNOWN_PUBLISHER))
    return items.select(
        F.lit(shape.provider).alias("provider"), publisher.alias("publisher"), shape.title.alias("title"), "url",
        (null if shape.canonical_url is None else shape.canonical_url).alias("canonical_url"), shape.published_at.alias("published_at"),
        excerpt.alias("excerpt"), (null if shape.author is None else shape.author).alias("author"), "language", "source_tier")


def aggregator_articles(items: DataFrame, language: str = "language", provider: str = "aggregator-rss", default_tier: int = 4) -> DataFrame:
    """Feed items of an aggregator: the publisher suffix leaves the title, redirects are unwrapped."""
    suffix = F.concat(F.lit(" - "), F.col("source"))
    title = F.when(F.endswith("title", suffix), F.rtrim(F.substring(F.col("title"), F.lit(1), F.length("title") - F.length(suffix)))).otherwise(F.col("title"))
    url = unwrap_redirect(F.col("link"))
    return items.withColumn("url", url).filter(is_safe_url(F.col("url"))).select(
        F.lit(provider).alias("provider"), F.coalesce("source", publisher_host(F.col("url")), F.lit(UNKNOWN_PUBLISHER)).alias("publisher"),
        title.alias("title"), "url", F.lit(None).cast("string").alias("canonical_url"), "published_at",
        F.substring(plain_text(F.col("description")), 1, EXCERPT_LIMIT).alias("excerpt"), "author", F.col(language).alias("language"),
        F.lit(default_tier).alias("source_tier"))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources in one table; columns a source lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
