"""Feed documents (RSS and Atom) to article rows: a table of XML texts in, one row per item out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.url import is_safe_url
from factweave.session import spread

# --- Fixed values: named entities and feed date formats -------------------------------------------
ENTITIES = (("nbsp", " "), ("ndash", "-"), ("mdash", "-"), ("hellip", "..."), ("rsquo", "'"), ("lsquo", "'"),
            ("ldquo", '"'), ("rdquo", '"'), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"))
DATE_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd")
EXCERPT_LIMIT = 600

_ITEM = r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"


def decode_entities(text: Column) -> Column:
    """Numeric and named character references, one level; & last so that nothing is decoded twice."""
    numeric = text.rlike(r"&#")
    pieces = F.regexp_extract_all(text, F.lit(r"&#[xX]?[0-9a-fA-F]+;|[^&]+|&"), F.lit(0))
    code = lambda p: F.when(p.rlike(r"^&#[xX]"), F.conv(F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(
        F.regexp_extract(p, r"^&#([0-9]+);$", 1))
    char = lambda p: F.when(p.rlike(r"^&#([xX][0-9a-fA-F]+|[0-9]+);$"), _character(code(p).try_cast("int"))).otherwise(p)
    out = F.when(numeric, F.array_join(F.transform(pieces, char), "")).otherwise(text)
    for name, value in ENTITIES:
        out = F.regexp_replace(out, f"(?i)&{name};", value)
    return out


def _character(code: Column) -> Column:
    """The character of a code point, through its UTF-8 bytes."""
    byte = lambda value: F.lpad(F.hex(value), 2, "0")
    low = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    utf8 = (
        F.when(code < 128, byte(code))
        .when(code < 2048, F.concat(byte(F.shiftright(code, 6).bitwiseOR(F.lit(192))), byte(low(0))))
        .when(code < 65536, F.concat(byte(F.shiftright(code, 12).bitwiseOR(F.lit(224))), byte(low(6)), byte(low(0))))
        .otherwise(F.concat(byte(F.shiftright(code, 18).bitwiseOR(F.lit(240))), byte(low(12)), byte(low(6)), byte(low(0))))
    )
    return F.decode(F.unhex(utf8), "UTF-8")


def plain_text(markup: Column) -> Column:
    """Markup, real or escaped, to plain text with single spaces."""
    bare = F.regexp_replace(decode_entities(markup), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(bare), r"\s+", " "))


def tag_text(block: Column, tag: str) -> Column:
    """Plain text of the first such element, CDATA unwrapped, NULL when missing or empty."""
    body = F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    cdata = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
    inner = F.when(body.rlike(cdata), F.regexp_extract(body, cdata, 1)).otherwise(body)
    return F.nullif(plain_text(inner), F.lit(""))


def _atom_link(block: Column) -> Column:
    alternate = F.regexp_extract(block, r"""(?is)<link[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)["'][^>]*>""", 1)
    first = F.regexp_extract(block, r"""(?is)<link[^>]*href=["']([^"']+)["'][^>]*/?>""", 1)
    return decode_entities(F.coalesce(F.nullif(alternate, F.lit("")), F.nullif(first, F.lit(""))))


def feed_date(text: Column) -> Column:
    """UTC timestamp of a feed date in any of the usual formats; anything else is NULL, never now."""
    dated = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    utc = F.regexp_replace(dated, r"(?i)\b(GMT|UT|UTC|Z)$", "+0000")
    tries = [F.try_to_timestamp(utc, F.lit(f)) for f in DATE_FORMATS]
    tries += [F.try_to_timestamp(F.regexp_replace(F.trim(text), "z$", "Z"), F.lit(f)) for f in ISO_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def explode_feeds(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """One row per item with title and link: `key`, position, title, link, description, published_at, author, source, guid."""
    blocks = spread(documents).select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(_ITEM), F.lit(1))).alias("position", "_block"))
    b = F.col("_block")
    items = blocks.select(
        key, "position",
        tag_text(b, "title").alias("title"),
        F.coalesce(tag_text(b, "link"), _atom_link(b)).alias("link"),
        F.coalesce(tag_text(b, "description"), tag_text(b, "summary"), tag_text(b, "content")).alias("description"),
        F.coalesce(tag_text(b, "pubDate"), tag_text(b, "published"), tag_text(b, "updated")).alias("_date"),
        F.coalesce(tag_text(b, "author"), tag_text(b, "dc:creator")).alias("author"),
        tag_text(b, "source").alias("source"),
        F.coalesce(tag_text(b, "guid"), tag_text(b, "id")).alias("guid"),
    )
    return items.filter(F.col("title").isNotNull() & F.col("link").isNotNull()).withColumn(
        "published_at", feed_date(F.col("_date"))).drop("_date")


def feed_articles(items: DataFrame, feeds: DataFrame, provider: str = "rss") -> DataFrame:
    """Raw articles of polled feeds; publisher, language and tier come from the feed's catalogue row.

    `items` and `feeds` share the column `feed`; the catalogue is a small dimension table.
    """
    joined = items.join(feeds.select("feed", F.col("name").alias("_name"), F.col("language"), F.col("tier")), "feed")
    return joined.filter(is_safe_url(F.col("link"))).select(
        F.lit(provider).alias("provider"), F.coalesce("source", "_name").alias("publisher"), "title", F.col("link").alias("url"),
        F.lit(None).cast("string").alias("canonical_url"), "published_at",
        F.substring("description", 1, EXCERPT_LIMIT).alias("excerpt"), "author", "language", F.col("tier").cast("int").alias("source_tier"),
        F.create_map(F.lit("feed"), F.col("feed"), F.lit("guid"), F.col("guid")).alias("raw"))
