"""Source catalogue: a small dimension of hosts with tier, language and flags, and the tier lookup by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.url import host_suffixes, url_host
from factweave.session import table_bytes

CATALOGUE_SCHEMA = ("slug string, name string, site string, feed_url string, tier int, country string, language string, "
                    "is_official boolean, is_dedicated boolean, enabled boolean")
BROADCAST_LIMIT = 64 << 20

# --- Fixed values: sources monitored by default ---------------------------------------------------
# (slug, name, site, feed, tier, country, language, official, dedicated to the industry)
DEFAULT_SOURCES = (
    ("uk-hse", "UK Health and Safety Executive", "hse.gov.uk", "https://press.hse.gov.uk/feed/", 1, "United Kingdom", "en", True, False),
    ("uk-hse-offshore", "UK HSE - Offshore Major Accident Regulator", "hse.gov.uk/offshore", None, 1, "United Kingdom", "en", True, True),
    ("uk-nsta", "North Sea Transition Authority", "nstauthority.co.uk", None, 1, "United Kingdom", "en", True, True),
    ("no-havtil", "Havtil (Norwegian Ocean Industry Authority)", "havtil.no", None, 1, "Norway", "no", True, True),
    ("no-sodir", "Norwegian Offshore Directorate", "sodir.no", None, 1, "Norway", "no", True, True),
    ("br-anp", "ANP - Agencia Nacional do Petroleo", "gov.br/anp", None, 1, "Brazil", "pt", True, True),
    ("us-bsee", "BSEE", "bsee.gov", None, 1, "United States", "en", True, True),
    ("us-phmsa", "PHMSA", "phmsa.dot.gov", None, 1, "United States", "en", True, True),
    ("us-csb", "US Chemical Safety Board", "csb.gov", None, 1, "United States", "en", True, False),
    ("au-nopsema", "NOPSEMA", "nopsema.gov.au", None, 1, "Australia", "en", True, True),
    ("ca-tsb", "Transportation Safety Board of Canada", "tsb.gc.ca", None, 1, "Canada", "en", True, False),
    ("reuters-energy", "Reuters - Energy", "reuters.com", None, 2, None, "en", False, False),
    ("bloomberg-energy", "Bloomberg - Energy", "bloomberg.com", None, 2, None, "en", False, False),
    ("bbc-business", "BBC News - Business", "bbc.co.uk", "https://feeds.bbci.co.uk/news/business/rss.xml", 2, "United Kingdom", "en", False, False),
    ("ap-news", "Associated Press", "apnews.com", None, 2, None, "en", False, False),
    ("offshore-energy", "Offshore Energy", "offshore-energy.biz", "https://www.offshore-energy.biz/feed/", 3, None, "en", False, True),
    ("offshore-magazine", "Offshore Magazine", "offshore-mag.com", None, 3, None, "en", False, True),
    ("upstream-online", "Upstream", "upstreamonline.com", None, 3, None, "en", False, True),
    ("energy-voice", "Energy Voice", "energyvoice.com", "https://www.energyvoice.com/feed/", 3, None, "en", False, True),
    ("world-oil", "World Oil", "worldoil.com", "https://worldoil.com/rss?feed=news", 3, None, "en", False, True),
    ("ogj", "Oil & Gas Journal", "ogj.com", None, 3, None, "en", False, True),
    ("rigzone", "Rigzone", "rigzone.com", "https://www.rigzone.com/news/rss/rigzone_latest.aspx", 3, None, "en", False, True),
    ("spglobal-ci", "S&P Global Commodity Insights", "spglobal.com", None, 3, None, "en", False, True),
    ("petronoticias", "Petronoticias", "petronoticias.com.br", None, 3, "Brazil", "pt", False, True),
    ("epbr", "agencia epbr", "epbr.com.br", None, 3, "Brazil", "pt", False, True),
)


def default_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, True) for row in DEFAULT_SOURCES], CATALOGUE_SCHEMA)


def list_sources(catalogue: DataFrame) -> DataFrame:
    """Enabled sources by tier and name."""
    return catalogue.filter("enabled").orderBy("tier", "name")


def pollable_feeds(catalogue: DataFrame) -> DataFrame:
    return catalogue.filter(F.col("feed_url").isNotNull())


def sites_by_host(catalogue: DataFrame, position: str = "position") -> DataFrame:
    """One row per host: paths are dropped, a later entry of the same host replaces an earlier one.

    The kept row remembers the first position of its host, which decides between several matching suffixes.
    """
    keyed = catalogue.withColumn("_host", F.substring_index("site", "/", 1)).filter(F.col("site").isNotNull())
    return keyed.groupBy("_host").agg(
        F.max_by(F.struct("name", "tier", "is_dedicated"), position).alias("s"), F.min(position).alias("_first")).select(
        F.col("_host").alias("site_host"), "s.*", F.col("_first").alias("site_position"))


def with_source(articles: DataFrame, sites: DataFrame, url: str = "url", default_tier: int = 5) -> DataFrame:
    """Add `source_tier`, `source_name` and `is_dedicated` by the article's host.

    The exact host wins, then the first catalogue host it is a subdomain of, then government and military domains
    (tier 1), then the default. Only different hosts are looked up: each is exploded into its parent domains and meets the
    catalogue by equality (broadcast after a size check); articles then meet their host's entry.
    """
    host = F.regexp_replace(url_host(F.col(url)), r"^(www|m|amp)\.", "")
    hosted = articles.withColumn("_host", host)
    hosts = hosted.select("_host").distinct().select("_host", F.posexplode(host_suffixes(F.col("_host"))).alias("_depth", "site_host"))
    small = F.broadcast(sites) if table_bytes(sites) <= BROADCAST_LIMIT else sites
    found = hosts.join(small, "site_host").groupBy("_host").agg(
        F.min_by(F.struct("name", "tier", "is_dedicated"), F.struct((F.col("_depth") > 0).alias("parent"), "site_position")).alias("_site"))
    return _apply_tier(hosted.join(found, "_host", "left").drop("_host"), url, default_tier)


def _apply_tier(joined: DataFrame, url: str, default_tier: int) -> DataFrame:
    raw_host = url_host(F.col(url))
    official = raw_host.rlike(r"\.(gov|gov\.[a-z]{2}|mil)$") | raw_host.rlike(r"(?<![a-z0-9_])gov\.")
    tier = F.coalesce(F.col("_site.tier"), F.when(official, F.lit(1)), F.lit(default_tier))
    kept = [c for c in joined.columns if c not in ("_site", "source_tier", "source_name", "is_dedicated")]
    return joined.select(*kept, tier.cast("int").alias("source_tier"), F.col("_site.name").alias("source_name"),
                         F.coalesce(F.col("_site.is_dedicated"), F.lit(False)).alias("is_dedicated"))
