"""Text, URL and time expressions against hand-computed values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import url as U
from factweave.functions.time import effective_date, in_window, passes_window, resolve_window
from factweave.operators.users import user_uuid
from factweave.taxonomy import label


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]


def c(name="x"):
    return F.col(name)


@pytest.mark.parametrize("raw, folded", [
    ("Explosão na REFINARIA", "explosao na refinaria"), ("Brønn på sokkelen", "brønn pa sokkelen"), ("Straße Ærø", "straße ærø"), ("Café", "cafe"),
])
def test_fold(spark, raw, folded):
    assert one(spark, T.fold_case(c()), x=raw) == folded
    assert T.fold_literal(raw) == folded


def test_normalise_and_tokens(spark):
    assert one(spark, T.normalise_text(c()), x="  Fire, at\tRig-7! ") == "fire at rig 7"
    assert one(spark, T.tokenise(c()), x="The fire at the rig: two men after a fire") == ["fire", "rig", "two", "men", "fire"]
    assert one(spark, T.token_set(c()), x="of the a") == []


def test_names(spark):
    assert one(spark, T.organisation_name(c()), x="Boreal Holding Energy, Inc.") == "boreal energy"
    assert one(spark, T.name_similarity(c(), F.lit("boreal")), x="boreal energy") == 0.9
    assert one(spark, T.name_similarity(c(), F.lit("")), x="boreal") is None
    assert one(spark, T.levenshtein_similarity(c(), F.lit("kitten")), x="sitting") == pytest.approx(1 - 3 / 7)


def test_title_hash_ignores_order(spark):
    a = one(spark, T.title_hash(c()), x="Fire on northern platform")
    assert a == one(spark, T.title_hash(c()), x="Northern platform: fire")
    assert a != one(spark, T.title_hash(c()), x="Northern platform: flood")


def test_truncate(spark):
    assert one(spark, T.truncate(c(), 10), x="short") == "short"
    assert one(spark, T.truncate(c(), 10), x="abcdefg hijklm") == "abcdefg..."
    assert one(spark, T.truncate(c(), 10), x="abc defghijklmnop") == "abc defghi..."


def test_similarity_edges(spark):
    e = F.array().cast("array<string>")
    assert one(spark, T.headline_similarity(e, e)) == 1.0
    assert one(spark, T.headline_similarity(e, F.array(F.lit("a")))) == 0.0
    assert one(spark, T.headline_similarity(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == pytest.approx(0.95)


@pytest.mark.parametrize("url, key", [
    ("HTTP://WWW.Example.com/News/index.html?utm_source=a&b=2&a=1#top", "https://example.com/News?a=1&b=2"),
    ("https://m.example.com:443/story/amp/", "https://example.com/story"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com/?fbclid=1", "https://example.com/"),
    ("https://example.com:8443/a//", "https://example.com:8443/a"),
    ("Not A Url ", "not a url"),
    ("https://user:pw@example.com/a", "https://user:pw@example.com/a"),
])
def test_normalise_url(spark, url, key):
    assert one(spark, U.normalise_url(c()), x=url) == key


@pytest.mark.parametrize("url, safe", [
    ("https://example.com/a", True), ("ftp://example.com/a", False), ("javascript:alert(1)", False), ("https://u:p@example.com", False), ("https:///nohost", False),
])
def test_safe_url(spark, url, safe):
    assert one(spark, U.is_safe_url(c()), x=url) is safe


def test_hosts_and_redirects(spark):
    assert one(spark, U.publisher_host(c()), x="https://www.news.example.co.uk/x") == "example.co.uk"
    assert one(spark, U.publisher_host(c()), x="https://a.b.example.org/x") == "example.org"
    assert one(spark, U.publisher_host(c()), x="mailto:x") is None
    assert one(spark, U.unwrap_redirect(c()), x="https://r.example.com/go?u=https%3A%2F%2Fpaper.example.org%2Fa") == "https://paper.example.org/a"
    assert one(spark, U.unwrap_redirect(c()), x="https://r.example.com/go?u=ftp%3A%2F%2Fx") == "https://r.example.com/go?u=ftp%3A%2F%2Fx"


def test_windows(spark):
    now = datetime(2026, 3, 15, 12)
    week = resolve_window(now, "last_7_days")
    assert (week.from_date, week.to_date) == (date(2026, 3, 8), date(2026, 3, 15))
    assert resolve_window(now, "today").from_date == date(2026, 3, 15)
    assert resolve_window(now, "today", "2026-01-01", "2026-02-01") == type(week)(date(2026, 1, 1), date(2026, 2, 1))
    assert resolve_window(now, "today", None, "2026-02-01").to_date == date(2026, 3, 15)
    day = F.lit(date(2026, 3, 8))
    assert one(spark, in_window(day, week)) is True
    assert one(spark, in_window(F.lit(None).cast("date"), week)) is False
    assert one(spark, passes_window(F.lit(date(2030, 1, 1)), resolve_window(now, "all_time"))) is True
    stamp = F.lit(datetime(2026, 3, 9, 23))
    assert one(spark, effective_date(F.lit(None).cast("date"), stamp, "incident_date")) == date(2026, 3, 9)


def test_labels_and_keys(spark):
    assert one(spark, label(c()), x="gas_leak") == "Gas Leak"
    assert one(spark, label(c()), x="p_and_a") == "P&A"
    assert one(spark, label(c()), x="lng_carrier") == "LNG Carrier"
    assert one(spark, label(F.lit(None).cast("string"))) == "Not reported"
    key = one(spark, user_uuid(c()), x="device:1")
    assert key[14] == "5" and key[19] in "89ab" and len(key) == 36
    assert one(spark, user_uuid(c()), x=key.upper()) == key


def test_trigrams_bind_their_text(spark):
    """The padded text is computed once for each side, not once for every window; results are those of plain windows."""
    assert str(T.trigram_similarity(c("x"), c("y"))._jc).count("regexp_replace") == 2
    for x, y in (("Fire  at\trig", "fire at the RIG"), ("", "a"), ("", ""), ("é", "éé"), (" ", "fire"), ("abc", "xyz")):
        grams = [{p[i:i + 3] for i in range(len(p) - 2)} for p in (f" {' '.join(t.lower().split())} " for t in (x, y))]
        assert set(one(spark, T.trigrams(c()), x=x)) == grams[0]
        union = grams[0] | grams[1]
        assert one(spark, T.trigram_similarity(c("x"), c("y")), x=x, y=y) == pytest.approx(len(grams[0] & grams[1]) / len(union) if union else 1.0)
    missing = spark.sql("SELECT CAST(NULL AS STRING) AS x, 'fire' AS y").select(T.trigrams(c()).alias("t"), T.trigram_similarity(c("x"), c("y")).alias("s"), T.trigram_similarity(c("y"), c("x")).alias("r")).first()
    assert tuple(missing) == (None, None, None)
