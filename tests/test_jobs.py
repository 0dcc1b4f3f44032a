"""Distributed jobs against sequential Python on small fixtures."""

import gzip
import json
import random
from collections import Counter
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from factweave.config import ScanConfig
from factweave.operators import alerts, dedup, linkage, runs, store, users
from factweave.operators.groups import connected
from factweave.operators.ordered import running_merge, with_previous
from factweave.operators.skew import salted_join
from factweave.plans.scan import funnel, scan
from factweave.schemas import raw_article_checks, split_valid
from factweave.sources import catalogue, feeds, responses, search_api
from factweave.sources.raw import file_ledger, quarantine, scan_raw_articles
from factweave.streaming import ingest
from workload.views import view

ARTICLE = "seq long, id string, title string, excerpt string, publisher string, published_at timestamp_ntz, url string, canonical_url string"
START = datetime(2026, 3, 1)


def articles(n, seed):
    """Random headlines over few words, so that every rule and chains between rules occur."""
    rng = random.Random(seed)
    words = "fire leak rig north south valve crew pump alarm storm".split()
    rows = []
    for i in range(n):
        title = " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 10])))
        when = None if rng.random() < 0.1 else START + timedelta(hours=rng.choice([0, 24, 48, 49, 96, 168, 169, 400]))
        canonical = rng.choice([None, None, f"https://wire.example.org/{rng.randrange(30)}"])
        rows.append((i, str(i), title, rng.choice([None, "same text", f"text {i}"]), rng.choice(["Alpha AS", "ALPHA", "Beta"]), when, f"https://p{rng.randrange(3)}.example.com/{rng.randrange(200)}", canonical))
    return rows


def sequential_first_wins(rows, known=()):
    """The rule as a loop over kept articles."""
    def reason(a, b):
        if a["canonical_key"] and a["canonical_key"] == b["canonical_key"]:
            return "canonical_url"
        if a["normalized_url"] == b["normalized_url"]:
            return "normalized_url"
        if a["content_hash"] == b["content_hash"]:
            return "content_hash"
        gap = abs((a["published_at"] - b["published_at"]).total_seconds()) if a["published_at"] and b["published_at"] else None
        same = (a["publisher_key"] and a["publisher_key"] == b["publisher_key"]) or (a["host_key"] and a["host_key"] == b["host_key"])
        if a["title_hash"] == b["title_hash"] and same and (gap is None or gap <= 7 * 86400):
            return "title_hash_same_publisher"
        x, y = set(a["headline_tokens"]), set(b["headline_tokens"])
        alike = (not x and not y) or (x and y and 19 * len(x & y) >= 17 * min(len(x), len(y)))
        return "fuzzy_syndication" if alike and (gap is None or gap <= 48 * 3600) else None

    kept, out = list(known), {}
    for a in rows:
        for b in kept:
            why = reason(a, b)
            if why:
                out[a["seq"]] = (why, b["seq"])
                break
        else:
            kept.append(a)
            out[a["seq"]] = (None, None)
    return out


@pytest.mark.parametrize("seed, rules", [(1, {}), (2, {"hot_rows": 5, "rounds": 0}), (1, {"rounds": 1, "group_rows": 40})])
def test_first_wins_is_the_sequential_rule(spark, seed, rules):
    df = spark.createDataFrame(articles(150, seed), ARTICLE)
    got = {r.seq: (r.reason, r.matched_seq) for r in dedup.first_wins(df, rules=dedup.DedupRules(**rules)).collect()}
    assert got == sequential_first_wins([r.asDict() for r in dedup.with_dedup_keys(df).orderBy("seq").collect()])
    # The fixture exercises the rules (content copies occur with the first seed only).
    assert {"fuzzy_syndication", "canonical_url", *(["content_hash"] if seed == 1 else [])} <= {v[0] for v in got.values()}


def test_first_wins_of_a_long_chain(spark):
    """Each article repeats its neighbours only: every second one is kept, and the number of jobs does not follow the chain."""
    jobs = []
    for n in (40, 400):
        rows = [(i, str(i), "fire at rig", f"text {i}", "Alpha", START + timedelta(days=5 * i), f"https://p.example.com/{i}", None) for i in range(n)]
        df = spark.createDataFrame(rows, ARTICLE)
        spark.sparkContext.setJobGroup(f"chain {n}", "")
        got = {r.seq: r.matched_seq for r in dedup.first_wins(df).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain {n}")))
        assert got == {i: i - 1 if i % 2 else None for i in range(n)}
    assert jobs[1] < jobs[0] + 60


def test_connected_groups(spark):
    rng = random.Random(9)
    names = rng.sample(range(10**6), 3000)
    pairs = list(zip(names[:999], names[1:1000], strict=True)) + [(rng.choice(names[1000:1400]), rng.choice(names[1000:1400])) for _ in range(300)] + [(names[5], names[5])]
    root = {x: x for p in pairs for x in p}
    for _ in range(1000):
        moved = False
        for a, b in pairs:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert got.keys() == want.keys() and len(set(got.values())) == len(set(want.values())) == len({(got[x], want[x]) for x in want})


def test_first_wins_with_history(spark):
    rows = articles(120, 3)
    df = spark.createDataFrame(rows, ARTICLE)
    keyed = dedup.with_dedup_keys(df)
    first = {r.seq for r in dedup.first_wins(keyed.filter("seq < 50")).filter("NOT is_duplicate").collect()}
    history = keyed.filter(F.col("seq").isin(*first))
    batch = keyed.filter("seq >= 50")
    known = dedup.known_articles(batch, history)
    got = {r.seq: (r.reason, r.matched_seq) for r in dedup.first_wins(batch, known).collect()}
    by_seq = lambda d: [r.asDict() for r in d.orderBy("seq").collect()]
    assert got == sequential_first_wins(by_seq(batch), by_seq(known))


def test_salted_join_equals_join(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k long, w string")
    for how in ("inner", "left"):
        plain = sorted(map(str, many.join(few, "k", how).select("k", "v", "w").collect()))
        assert sorted(map(str, salted_join(many, few, "k", "v", min_rows=10, how=how).select("k", "v", "w").collect())) == plain


def test_ordered_columns_do_not_depend_on_buckets(spark):
    rng = random.Random(5)
    rows = [(i % 3, i // 7, i, rng.choice([None, i]), rng.randrange(9)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, b long, o long, x int, y int")
    whole = df.withColumn("b", F.lit(0))
    pick = lambda d: sorted(map(str, d.drop("b").collect()))
    assert pick(with_previous(df, "k", "b", ["o"], ["x"])) == pick(with_previous(whole, "k", "b", ["o"], ["x"]))
    assert pick(running_merge(df, "k", "b", ["o"], ["x"], [], ["y"])) == pick(running_merge(whole, "k", "b", ["o"], ["x"], [], ["y"]))


FACT = ("id string, position long, title string, incident_date date, country string, country_code string, operator string, company string, asset string, installation string, field string, well_name string, incident_type string")


def facts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        land = rng.choice([("Norway", "NO"), ("Brazil", "BR"), (None, None)])
        day = None if rng.random() < 0.1 else date(2026, 3, 1) + timedelta(days=rng.randrange(20))
        rows.append((f"r{i:03d}", i, rng.choice(["fire at rig", "gas leak at rig north", "spill near coast"]), day, *land, rng.choice([None, "Kappa AS", "Kappa Energy", "Lambda"]), rng.choice([None, "Mu"]),
                     rng.choice([None, "Unit 1", "Unit 2"]), rng.choice([None, "Unit 1"]), None, rng.choice([None, "W-1"]), rng.choice(["fire", "gas_leak", None])))
    return rows


def all_scores(spark, df):
    """Every ordered pair scored, with the fetch rule applied in Python."""
    f = linkage.matching_facts(df, "id", "position")
    scored = linkage.tie_break(linkage.score_pairs(f.select(F.col("f").alias("a")).crossJoin(f.select(F.col("f").alias("b")))))
    out = {}
    for r in scored.select("a.key", "a.day", "a.code", F.col("b.key").alias("k2"), F.col("b.day").alias("d2"), F.col("b.code").alias("c2"), F.col("b.position").alias("p2"), "score", "decision", "accepted").collect():
        anchor = r.day or date(2026, 3, 10)
        near = r.d2 is None or abs((r.d2 - anchor).days) <= 8
        if near and (r.code is None or r.c2 is None or r.code == r.c2) and not (r.decision == "different" and r.score == 0):
            out.setdefault(r.key, []).append((-r.score, r.p2, r.k2, r.accepted))
    return out


def test_best_match_is_the_argmax(spark):
    df = spark.createDataFrame(facts(60, 7), FACT)
    scores = all_scores(spark, df)
    new, old = df.filter("position >= 30"), df.filter("position < 30")
    got = {r.candidate: (r.incident, r.accepted) for r in linkage.link_to_incidents(new, old, date(2026, 3, 10)).collect()}
    want = {}
    for r in new.collect():
        options = sorted(x for x in scores.get(r.id, []) if x[1] < 30)
        if options:
            want[r.id] = (options[0][2], options[0][3])
    assert got == want


@pytest.mark.parametrize("seed, first", [(11, 4096), (12, 4)])
def test_batch_groups_are_the_sequential_rule(spark, seed, first):
    df = spark.createDataFrame(facts(60, seed), FACT)
    scores = all_scores(spark, df)
    leaders, want = set(), {}
    for r in df.orderBy("position").collect():
        options = sorted(x for x in scores.get(r.id, []) if x[2] in leaders and x[1] < r.position)
        want[r.id] = options[0][2] if options and options[0][3] else r.id
        if want[r.id] == r.id:
            leaders.add(r.id)
    got = {r.candidate: r.leader for r in linkage.group_batch(df, date(2026, 3, 10), first=first).collect()}
    assert got == want and 1 < len(leaders) < 60


def test_feeds(spark):
    rss = ("<rss><item><title><![CDATA[Fire &amp; smoke]]></title><link>https://a.example.com/1?x=1&amp;y=2</link><description>&lt;p&gt;Two  men&#8217;s &amp;amp; more&lt;/p&gt;</description>"
           "<pubDate>Mon, 02 Mar 2026 10:15:00 GMT</pubDate><dc:creator>Kim</dc:creator></item><item><title>no link</title></item></rss>")
    atom = '<feed><entry><title>Leak</title><link rel="alternate" href="https://b.example.com/2"/><summary>s</summary><updated>2026-03-02T12:00:00+02:00</updated><id>x</id></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom), ("j", "junk <item>"), ("d", rss.replace("Mon, 02 Mar 2026 10:15:00 GMT", "yesterday"))], "feed string, xml string")
    rows = {r.feed: r for r in feeds.explode_feeds(df, "feed", "xml").collect()}
    assert set(rows) == {"r", "a", "d"}
    assert rows["r"].title == "Fire & smoke" and rows["r"].link == "https://a.example.com/1?x=1&y=2" and rows["r"].description == "Two men’s & more"
    assert rows["r"].published_at == datetime(2026, 3, 2, 10, 15) and rows["r"].author == "Kim"
    assert rows["a"].link == "https://b.example.com/2" and rows["a"].published_at == datetime(2026, 3, 2, 10)
    assert rows["d"].published_at is None
    known = spark.createDataFrame([("r", "Paper R", "en", 2), ("a", "Paper A", "no", 1)], "feed string, name string, language string, tier int")
    assert {r.publisher: r.source_tier for r in feeds.feed_articles(feeds.explode_feeds(df, "feed", "xml"), known).collect()} == {"Paper R": 2, "Paper A": 1}


def test_aggregator_titles_and_catalogue(spark):
    items = spark.createDataFrame([("Rig fire - The Coast", "https://agg.example.com/r?url=https%3A%2F%2Fwww.bsee.gov%2Fnews", "The Coast", None, None, None, "en")],
                                  "title string, link string, source string, description string, author string, published_at timestamp_ntz, language string")
    row = search_api.aggregator_articles(items).first()
    assert (row.title, row.url, row.publisher) == ("Rig fire", "https://www.bsee.gov/news", "The Coast")
    urls = ["https://www.bsee.gov/a", "https://sub.energyvoice.com/a", "https://x.gov.uk/a", "https://press.hse.gov.uk/a", "https://unknown.example.com/a", "nonsense"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    sites = catalogue.sites_by_host(catalogue.default_catalogue(spark).withColumn("position", F.monotonically_increasing_id()))
    got = {r.id: (r.source_tier, r.is_dedicated) for r in catalogue.with_source(df, sites).collect()}
    assert got == {0: (1, True), 1: (3, True), 2: (1, False), 3: (1, True), 4: (5, False), 5: (5, False)}


def test_model_responses(spark):
    good = {"isOilAndGasRelated": True, "oilAndGasSector": "upstream", "confidence": 0.7, "title": "T {x}", "summary": "S", "country": "Unknown", "wellType": "teleport", "injuries": 0}
    raw = {"bare": json.dumps(good), "fenced": "Sure:\n```json\n" + json.dumps(good) + "\n```", "comma": json.dumps(good)[:-1] + ",}", "open": json.dumps(good)[:-1], "none": "no idea",
           "enum": json.dumps({**good, "oilAndGasSector": "sideways"})}
    done = responses.ingest_responses(spark.createDataFrame(list(raw.items()), "id string, raw string"), "id")
    rows = {r.id: r for r in responses.accepted(done).collect()}
    assert set(rows) == {"bare", "fenced", "comma"}
    assert rows["bare"].title == "T {x}" and rows["bare"].country is None and rows["bare"].wellType is None and rows["bare"].injuries == 0 and rows["bare"].fatalities is None
    assert {r.id: r.violations for r in responses.rejected(done, "id").collect()}["enum"] == ["oilAndGasSector"]


def test_raw_files_and_quarantine(spark, tmp_path):
    ok = {"provider": "p", "publisher": "q", "title": "t", "url": "https://a.example.com", "source_tier": 3, "language": "en"}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in (ok, {**ok, "url": "ftp://x"}, {**ok, "title": "", "source_tier": 9})) + "\n{broken\n")
    good, bad = scan_raw_articles(spark, str(tmp_path))
    assert good.count() == 1
    assert sorted(tuple(r.violations) for r in bad.collect()) == [("broken_line",), ("title", "source_tier"), ("url",)]
    assert split_valid(good, raw_article_checks())[1].isEmpty()
    lines = "\n".join(json.dumps({**ok, "provider": f"p{i}", "title": f"t {i * 7919 % 1000003}"}) for i in range(3000)).encode()
    whole = gzip.compress(lines)
    (tmp_path / "whole 1.json.gz").write_bytes(whole + gzip.compress(b"\n"))
    (tmp_path / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.json.gz").write_bytes(b"no gzip at all")
    (tmp_path / "empty.json").write_bytes(b"")
    ledger = {r.path.rpartition("/")[2].replace("%20", " "): (r.status, r.rows, r.broken) for r in file_ledger(spark, str(tmp_path)).collect()}
    assert ledger["a.json"] == ("read", 3, 1) and "empty.json" not in ledger and ledger["none.json.gz"] == ("unreadable", 0, 0)
    assert ledger["whole 1.json.gz"][:2] == ("read", 3000) and ledger["cut.json.gz"][0] in ("damaged", "unreadable") and len(ledger) == 4
    kinds = [(r.kind, r.text) for r in quarantine(spark, str(tmp_path)).collect()]
    assert sorted(k for k, _ in kinds) == ["file", "file", "line", "record", "record"] and ("line", "{broken") in kinds


def test_late_rows_correct_the_counts(spark, tmp_path):
    days = [("a", datetime(2026, 3, d, 8)) for d in (1, 1, 2, 9)] + [("a", datetime(2026, 3, 20))], [("a", datetime(2026, 3, 1, 23)), ("b", datetime(2026, 3, 19)), ("b", None)]
    for rows in days:
        spark.createDataFrame(rows, "kind string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.read_increments(spark, f"{tmp_path}/in", StructType.fromDDL("kind string, at timestamp"), files_per_batch=1)
    ingest.count_days(stream, "at", ["kind"], f"{tmp_path}/out", f"{tmp_path}/cp", late="2 days")
    got = {(str(r.day), r.kind): (r["count"], r.corrections) for r in ingest.counted_days(spark, f"{tmp_path}/out", ["kind"]).collect()}
    assert got == {("2026-03-01", "a"): (3, 1), ("2026-03-02", "a"): (1, 0), ("2026-03-09", "a"): (1, 0), ("2026-03-20", "a"): (1, 0), ("2026-03-19", "b"): (1, 0), ("None", "b"): (1, 0)}


def test_store_and_snapshots(spark, tmp_path):
    stored = spark.createDataFrame([("u1", 1, None), ("u2", 2, 5)], "normalized_url string, id int, relevance_score int")
    incoming = spark.createDataFrame([("u1", 7, 50), ("u3", 8, None), ("u3", 9, 1)], "normalized_url string, id int, relevance_score int")
    merged = store.upsert_articles(stored, incoming, ["id"])
    assert {r.normalized_url: (r.id, r.relevance_score) for r in merged.collect()} == {"u1": (1, 50), "u2": (2, 5), "u3": (8, None)}
    assert sorted(map(str, store.upsert_articles(merged, incoming, ["id"]).collect())) == sorted(map(str, store.upsert_articles(store.upsert_articles(merged, incoming, ["id"]), incoming, ["id"]).collect()))
    root = str(tmp_path)
    assert store.read_snapshot(spark, root, "t") is None
    assert store.write_snapshot(stored, root, "t") == 1 and store.write_snapshot(merged, root, "t") == 2
    assert store.read_snapshot(spark, root, "t").count() == 3 and store.read_snapshot(spark, root, "t", before=2).count() == 2
    history = spark.createDataFrame([(None, 1, "f")], "user_id int, incident_id int, fingerprint string")
    assert store.append_history(history, history, ["user_id", "incident_id", "fingerprint"]).isEmpty()


def test_alert_novelty_for_anonymous_devices(spark):
    pairs = spark.createDataFrame([(None, 1, "f"), (2, 1, "f"), (None, 1, "g")], "user_id long, incident_id long, fingerprint string")
    history = spark.createDataFrame([(None, 1, "f")], "user_id long, incident_id long, fingerprint string")
    assert sorted(map(str, alerts.novel(pairs, history).collect())) == sorted(map(str, [pairs.collect()[1], pairs.collect()[2]]))


def test_audience_join_sides_agree(spark, small, monkeypatch):
    inc = view(spark, small, "v_incident").withColumnRenamed("id", "incident_id").filter("incident_id < 200")
    from workload.link_queries import _preferences
    people = alerts.audience(view(spark, small, "v_device"), _preferences(spark, small))
    want = alerts.match_audience(inc, people).select("incident_id", "token").collect()
    monkeypatch.setattr(alerts, "BROADCAST_LIMIT", -1)
    got = alerts.match_audience(inc, people).select("incident_id", "token").collect()
    assert sorted(got) == sorted(want) and want


def test_budget_and_erasure(spark):
    rows = spark.createDataFrame([(i, i % 4, 1) for i in range(10)], "id int, score int, source_tier int")
    best, rest = runs.within_budget(rows, 3)
    assert [r.id for r in best.collect()] == [3, 7, 2] and rest.count() == 7
    tables = {"profile": spark.createDataFrame([(1, "p1"), (2, "p2")], "user_id int, pid string"), "words": spark.createDataFrame([("p1", "a"), ("p2", "b")], "pid string, w string"), "shared": spark.createDataFrame([("x",)], "v string")}
    left = users.erase_users(tables, spark.createDataFrame([(1,)], "user_id int"), {"words": ("profile", "pid")})
    assert [r.w for r in left["words"].collect()] == ["b"] and left["profile"].count() == 1 and left["shared"].count() == 1


@pytest.fixture(scope="module")
def scanned(spark, small):
    from factweave.session import materialise
    batch = materialise(view(spark, small, "v_bulletin"), "test-bulletins")
    config = ScanConfig(max_extractions=None)
    return batch, config, scan(batch, config, datetime(2001, 7, 31, 12))


def test_scan_funnel_adds_up(spark, scanned):
    batch, config, result = scanned
    row = funnel(result, "r").first()
    stages = {r.stage: r["count"] for r in result.stages.groupBy("stage").count().collect()}
    assert sum(stages.values()) == batch.count() == row.results_found
    assert row.potential == row.created + row.updated + stages.get("rejected_late", 0) + stages.get("deferred", 0)
    assert result.incidents.count() == row.created > 0
    assert result.links.filter("is_primary").count() == row.created


def test_second_scan_finds_nothing_new(spark, scanned):
    from factweave.session import materialise
    batch, config, first = scanned
    again = scan(batch.withColumn("seq", F.col("seq") + 1_000_000), config, datetime(2001, 7, 31, 12), stored_articles=materialise(first.articles.withColumn("id", F.col("seq")), "t"), stored_incidents=materialise(first.incidents, "t"), stored_links=materialise(first.links, "t"))
    stages = {r.stage: r["count"] for r in again.stages.groupBy("stage").count().collect()}
    # Articles of the first run that were stored come back as duplicates; none of them makes an incident again.
    stored = first.articles.select((F.col("seq") + 1_000_000).alias("seq"))
    assert again.links.join(stored, "seq", "left_semi").isEmpty()
    assert stages["duplicate"] >= first.articles.count()


def test_budget_defers(spark, scanned):
    batch, config, first = scanned
    some = scan(batch, replace(config, max_extractions=10), datetime(2001, 7, 31, 12))
    assert some.stages.filter("stage = 'deferred'").count() > 0
    assert some.links.count() <= 10


def test_distinct_stream_keeps_late_articles(spark, tmp_path):
    source, store, cp = (str(tmp_path / n) for n in ("in", "store", "cp"))
    rows = spark.createDataFrame([("https://a.example.com/1?utm_id=2", None, datetime(2026, 3, 1)), ("http://www.a.example.com/1", None, datetime(2026, 3, 2)),
                                  ("https://a.example.com/2", None, datetime(2025, 1, 1)), ("https://a.example.com/3", None, None)], "url string, canonical_url string, published_at timestamp")

    def run():
        ingest.distinct_articles(ingest.read_increments(spark, source, rows.schema), store, cp)
        return sorted(r.normalized_url for r in spark.read.parquet(f"{store}/distinct").collect())

    rows.filter("url like '%utm%'").write.parquet(source)
    assert len(run()) == 1
    rows.write.mode("append").parquet(source)
    assert run() == [f"https://a.example.com/{n}" for n in (1, 2, 3)]


def test_update_counts_all_articles_and_keeps_status(spark, small, tmp_path):
    """A later report of a weak source leaves tier, official flag and status of an official one; then a worse report moves it."""
    from factweave.operators.store import read_current
    from factweave.plans.scan import alert_rows
    from factweave.session import materialise
    now = datetime(2001, 7, 31, 12)
    day = datetime(2001, 7, 25, 8)
    title = "Explosion at offshore platform in Norway injures workers"
    said = "An explosion and fire at the Troll platform in Norway on 25 July 2001 injured two workers, operator Equinor said."
    rows = [(1, title, said, "Regulator", 1, "https://a.example.com/x", None, day),
            (2, "Explosion on offshore platform in Norway: workers hurt", said.replace("said", "reported"), "Blog", 5, "https://b.example.com/y", None, day),
            (3, "Explosion at offshore platform in Norway leaves workers dead", "On 25 July 2001 an explosion at the Troll platform in Norway left 3 workers dead, operator Equinor said.", "Paper", 3, "https://c.example.com/z", None, day)]
    names = ["seq", "title", "excerpt", "publisher", "source_tier", "url", "canonical_url", "published_at"]
    shape = StructType([StructField(f.name, f.dataType) for f in view(spark, small, "v_bulletin").schema])
    make = lambda row: spark.createDataFrame([tuple(dict(zip(names, row), language="en").get(f.name) for f in shape)], shape)
    config = ScanConfig(max_extractions=None)
    first = scan(make(rows[0]), config, now)
    one = first.incidents.first()
    assert (one.source_count, one.highest_source_tier, one.has_official_source) == (1, 1, True)
    assert {r.kind for r in alert_rows(first, "r1").collect()} == {"new_incident"}
    inc, links, arts = materialise(first.incidents, "t"), materialise(first.links, "t"), materialise(first.articles, "t")
    second = scan(make(rows[1]), config, now, stored_articles=arts, stored_incidents=inc, stored_links=links)
    two = second.incidents.first()
    assert (two.incident_id, two.source_count, two.highest_source_tier, two.has_official_source, two.status, two.title) == (1, 2, 1, True, one.status, one.title)
    assert not second.links.first().is_primary and two.confidence_score >= one.confidence_score
    assert second.changes.filter("is_material").isEmpty() and alert_rows(second, "r2").isEmpty()
    inc, links = materialise(second.incidents, "t"), materialise(links.unionByName(second.links), "t")
    third = scan(make(rows[2]), config, now, stored_articles=arts.unionByName(second.articles), stored_incidents=inc, stored_links=links, stored_changes=second.changes)
    three = third.incidents.first()
    assert (three.source_count, three.status, three.fatalities) == (3, "updated", 3)
    assert "fatalities_confirmed" in third.changes.first().changes
    assert [r.kind for r in alert_rows(third, "r3").collect()] == ["material_update"]
    # The first and the third as a stream of two files.
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for row in (rows[0], rows[2]):
        make(row).write.mode("append").parquet(source)
        ingest.scan_batches(ingest.read_increments(spark, source, shape), store, str(tmp_path / "cp"), config, now)
    last = read_current(spark, store, "incidents", "incident_id").collect()
    assert [(r.incident_id, r.source_count, r.status, r.highest_source_tier, r.fatalities) for r in last] == [(1, 2, "updated", 1, 3)]



def test_feed_page_has_cards_11_to_50(spark, small, monkeypatch):
    from workload import feed_queries

    one = feed_queries.incidents(spark, small).limit(1).drop("id").withColumns({
        "incident_date": F.lit("2001-07-30").cast("date"), "severity": F.lit("high"), "environment": F.lit("subsea"), "severity_score": F.lit(5)})
    many = one.crossJoin(spark.range(60))
    monkeypatch.setattr(feed_queries, "incidents", lambda *_: many)
    assert [r["id"] for r in feed_queries.feed_page(spark, small).collect()] == list(range(10, 50))



def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from workload import scan_queries

    pages = [(i, f"https://Host{i % 7}.example.com/p?b=2&utm_source=x", "<p></p>") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert scan_queries.stream_distinct_pages(spark, str(tmp_path)).count() == 7
    events = [("view", datetime(2024, 1, 1 + i % 3)) for i in range(9)]
    spark.createDataFrame(events, "event_type string, ts timestamp_ntz").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert [r["count"] for r in scan_queries.stream_daily_counts(spark, str(tmp_path)).collect()] == [3, 3, 3]



def test_costly_rows_are_spread_whatever_the_splits(spark, tmp_path, monkeypatch):
    from factweave import session

    spark.range(50_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    monkeypatch.setattr(session, "SPREAD_BYTES_PER_CORE", 1 << 13)
    rows = session.spread(spark.read.parquet(f"{tmp_path}/one"))
    assert rows.count() == 50_000 and rows.rdd.getNumPartitions() > 8


def test_fan_out_writes_no_pairs(spark, small, monkeypatch):
    """The same messages whether notified users travel with an alert or are joined; no table of pairs is written."""
    from workload.link_queries import _alert_rows, _history, _preferences

    written, write = [], alerts.materialise
    monkeypatch.setattr(alerts, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    rows, devices, history = _alert_rows(spark, small).filter("incident_id < 600"), view(spark, small, "v_device"), _history(spark, small)

    def messages():
        return sorted(map(str, alerts.fan_out(rows, devices, _preferences(spark, small), history, ["seq"]).collect()))

    want = messages()
    assert want and not any({"token", "incident_id"} <= set(df.columns) for df in written)
    monkeypatch.setattr(alerts, "SEEN_USERS", 0)
    assert messages() == want


def test_repeated_sources_are_found_where_they_are_numbered(spark, tmp_path):
    """Repeats count once, rows that differ in the excerpt alone do not; no row is dealt out for that by all of its columns."""
    from factweave.operators import dossier, provenance

    rows = [(i % 3, f"a{i % 4}", f"p{i % 2}", i % 2 + 1, None if i % 5 == 0 else datetime(2024, 1, 1 + i % 3), "t", None if i % 7 == 0 else f"x{i % 6}", f"u{i}") for i in range(40)]
    path = str(tmp_path / "articles")
    spark.createDataFrame([*rows, *rows[:25], (None, "a", "p", 1, None, "t", "x", "u")],
                          "incident_id long, article_id string, publisher string, source_tier int, published_at timestamp, title string, excerpt string, url string").write.parquet(path)
    articles = spark.read.parquet(path)
    best = lambda df, **more: provenance.best_sources(df, "incident_id", ["article_id"], 5, **more)
    # The order of sources that tie in tier, time and id is open, so titles and places of the numbering are compared.
    numbered = lambda df: sorted((r["incident_id"], r["number"], r["article_id"], r["published"], r["tier"]) for r in df.collect())
    assert numbered(dossier.source_rows(articles, "incident_id", distinct=True)) == numbered(dossier.source_rows(articles.distinct(), "incident_id"))
    assert sorted(map(str, best(articles, distinct=True).collect())) == sorted(map(str, best(articles.distinct()).collect()))
    for df in (dossier.source_rows(articles, "incident_id", distinct=True), best(articles, distinct=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "url" in line]


def test_dossier_texts_are_computed_once(spark):
    """A field's text stands once in the plan; empty, unknown and missing values are told apart by the kind of field."""
    from factweave.operators import dossier

    schema = "id long, incident_date date, incident_time string, country string, operator string, incident_type string, well_type string, fatalities int, fire boolean, hydrocarbon_release boolean, city string, region string, severity string, severity_score int, highest_source_tier int"
    df = spark.createDataFrame([(1, date(2024, 1, 5), "unknown", "unknown", "", "gas_leak", None, 0, True, False, "", "North", "high", 70, 2),
                                (2, None, "", None, "Vega", "unknown", "", None, None, None, None, None, "low", None, None)], schema)
    rows = {(r["id"], r["label"]): (r["section"], r["position"], r["value"], r["known"]) for r in dossier.field_rows(df).collect()}
    assert rows[1, "Incident Date"] == ("overview", 1, "05 Jan 2024", True) and rows[2, "Incident Date"] == ("overview", 1, "Date not reported", True)
    assert (1, "Incident Time") not in rows and (2, "Incident Time") not in rows and rows[1, "Country"] == ("overview", 4, "Not reported", False)
    assert rows[1, "Operator"][2:] == ("Not reported", False) and rows[2, "Operator"][2:] == ("Vega", True)
    assert rows[2, "Incident Type"][2:] == ("Unknown", True) and rows[2, "Well Type"][2:] == ("Not reported", True) and (1, "Well Type") not in rows
    assert rows[1, "Fatalities"] == ("consequences", 27, "0", True) and rows[2, "Fatalities"][2:] == ("Not reported", False)
    assert rows[1, "Hydrocarbon Release"][2:] == ("No", True) and rows[1, "Location"][2:] == ("North", True) and (2, "Location") not in rows
    assert rows[1, "Severity"][2].startswith("High (70/100)") and rows[2, "Severity"][3] is False and rows[2, "Relevance Score"][3] is False
    assert dossier.field_rows(df, only_known=False).count() == 2 * sum(len(group) for _, group in dossier.SECTIONS)
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = dossier.field_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("date_format(") == 1 and plan.count("split(incident_type") == 1


def test_entity_names_are_normalised_only_where_asked_for(spark, small, monkeypatch):
    """Entities read without their normalised names cost no normalisation; the incident detail finds repeated evidence and numbers sources once."""
    from factweave.operators import provenance
    from workload import feed_queries

    names = [column for _, column, _ in provenance.ENTITY_COLUMNS]
    df = spark.createDataFrame([(1, "Vega Oil, Inc.", "Unit-7", " "), (2, None, None, "MV 3")], "id long, operator string, asset string, vessel string")
    df = df.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n not in df.columns])
    rows = provenance.entity_rows(df, ["id"])
    assert sorted(map(tuple, rows.collect())) == [(1, "asset", "Unit-7", "unit 7"), (1, "operator", "Vega Oil, Inc.", "vega oil"), (2, "vessel", "MV 3", "mv 3")]
    plan = rows.select("id", "entity_type", "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "lower(" not in plan

    written = []
    once = lambda df, name: (written.append(name), df.localCheckpoint())[1]
    monkeypatch.setattr(feed_queries, "materialise", once, raising=False)
    detail = feed_queries.incident_detail(spark, small)
    assert written == ["evidence", "numbered-sources"]
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "url" in line]


def test_candidate_classes_hold_the_same_pairs(spark):
    """Classes stand for all pairs, with dates or countries missing on either side, and copies of records add members, not pairs."""
    df = spark.createDataFrame(facts(80, 5), FACT)
    copies = df.unionByName(df.withColumn("id", F.concat("id", F.lit("b"))))
    at, seen = F.lit(date(2026, 3, 10)), []
    for rows in (df, copies):
        new, old = (linkage.stored_facts(rows.filter(f"position % 2 = {i}"), "id", "position") for i in (0, 1))
        pairs, lefts, rights = linkage.candidate_classes(new, old, at)
        want = sorted(tuple(r) for r in linkage.candidate_pairs(new, old, at).select("a.key", F.col("b.key").alias("k")).collect())
        got = pairs.join(lefts, "a_class").join(rights, "b_class").select("a.key", F.col("b.key").alias("k"))
        assert sorted(tuple(r) for r in got.collect()) == want and want
        seen.append((pairs.count(), len(want)))
    assert seen[1] == (seen[0][0], 4 * seen[0][1])


def order_tables(spark, path, orders, customers=((1, "Alpha", 0, "BUILDING"),)):
    """The tables of `v_incident`: orders as (key, customer, status, date, priority), customers as (key, name, nation, segment); two nations."""
    spark.createDataFrame([(k, c, status, 1000.0, day, priority) for k, c, status, day, priority in orders],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, name, nation, 1.0, segment) for k, name, nation, segment in customers],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(0, "NATION_0", 0), (1, "NATION_1", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{path}/nation.parquet")
    spark.createDataFrame([(0, "REGION")], "r_regionkey int, r_name string").write.parquet(f"{path}/region.parquet")
    return str(path)


def same_as_sql(spark, path, name, tables=("orders", "customer", "nation", "region")):
    import duckdb

    import __spark_entry__ as entry
    from tools.check import norm

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df, rel = entry.queries()[name](spark, path), con.sql(entry.oracle_sql()[name])
    rows = df.collect()
    assert Counter(tuple(norm(r[c]) for c in rel.columns) for r in rows) == Counter(tuple(map(norm, r)) for r in rel.fetchall())
    return rows


def test_alerts_of_all_runs(spark, tmp_path):
    """Messages of old and of undated runs too (key 23 has no date), not of the last months only."""
    days = [datetime(1995, 3, 1), datetime(2001, 7, 1), datetime(1998, 1, 1)]
    path = order_tables(spark, tmp_path, [(k, 1, "F", days[i], "1-URGENT") for i, k in enumerate((5, 7, 23))])
    assert {r["run_id"] for r in same_as_sql(spark, path, "alert_messages")} == {"1995-03-01", "2001-07-01", "undated"}


def test_incidents_meet_the_next_one_in_their_country(spark, tmp_path):
    """Next by id in the country, however far the ids are apart; incidents without a country (29, 58) are a group of their own."""
    customers = [(1, "Alpha", 0, "BUILDING"), (2, "Beta", 1, "BUILDING")]
    day = datetime(2000, 1, 1)
    path = order_tables(spark, tmp_path, [(k, c, "F", day, "1-URGENT") for k, c in [(1, 1), (2, 2), (3, 1), (26, 2), (29, 1), (58, 2), (900, 1), (900, 1), (10**12, 2), (10**12 + 1, 1)]], customers)
    rows = same_as_sql(spark, path, "text_similarity")
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 26, 29, 900, 900]
    assert [r["trigram"] for r in rows if r["id"] == 900].count(1.0) == 1


def _alert_case(spark):
    """Alerts of three incidents, 40 devices of three kinds of preferences (some without a user, one user with two), and a history."""
    kinds = [("new_incident", 0), ("material_update", 1)]
    rows = [(f"day {i % 2}", i, kind, f"f{i}{kind}", s, f"Incident {i}", None, "N" if i % 2 else None, "fire", "onshore", None, "new", 90, [], seq)
            for i, s in enumerate(["low", "high", "critical"]) for kind, seq in kinds for _ in range(2)]
    rows = spark.createDataFrame(rows, "run_id string, incident_id long, kind string, fingerprint string, severity string, title string, summary string, country string, incident_type string, environment string, "
                                       "is_well_integrity_related boolean, status string, confidence_score int, descriptions array<string>, seq int")
    devices = spark.createDataFrame([(None if i % 10 == 0 else i % 33, f"t{i}", True) for i in range(40)], "user_id long, token string, active boolean")
    prefs = spark.createDataFrame([(u, True, u % 2 == 0, False, "high" if u % 3 else "low", [], [], ["n"] if u % 3 == 2 else [], True, True) for u in range(25)],
                                  "user_id long, enabled boolean, sound boolean, critical_only boolean, min_severity string, severities array<string>, incident_types array<string>, countries array<string>, well_integrity_alerts boolean, well_control_alerts boolean")
    history = spark.createDataFrame([(None, 1, "f1new_incident"), (3, 2, "f2new_incident"), *[(u, 0, "f0new_incident") for u in [None, *range(40)]]], "user_id long, incident_id long, fingerprint string")
    return rows, devices, prefs, history


def test_deliveries_are_found_where_their_pairs_are_made(spark, monkeypatch):
    """Devices of equal preferences are compared at once; repeated deliveries need no shuffle of the pairs; same rows as by plain loops."""
    import re

    rows, devices, prefs, history = _alert_case(spark)
    by_user = {p["user_id"]: p for p in prefs.collect()}
    told = {tuple(h) for h in history.collect()}
    ranks = ["low", "moderate", "high", "critical"]

    def wants(d, r):
        p = by_user.get(d["user_id"])
        if (d["user_id"], r["incident_id"], r["fingerprint"]) in told:
            return False
        least, countries = (p["min_severity"], p["countries"]) if p else ("moderate", [])
        return ranks.index(r["severity"]) >= ranks.index(least) and (not countries or (r["country"] or "").lower() in countries)

    alerted, people = rows.collect(), devices.collect()
    first = {}
    for r in sorted(alerted, key=lambda r: r["seq"]):
        if any(wants(d, r) for d in people):
            first.setdefault((r["run_id"], r["incident_id"]), r["seq"])
    want = Counter((r["incident_id"], r["kind"], d["token"], d["user_id"]) for r in alerted for d in people if first.get((r["run_id"], r["incident_id"])) == r["seq"] and wants(d, r))
    assert {k for _, k, _, _ in want} == {"new_incident", "material_update"}
    for per_row, seen in ((1_024, 64), (2, 64), (1_024, 0)):
        monkeypatch.setattr(alerts, "DEVICES_PER_ROW", per_row)
        monkeypatch.setattr(alerts, "SEEN_USERS", seen)
        messages = alerts.fan_out(rows, devices, prefs, history, ["seq"])
        assert Counter((m["incident_id"], m["kind"], m["token"], m["user_id"]) for m in messages.collect()) == want
        added = alerts.deliveries_to_history(messages, history).groupBy("user_id").agg(F.count(F.lit(1)).alias("added"))
        assert {r["user_id"]: r["added"] for r in added.collect()} == Counter(u for u, _, _ in {(u, i, k) for i, k, _, u in want})
        if seen:
            dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", added._jdf.queryExecution().executedPlan().toString())
            assert not any("user_id" in keys and "incident_id" in keys for keys in dealt)


def test_audience_is_broadcast_by_its_size_in_memory(spark, monkeypatch):
    """Devices that take few bytes in a file, as their tokens are alike, are not sent to all tasks through the driver when they are many."""
    rows, _, prefs, _ = _alert_case(spark)
    people = alerts.audience(spark.range(20_000).selectExpr("CAST(NULL AS bigint) AS user_id", "'token' AS token", "true AS active"), prefs)
    monkeypatch.setattr(alerts, "BROADCAST_LIMIT", 20_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = alerts.match_audience(rows, people)
        assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == 8 * 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
