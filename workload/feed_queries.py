"""Feed, search and dashboard over `v_incident`, sources over `v_evidence`."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.config import IncidentFilters
from factweave.functions.time import effective_date, effective_date_is_estimate, in_window, resolve_window
from factweave.operators import dashboard, dossier, feed, provenance, scoring
from factweave.operators.skew import keep_last
from factweave.operators.users import latest_states, rows_of
from factweave.plans import pages as page_plans
from factweave.session import materialise
from factweave.taxonomy import SEVERITIES, label, severity_rank
from workload.sqlparts import fold, label as sql_label, quote, sql_array, sql_list, truncate as sql_truncate
from workload.views import NOW, TODAY, view, with_sql

NOW_DT = datetime.fromisoformat(NOW)
TODAY_D = date.fromisoformat(TODAY)
D30, D7 = f"(DATE '{TODAY}' - 30)", f"(DATE '{TODAY}' - 7)"
SECONDARY = "list_filter(string_split(secondary_types, ','), lambda t: t <> '')"


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the types array, leading publication, and source counters."""
    base = view(spark, sf_dir, "v_incident").withColumn(
        "secondary_incident_types", F.filter(F.split("secondary_types", ","), lambda t: t != ""))
    evidence = view(spark, sf_dir, "v_evidence")
    lead = feed.leading_publication(evidence, "incident_id").withColumnRenamed("incident_id", "id")
    counters = scoring.source_inputs(evidence, "incident_id").withColumnRenamed("incident_id", "id")
    return base.join(lead, "id", "left").join(counters, "id", "left").withColumns({
        "source_count": F.coalesce("source_count", F.lit(0)), "highest_source_tier": F.coalesce("highest_source_tier", F.lit(5))})


_INCIDENTS_SQL = """, lead AS (SELECT incident_id, arg_min_null(published_at, (source_tier, -epoch_us(coalesce(published_at, TIMESTAMP '1970-01-01')))) AS first_published_at
    FROM v_evidence GROUP BY incident_id),
  counters AS (SELECT incident_id, count(DISTINCT publisher) AS source_count, min(source_tier) AS best_tier FROM v_evidence GROUP BY incident_id),
  inc AS (SELECT v.*, l.first_published_at, coalesce(c.source_count, 0) AS source_count, coalesce(c.best_tier, 5) AS highest_source_tier
    FROM v_incident v LEFT JOIN lead l ON v.id = l.incident_id LEFT JOIN counters c ON v.id = c.incident_id)"""


def inc_sql(*more: str) -> str:
    return with_sql("v_incident", "v_evidence", *more) + _INCIDENTS_SQL


CARD_SQL = """id, title, summary, CAST(incident_date AS VARCHAR) AS incident_date, country, operator, asset, incident_type, environment, oil_gas_sector,
  severity, confidence, source_count, status, strftime(last_updated_at, '%Y-%m-%d %H:%M:%S') AS last_updated_at, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at,
  is_well_integrity_related, is_mock, relevance_score"""
RANK_SQL = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END"


def shown(cards: DataFrame) -> DataFrame:
    """Cards with dates as text."""
    return cards.withColumns({
        "incident_date": F.col("incident_date").cast("string"),
        "last_updated_at": F.date_format("last_updated_at", "yyyy-MM-dd HH:mm:ss"),
        "detected_at": F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss"),
    })


PAGE_FILTERS = IncidentFilters(period="last_30_days", severities=("critical", "high"), environments=("offshore", "onshore", "subsea"),
                               sort="severity_desc", limit=10, cursor=10)
FACET_FILTERS = IncidentFilters(period="all_time", sectors=("upstream", "midstream"), confidences=("medium", "high"),
                                countries=tuple(f"{'NATION' if i % 2 else 'Nation'}_{i}" for i in range(20)), operators=("customer#0000000", "#00000012"),
                                lifecycle_stages=("drilling", "production", "completion"), process_safety_only=True, min_relevance=20)


def feed_page(spark, sf):
    """Cards 11 to 50."""
    return shown(page_plans.feed_page(incidents(spark, sf), replace(PAGE_FILTERS, limit=40), NOW_DT))


FEED_WHERE = f"""coalesce(incident_date, CAST(first_published_at AS DATE)) BETWEEN {D30} AND DATE '{TODAY}'
  AND severity IN ('critical', 'high') AND environment IN ('offshore', 'onshore', 'subsea')"""
FEED_PAGE_SQL = inc_sql() + f""" SELECT {CARD_SQL} FROM inc WHERE {FEED_WHERE}
  ORDER BY {RANK_SQL} DESC, severity_score DESC, inc.incident_date DESC NULLS LAST, id LIMIT 40 OFFSET 10"""


def feed_page_totals(spark, sf):
    return page_plans.feed_totals(incidents(spark, sf), PAGE_FILTERS, NOW_DT)


FEED_TOTALS_SQL = inc_sql() + f""", t AS (SELECT count(*) AS total FROM inc WHERE {FEED_WHERE})
  SELECT total, CASE WHEN total > 10 AND least(total, 20) < total THEN least(total, 20) END AS next_cursor FROM t"""


def feed_orders(spark, sf):
    """First page of each of the four orders."""
    base = incidents(spark, sf)
    out = None
    for sort in ("incident_date_desc", "detected_at_desc", "severity_desc", "relevance_desc"):
        filters = IncidentFilters(period="last_14_days", sort=sort, limit=20)
        part = page_plans.feed_page(base, filters, NOW_DT).select(F.lit(sort).alias("sort"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def _order_sql(name, order):
    return f"""(SELECT '{name}' AS sort, id FROM inc WHERE coalesce(incident_date, CAST(first_published_at AS DATE)) BETWEEN DATE '{TODAY}' - 14 AND DATE '{TODAY}'
      ORDER BY {order}, id LIMIT 20)"""


FEED_ORDERS_SQL = inc_sql() + " SELECT * FROM " + _order_sql("incident_date_desc", "incident_date DESC NULLS LAST, last_updated_at DESC NULLS LAST") + \
    " UNION ALL SELECT * FROM " + _order_sql("detected_at_desc", "detected_at DESC NULLS LAST") + \
    " UNION ALL SELECT * FROM " + _order_sql("severity_desc", f"{RANK_SQL} DESC, severity_score DESC, incident_date DESC NULLS LAST") + \
    " UNION ALL SELECT * FROM " + _order_sql("relevance_desc", "relevance_score DESC")


def quick_filters(spark, sf):
    """How many incidents each named filter lets through, in one pass."""
    base = view(spark, sf, "v_incident").withColumn("secondary_incident_types", F.filter(F.split("secondary_types", ","), lambda t: t != ""))
    hits = F.array_compact(F.array(*[F.when(make(), F.lit(name)) for name, make in feed.FEED_FILTERS.items()]))
    return base.select(F.explode(hits).alias("feed_filter"), "severity").groupBy("feed_filter", "severity").agg(F.count(F.lit(1)).alias("n"))


_FILTER_SQL = {
    "all": "TRUE", "critical": "severity = 'critical'", "well_integrity": "is_well_integrity_related",
    "well_control": "incident_type IN ('well_control', 'blowout') OR well_integrity_category = 'well_control' OR well_control_event",
    "offshore": "environment IN ('offshore', 'subsea')", "drilling": "lifecycle_stage IN ('drilling', 'completion')",
    "production": "lifecycle_stage IN ('production', 'injection')",
    "pipeline": "installation_type = 'pipeline' OR incident_type IN ('pipeline_leak', 'pipeline_rupture')",
    "refinery": "installation_type = 'refinery'", "lng": "installation_type = 'lng_facility'",
    "fire": f"incident_type = 'fire' OR list_contains({SECONDARY}, 'fire')",
    "explosion": f"incident_type = 'explosion' OR list_contains({SECONDARY}, 'explosion')",
    "leak_release": "incident_type IN ('gas_leak', 'oil_leak', 'hydrocarbon_release', 'loss_of_containment', 'toxic_gas_release', 'pipeline_leak')",
    "spill": "incident_type = 'oil_spill' OR spill",
}
QUICK_FILTERS_SQL = with_sql("v_incident") + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS feed_filter, severity, count(*) AS n FROM v_incident WHERE {cond} GROUP BY severity" for name, cond in _FILTER_SQL.items())


def facet_filters(spark, sf):
    return feed.filter_incidents(incidents(spark, sf), FACET_FILTERS, NOW_DT).select("id", "country", "operator", "relevance_score")


FACET_SQL = inc_sql() + f""" SELECT id, country, operator, relevance_score FROM inc WHERE oil_gas_sector IN ('upstream', 'midstream') AND confidence IN ('medium', 'high')
  AND {fold("coalesce(country, '')")} IN ({", ".join(f"'nation_{i}'" for i in range(20))})
  AND (contains({fold("coalesce(operator, '')")}, 'customer#0000000') OR contains({fold("coalesce(operator, '')")}, '#00000012'))
  AND lifecycle_stage IN ('drilling', 'production', 'completion') AND is_process_safety_event AND relevance_score >= 20"""

SEARCH_TEXT = "pipeline Únit 3 nation_1"
FULL_TEXT = "unit 12"


def keyword_search(spark, sf):
    """AND-search over all incidents, whatever their date."""
    return page_plans.search(incidents(spark, sf), SEARCH_TEXT, NOW_DT).select("id", "title")


_HAYSTACK = fold("concat_ws(' ', title, summary, operator, company, asset, installation, field, well_name, country, region, city, incident_type)")
SEARCH_SQL = with_sql("v_incident") + f" SELECT id, title FROM v_incident WHERE " + " AND ".join(f"contains({_HAYSTACK}, '{w}')" for w in ("pipeline", "unit", "3", "nation_1"))


def full_text_search(spark, sf):
    """Whole-word prefilter and AND-search together."""
    return page_plans.search(incidents(spark, sf), FULL_TEXT, NOW_DT, prefilter=True).select("id", "title")


_DOC_WORDS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', title, operator, company, asset, installation, field, well_name, country, summary)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
FULL_TEXT_SQL = with_sql("v_incident") + f""" SELECT id, title FROM v_incident WHERE (list_has_all({_DOC_WORDS}, ['unit', '12']) OR contains(lower(title), 'unit 12'))
  AND contains({_HAYSTACK}, 'unit') AND contains({_HAYSTACK}, '12')"""


def effective_dates(spark, sf):
    """Incidents per axis and period inside the window, with how many dates are estimates."""
    base = incidents(spark, sf)
    rows = []
    for axis in ("incident_date", "published_at"):
        day = effective_date(F.col("incident_date"), F.col("first_published_at"), axis)
        estimate = effective_date_is_estimate(F.col("incident_date"), F.col("first_published_at"), axis)
        for period in ("today", "last_7_days", "last_14_days", "last_30_days", "all_time"):
            inside = in_window(day, resolve_window(NOW_DT, period))
            rows.append(F.when(inside, F.struct(F.lit(axis).alias("axis"), F.lit(period).alias("period"), estimate.alias("estimated"))))
    return base.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*").groupBy("axis", "period").agg(
        F.count(F.lit(1)).alias("inside"), F.count_if("estimated").alias("estimated"))


def _effective_sql():
    parts = []
    for axis in ("incident_date", "published_at"):
        pub = "CAST(first_published_at AS DATE)"
        day = pub if axis == "published_at" else f"coalesce(incident_date, {pub})"
        est = "FALSE" if axis == "published_at" else "incident_date IS NULL AND first_published_at IS NOT NULL"
        for period, days in (("today", 0), ("last_7_days", 7), ("last_14_days", 14), ("last_30_days", 30), ("all_time", None)):
            low = "" if days is None else f" AND {day} >= DATE '{TODAY}' - {days}"
            parts.append(f"SELECT '{axis}' AS axis, '{period}' AS period, count(*) AS inside, count(*) FILTER (WHERE {est}) AS estimated FROM inc WHERE {day} <= DATE '{TODAY}'{low} HAVING count(*) > 0")
    return inc_sql() + " " + " UNION ALL ".join(parts)


USER = 7
_STATES_SQL = ", states AS (SELECT user_id, incident_id, arg_max(state, (updated_at, event_id)) AS state FROM v_state GROUP BY user_id, incident_id)"


def current_states(spark, sf):
    return latest_states(view(spark, sf, "v_state"), ["updated_at", "event_id"])


def user_states(spark, sf):
    """Current state of every (user, incident): last write wins."""
    return current_states(spark, sf).select("user_id", "incident_id", "state")


USER_STATES_SQL = with_sql("v_state") + _STATES_SQL + " SELECT * FROM states"


def user_scope(spark, sf):
    return rows_of(current_states(spark, sf), USER).select("incident_id", "state")


USER_SCOPE_SQL = with_sql("v_state") + _STATES_SQL + f" SELECT incident_id, state FROM states WHERE user_id = {USER}"


def visibility(spark, sf):
    """One user's feed without what they archived, with the state of each incident."""
    joined = feed.with_user_state(incidents(spark, sf), current_states(spark, sf), USER)
    return feed.filter_incidents(joined, IncidentFilters(period="all_time"), NOW_DT).select("id", F.coalesce("user_state", F.lit("new")).alias("state"))


VISIBILITY_SQL = with_sql("v_incident", "v_state") + _STATES_SQL + f""" SELECT i.id, coalesce(s.state, 'new') AS state FROM v_incident i
  LEFT JOIN states s ON s.incident_id = i.id AND s.user_id = {USER} WHERE coalesce(s.state, 'new') <> 'archived'"""


def dashboard_kpis(spark, sf):
    return dashboard.kpis(view(spark, sf, "v_incident"), TODAY_D)


_KPI = f"incident_date BETWEEN {D30} AND DATE '{TODAY}'"
_WELL_CONTROL = "incident_type IN ('well_control', 'blowout') OR well_integrity_category = 'well_control'"
_CONTAINMENT = "incident_type = 'loss_of_containment' OR process_safety_category = 'loss_of_primary_containment' OR well_integrity_category = 'loss_of_containment'"
KPI_SELECT = f"""SELECT count(*) FILTER (WHERE incident_date = DATE '{TODAY}') AS incidents_today, count(*) FILTER (WHERE incident_date >= {D7}) AS incidents_last_7_days,
  count(*) AS incidents_last_30_days, count(*) FILTER (WHERE severity = 'critical') AS critical_incidents, count(*) FILTER (WHERE severity = 'high') AS high_severity_incidents,
  count(*) FILTER (WHERE environment IN ('offshore', 'subsea')) AS offshore_incidents, count(*) FILTER (WHERE environment = 'onshore') AS onshore_incidents,
  count(*) FILTER (WHERE is_well_integrity_related) AS well_integrity_incidents, count(*) FILTER (WHERE {_WELL_CONTROL}) AS well_control_incidents,
  count(*) FILTER (WHERE {_CONTAINMENT}) AS loss_of_containment_incidents, coalesce(bool_and(is_mock), FALSE) AS is_mock"""
KPI_SQL = with_sql("v_incident") + f" {KPI_SELECT} FROM v_incident WHERE {_KPI}"


def dashboard_for_user(spark, sf):
    """KPIs without the incidents one user archived."""
    return dashboard.kpis(dashboard.visible_to(view(spark, sf, "v_incident"), current_states(spark, sf), USER), TODAY_D)


KPI_USER_SQL = with_sql("v_incident", "v_state") + _STATES_SQL + f""" {KPI_SELECT} FROM v_incident WHERE {_KPI}
  AND NOT EXISTS (SELECT 1 FROM states s WHERE s.user_id = {USER} AND s.state = 'archived' AND s.incident_id = v_incident.id)"""


def dashboard_top_lists(spark, sf):
    return dashboard.top_lists(view(spark, sf, "v_incident"), TODAY_D)


def _top_sql():
    parts = []
    for name, column, k, labelled in dashboard.TOP_LISTS:
        text = sql_label("key") if labelled else "key"
        parts.append(f"""SELECT '{name}' AS dimension, rank, key, {text} AS label, count FROM (SELECT {column} AS key, count(*) AS count,
          row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank FROM v_incident WHERE {_KPI} AND {column} <> '' GROUP BY {column}) WHERE rank <= {k}""")
    return with_sql("v_incident") + " " + " UNION ALL ".join(parts)


def dashboard_severity(spark, sf):
    return dashboard.severity_buckets(view(spark, sf, "v_incident"), TODAY_D)


SEVERITY_SQL = with_sql("v_incident") + f""" SELECT d.position, d.key, {sql_label('d.key')} AS label, count(v.id) AS count FROM (VALUES (0, 'critical'), (1, 'high'), (2, 'moderate'), (3, 'low')) d(position, key)
  LEFT JOIN v_incident v ON v.severity = d.key AND v.{_KPI} GROUP BY d.position, d.key"""


def dashboard_trend(spark, sf):
    return dashboard.daily_trend(view(spark, sf, "v_incident"), TODAY_D).select(F.col("date").cast("string").alias("date"), "count")


TREND_SQL = with_sql("v_incident") + f""" SELECT CAST(CAST(d.day AS DATE) AS VARCHAR) AS date, count(v.id) AS count FROM generate_series(TIMESTAMP '{TODAY}' - INTERVAL 29 DAY, TIMESTAMP '{TODAY}', INTERVAL 1 DAY) d(day)
  LEFT JOIN v_incident v ON v.incident_date = CAST(d.day AS DATE) GROUP BY d.day"""


def evidence_counters(spark, sf):
    return scoring.source_inputs(view(spark, sf, "v_evidence"), "incident_id")


COUNTERS_SQL = with_sql("v_evidence") + """ SELECT incident_id, count(DISTINCT publisher) AS source_count, min(source_tier) AS highest_source_tier,
  count(*) FILTER (WHERE source_tier <= 2) AS strong_sources, min(source_tier) = 1 AS has_official_source FROM v_evidence GROUP BY incident_id"""


def leading_source(spark, sf):
    return feed.leading_publication(view(spark, sf, "v_evidence"), "incident_id").select("incident_id", F.col("first_published_at").cast("string").alias("first_published_at"))


LEADING_SQL = with_sql("v_evidence") + """ SELECT incident_id, strftime(arg_min_null(published_at, (source_tier, -epoch_us(coalesce(published_at, TIMESTAMP '1970-01-01')))), '%Y-%m-%d %H:%M:%S') AS first_published_at
  FROM v_evidence GROUP BY incident_id"""


def dossier_fields(spark, sf):
    """Report rows of every incident."""
    return dossier.field_rows(incidents(spark, sf))


def _dossier_sql():
    parts, position = [], 0
    for section, fields in dossier.SECTIONS:
        for name, column, kind, core in fields:
            position += 1
            names = column.split(",")
            c = names[0]
            value = {
                "date": f"coalesce(strftime({c}, '%d %b %Y'), 'Date not reported')",
                "instant": f"coalesce(strftime({c}, '%d %b %Y %H:%M UTC'), 'Not reported')",
                "comma": f"nullif(concat_ws(', ', {', '.join(f'nullif({n}, $$$$)' for n in names)}), '')".replace("$$$$", "''"),
                "space": f"nullif(concat_ws(' ', {', '.join(f'nullif({n}, $$$$)' for n in names)}), '')".replace("$$$$", "''"),
                "label": f"CASE WHEN {c} IS NOT NULL THEN {sql_label(c)} END",
                "flag": f"CASE WHEN {c} THEN 'Yes' WHEN NOT {c} THEN 'No' END",
                "scored": f"concat({sql_label(c)}, ' (', {names[-1]}, '/100)'" + (f", {quote(' — ' + dossier.SEVERITY_NOTE)})" if c == "severity" else ")"),
                "of100": f"concat({c}, '/100')",
                "count": f"CAST({c} AS VARCHAR)",
                "tier": "CASE highest_source_tier WHEN 1 THEN 'Tier 1 — Official regulator / government / operator statement' WHEN 2 THEN 'Tier 2 — Major international news organisation' WHEN 3 THEN 'Tier 3 — Recognised Oil & Gas publication' WHEN 4 THEN 'Tier 4 — Regional / local media' ELSE 'Tier 5 — Low-authority or unverified source' END",
                "text": f"nullif(nullif({c}, ''), 'unknown')",
            }[kind]
            keep = "" if core else f" WHERE {value} IS NOT NULL"
            parts.append(f"SELECT id, '{section}' AS section, {position} AS position, {quote(name)} AS label, coalesce({value}, 'Not reported') AS value, {value} IS NOT NULL AS known FROM inc{keep}")
    return inc_sql() + " " + " UNION ALL ".join(parts)


def dossier_sources(spark, sf):
    return dossier.source_rows(view(spark, sf, "v_evidence"), "incident_id", distinct=True)


DOSSIER_SOURCES_SQL = with_sql("v_evidence") + """, e AS (SELECT DISTINCT * FROM v_evidence) SELECT incident_id,
  row_number() OVER (PARTITION BY incident_id ORDER BY source_tier, coalesce(published_at, TIMESTAMP '1970-01-01') DESC, article_id) AS number, article_id, publisher, title,
  coalesce(strftime(published_at, '%d %b %Y'), 'Date not reported') AS published, url,
  CASE source_tier WHEN 1 THEN 'Tier 1 — Official regulator / government / operator statement' WHEN 2 THEN 'Tier 2 — Major international news organisation' WHEN 3 THEN 'Tier 3 — Recognised Oil & Gas publication' WHEN 4 THEN 'Tier 4 — Regional / local media' ELSE 'Tier 5 — Low-authority or unverified source' END AS tier FROM e"""

#: Sources that a narrative quotes by position; their number and the first excerpt come from all of them.
_BEST = 5


def _publishers(spark, sf):
    """First five distinct publishers per incident in source order, and how many there are."""
    from pyspark.sql import Window

    ranked = view(spark, sf, "v_evidence").groupBy("incident_id", "publisher").agg(
        F.min(F.struct("source_tier", (-F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))).alias("age"), "article_id")).alias("k"))
    w = Window.partitionBy("incident_id").orderBy("k")
    counts = ranked.groupBy("incident_id").agg(F.count(F.lit(1)).alias("publisher_count"))
    top = ranked.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "publisher"))), lambda s: s["publisher"]).alias("publishers"))
    return top.join(counts, "incident_id")


def assembled(spark, sf, evidence=None):
    """Incident with its leading sources, publishers and entities as arrays; `evidence` is its table without repeated rows, where that is at hand."""
    base = incidents(spark, sf).withColumnRenamed("id", "incident_id")
    sources = provenance.best_sources(view(spark, sf, "v_evidence") if evidence is None else evidence, "incident_id", ["article_id", "publisher", "excerpt"], _BEST, distinct=evidence is None)
    entities = provenance.child_arrays(provenance.entity_rows(base, ["incident_id"]), "incident_id", ["entity_type", "name"], "entities")
    return provenance.assemble(base, "incident_id", [sources, _publishers(spark, sf), entities])


def incident_detail(spark, sf):
    """The whole aggregate of every incident as rows: title, sources, publishers, entities, evidence, highlights, user states."""
    base = view(spark, sf, "v_incident").withColumnRenamed("id", "incident_id")
    # Both are read several times: repeated rows are found once, and sources are numbered once.
    evidence = materialise(view(spark, sf, "v_evidence").distinct(), "evidence")
    sources = dossier.source_rows(evidence, "incident_id").select("incident_id", "number", "article_id", "publisher")
    sources = materialise(sources, "numbered-sources")
    told = provenance.narrative(assembled(spark, sf, evidence).filter(F.col("publisher_count").isNotNull()))
    return provenance.detail_rows(base, "incident_id", sources, current_states(spark, sf), provenance.highlight_rows(told, ["incident_id"]))


_SOURCE_CTES = """, e AS (SELECT DISTINCT * FROM v_evidence), ranked AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY source_tier, coalesce(published_at, TIMESTAMP '1970-01-01') DESC, article_id) AS r FROM e),
  src AS (SELECT incident_id, list(excerpt ORDER BY r) AS excerpts, list(publisher ORDER BY r) AS pubs FROM ranked GROUP BY incident_id),
  pubfirst AS (SELECT incident_id, publisher, min(r) AS r FROM ranked GROUP BY incident_id, publisher),
  pubrank AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY r) AS pr, count(*) OVER (PARTITION BY incident_id) AS n FROM pubfirst),
  pub AS (SELECT incident_id, max(n) AS publisher_count, string_agg(publisher, ';' ORDER BY r) FILTER (WHERE pr <= 5) AS publishers FROM pubrank GROUP BY incident_id)"""


def _entities_sql(table: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{kind}' AS entity_type, {col} AS name FROM {table} WHERE trim({col}) <> ''" for kind, col, _ in provenance.ENTITY_COLUMNS)


def narrative(spark, sf):
    """Summary and highlights rebuilt from facts and sources, for incidents with sources."""
    out = provenance.narrative(assembled(spark, sf).filter(F.col("publisher_count").isNotNull()))
    return out.select("incident_id", "summary", F.array_join("highlights", "|").alias("highlights"))


def _narrative_sql():
    title = sql_truncate("v.title", 180)
    return with_sql("v_incident", "v_evidence") + _SOURCE_CTES + f""", n AS (SELECT v.*, s.excerpts, s.pubs, p.publishers, p.publisher_count,
    list_filter(s.excerpts[1:4], lambda x: trim(x) <> '') AS lead4, list_filter(s.excerpts, lambda x: trim(x) <> '') AS facts
    FROM v_incident v JOIN src s ON s.incident_id = v.id JOIN pub p ON p.incident_id = v.id),
  l AS (SELECT *, list_filter([{title.replace('v.title', 'title')}, 'Operator identified as ' || operator || '.', 'Asset involved: ' || asset || '.', 'Location reported in ' || country || '.',
      CASE WHEN fatalities = 0 THEN 'No fatalities were reported by the available sources.' WHEN fatalities IS NOT NULL THEN concat(fatalities, ' fatality/fatalities reported.') END,
      CASE WHEN injuries > 0 THEN concat(injuries, ' injuries reported.') END] || list_transform(lead4, lambda e: {sql_truncate('e', 180)}), lambda x: x IS NOT NULL) AS raw FROM n),
  u AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS lines FROM l),
  f AS (SELECT *, CASE WHEN length(lines) < 4 THEN lines || ['Reported by ' || pubs[length(lines) % length(pubs) + 1] || '.'] ELSE lines END AS filled FROM u)
  SELECT id AS incident_id, concat_ws(chr(10) || chr(10), coalesce(summary, title || '.'), facts[1], concat('Reported by ', publisher_count, CASE WHEN publisher_count = 1 THEN ' source: ' ELSE ' sources: ' END, replace(publishers, ';', ', '), '.')) AS summary,
    array_to_string(filled[1:8], '|') AS highlights FROM f"""


DETAIL_SQL = with_sql("v_incident", "v_evidence", "v_state") + _STATES_SQL + f""", e AS (SELECT DISTINCT * FROM v_evidence),
  src AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY source_tier, coalesce(published_at, TIMESTAMP '1970-01-01') DESC, article_id) AS r FROM e)
  SELECT id AS incident_id, 'incident' AS part, CAST(0 AS BIGINT) AS position, 'title' AS name, title AS value FROM v_incident
  UNION ALL SELECT incident_id, 'source', r, article_id, publisher FROM src
  UNION ALL SELECT incident_id, 'publisher', min(r), publisher, CAST(count(*) AS VARCHAR) FROM src GROUP BY incident_id, publisher
  UNION ALL SELECT id, 'entity', 0, entity_type, name FROM ({_entities_sql('v_incident', 'id')})
  UNION ALL {" UNION ALL ".join(f"SELECT id, 'evidence', 0, '{c}', CAST({c} AS VARCHAR) FROM v_incident WHERE {c} IS NOT NULL" for c in provenance.EVIDENCE_COLUMNS)}
  UNION ALL SELECT incident_id, 'highlight', unnest(range(len(h))), NULL, unnest(h) FROM (SELECT incident_id, string_split(highlights, '|') AS h FROM ({_narrative_sql()}))
  UNION ALL SELECT incident_id, 'state', 0, CAST(user_id AS VARCHAR), state FROM states WHERE incident_id IN (SELECT id FROM v_incident)"""


QUERIES = {
    "feed_page": (feed_page, FEED_PAGE_SQL),
    "feed_page_totals": (feed_page_totals, FEED_TOTALS_SQL),
    "feed_orders": (feed_orders, FEED_ORDERS_SQL),
    "feed_quick_filters": (quick_filters, QUICK_FILTERS_SQL),
    "feed_facet_filters": (facet_filters, FACET_SQL),
    "feed_effective_dates": (effective_dates, _effective_sql()),
    "feed_visibility": (visibility, VISIBILITY_SQL),
    "search_keywords": (keyword_search, SEARCH_SQL),
    "search_full_text": (full_text_search, FULL_TEXT_SQL),
    "user_current_states": (user_states, USER_STATES_SQL),
    "user_row_scope": (user_scope, USER_SCOPE_SQL),
    "dashboard_kpis": (dashboard_kpis, KPI_SQL),
    "dashboard_for_user": (dashboard_for_user, KPI_USER_SQL),
    "dashboard_top_lists": (dashboard_top_lists, _top_sql()),
    "dashboard_severity_buckets": (dashboard_severity, SEVERITY_SQL),
    "dashboard_daily_trend": (dashboard_trend, TREND_SQL),
    "evidence_counters": (evidence_counters, COUNTERS_SQL),
    "evidence_leading_source": (leading_source, LEADING_SQL),
    "dossier_fields": (dossier_fields, _dossier_sql()),
    "dossier_sources": (dossier_sources, DOSSIER_SOURCES_SQL),
    "incident_detail": (incident_detail, DETAIL_SQL),
    "incident_narrative": (narrative, _narrative_sql()),
}
