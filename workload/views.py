"""Views over the driver tables. One expression list per view serves Spark and the SQL check.

`{ts}` stands for the timestamp type without time zone, the only spelling that differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave import taxonomy as X
from factweave.session import tune

NOW = "2001-07-31 12:00:00"
TODAY = "2001-07-31"


def pick(values, index: str) -> str:
    """SQL that picks one of `values` by an integer expression; None gives NULL."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + str(v).replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {cases} END"


_HEADLINE = "split_part(split_part(text, chr(10), 1), '.', 1)"

ARTICLE = ("documents", {
    "id": "doc_id",
    "seq": "doc_id",
    "title": _HEADLINE,
    "excerpt": f"substr(text, length({_HEADLINE}) + 1)",
    "publisher": "source",
    "language": "lang",
    "published_at": "CASE WHEN doc_id % 17 = 3 THEN NULL ELSE CAST('2024-01-01 00:00:00' AS {ts}) + INTERVAL '1' HOUR * (doc_id % 720) END",
    "source_tier": "1 + CAST(substr(source, 4) AS INT) % 5",
    "url": "concat('https://www.', source, '.example.com/', lang, '/', n_chars, '?utm_source=feed&b=2&a=', doc_id % 2)",
    "canonical_url": "CASE WHEN doc_id % 5 = 0 THEN concat('http://m.wire.example.org/', lang, '/', n_chars, '/') END",
})

_EVENTS = (
    "Fire", "Explosion", "Gas leak", "Oil spill", "Well blowout", "Well control incident", "Pipeline rupture",
    "Hydrocarbon release", "Crane collapse", "Helicopter crash", "Dropped object", "Emergency shutdown", "Evacuation",
    "Loss of containment", "H2S release", "Annulus pressure alarm", "Ferry collision", "Market outlook", "Apartment fire",
    "BOP failure", "Oil prices rise", "Maintenance campaign", "Open-air concert", "Vessel collision",
)
_PLACES = (
    "on the production platform", "on drilling rig Nordvind", "at the refinery", "on the FPSO Aurora", "at the LNG terminal",
    "on a gas pipeline", "at the Kestrel platform", "on the drillship Meridian", "at a compressor station", "near the harbour",
    "at the tank farm", "on the subsea template", "at a coal mine",
)
_COUNTRY_WORDS = (
    "Norway", "the North Sea", "Brazil", "the Gulf of Mexico", "Danish waters", "Rotterdam", "Alberta", "Campeche", "Colombia",
    "Argentina", "Venezuela", "Guyana", "Angola", "the Niger Delta", "Ghana", "Egypt", "Libya", "Mozambique", "Saudi Arabia",
    "Abu Dhabi", "Iraq", "Kuwait", "Queensland", "Malaysia", "Atlantis",
)
_FIRMS = ("Norsea", "Vega", "Delta", "Kestrel", "Borealis", "Orion", "Atlas", "The", "Rusk County")
_FORMS = ("Energy", "Petroleum", "Oil", "Drilling", "Resources", "Services Ltd", "Midstream")
_CASUALTIES = (
    "two workers were injured", "no injuries were reported", "3 people were killed", "one worker killed and 120 people were evacuated",
    "five crew missing", "there were no fatalities", "nobody was hurt", "12 people were treated", "55 personnel were evacuated",
    "four workers killed",
)
_DETAILS = (
    "Production was halted and environmental contamination was reported near block 22/4b",
    "The well 15-ABC-7 was shut in during a workover", "A major sheen was seen in the Campos basin",
    "Both barriers failed during drilling", "Damage to the wellhead is being assessed", "Analysts see normal operations",
    "A gas leak was found in the casing", "The cause is under investigation",
)
_PUBLISHERS = ("Harbour Wire", "Coastline Daily", "Energy Ledger", "Port Gazette", "Norsea Energy", "Rig Monitor", "Vega Petroleum News")

# Short reports in the domain's language, composed from orders, customers and nations.
BULLETIN = ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", {
    "id": "o_orderkey",
    "seq": "o_orderkey",
    "title": f"concat({pick(_EVENTS, 'o_orderkey * 7 + o_custkey')}, ' ', {pick(_PLACES, 'o_custkey * 5 + o_orderkey')}, ' in ', {pick(_COUNTRY_WORDS, 'n_nationkey')})",
    "excerpt": (f"CASE WHEN o_orderkey % 37 = 5 THEN NULL ELSE concat({pick(_FIRMS, 'o_custkey')}, ' ', {pick(_FORMS, 'o_custkey * 3')}, ' said ', "
                f"{pick(_CASUALTIES, 'o_orderkey * 3 + o_custkey')}, '. ', {pick(_DETAILS, 'o_orderkey + o_custkey * 3')}, '.') END"),
    "publisher": pick(_PUBLISHERS, "o_orderkey * 5 + o_custkey"),
    "language": "'en'",
    "published_at": "CASE WHEN o_orderkey % 19 = 4 THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) END",
    "source_tier": "CAST(1 + o_orderkey % 5 AS INT)",
    "url": "concat('https://news', o_custkey % 40, '.example.com/', o_orderkey % 9973)",
    "canonical_url": "CASE WHEN o_orderkey % 11 = 0 THEN concat('https://wire.example.org/', o_orderkey % 4999) END",
})

_DISPATCHES = (
    ("Gas leak shuts the tank farm", "en"), ("Quiet day at the harbour", "en"), ("Incêndio em plataforma de produção na bacia de Santos", "pt"), ("Vazamento de gás em refinaria deixa feridos", "pt"),
    ("Novo poço inaugurado sem cerimônia", "pt"), ("Derrame de petróleo tras la ruptura de oleoducto", "es"), ("Explosión en refinería: dos heridos", "es"), ("Feria de libros en la plaza", "es"),
    ("Fuite de gaz à la raffinerie, trois blessés", "fr"), ("Éruption de puits au large, évacuation en cours", "fr"), ("Grève dans les transports", "fr"), ("Brann på plattform i Nordsjøen", "no"),
    ("Gasslekkasje ved brønnhode, granskning varslet", "no"), ("Tap av brønnkontroll på boreskip", "no"), ("Skolen åpner igjen mandag", "no"),
)
# One-line reports in five languages.
DISPATCH = ("orders JOIN customer ON o_custkey = c_custkey", {
    "id": "o_orderkey",
    "title": pick([t for t, _ in _DISPATCHES], "o_orderkey + o_custkey * 7"),
    "language": pick([x for _, x in _DISPATCHES], "o_orderkey + o_custkey * 7"),
    "excerpt": f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {pick([t for t, _ in _DISPATCHES[::-1]], 'o_custkey * 5 + o_orderkey % 11')} END",
    "publisher": pick(_PUBLISHERS, "o_orderkey * 5 + o_custkey"),
    "source_tier": "CAST(1 + o_orderkey % 5 AS INT)",
})

_TYPES = X.INCIDENT_TYPES
INCIDENT = ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", {
    "id": "o_orderkey",
    "position": "o_orderkey",
    "title": f"concat({pick([t.replace('_', ' ') for t in _TYPES], 'o_orderkey + o_custkey * 3')}, ' at unit ', o_custkey % 40, ', ', n_name)",
    "summary": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('Report ', o_orderkey, ' by ', c_name, ' in ', r_name, '.') END",
    "incident_date": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "incident_time": "CASE WHEN o_orderkey % 4 = 0 THEN '08:30' END",
    "detected_at": "o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 72)",
    "last_updated_at": "o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 72 + o_custkey % 48)",
    "country": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE n_name END",
    "country_code": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(chr(CAST(65 + n_nationkey AS INT)), 'X') END",
    "region": "r_name",
    "city": "CASE WHEN o_custkey % 5 = 0 THEN concat('Port ', o_custkey % 17) END",
    "basin": "CASE WHEN o_custkey % 9 = 0 THEN 'Northern basin' END",
    "block": "CASE WHEN o_custkey % 8 = 0 THEN concat('block ', o_custkey % 30) END",
    "field": "CASE WHEN o_custkey % 6 = 0 THEN concat('Field ', o_custkey % 12) END",
    "operator": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN concat(c_name, ' AS') ELSE c_name END",
    "company": "CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN concat(c_mktsegment, ' Holdings') END",
    "drilling_contractor": "CASE WHEN o_orderkey % 13 = 0 THEN 'Deep Drilling' END",
    "service_company": "CASE WHEN o_orderkey % 17 = 0 THEN 'Well Services Ltd' END",
    "pipeline_operator": "CAST(NULL AS {text})",
    "asset": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Unit ', o_custkey % 40) END",
    "installation": "CASE WHEN o_orderkey % 3 = 1 THEN concat('Unit ', o_custkey % 40, ' topside') END",
    "installation_type": pick([*X.INSTALLATION_TYPES, None, None], "o_custkey"),
    "vessel": "CASE WHEN o_orderkey % 21 = 0 THEN concat('MV ', o_custkey % 9) END",
    "well_name": "CASE WHEN o_orderkey % 10 = 0 THEN concat('W-', o_custkey % 50) END",
    "well_number": "CASE WHEN o_orderkey % 20 = 0 THEN '15-ABC-7' END",
    "well_type": pick([*X.WELL_TYPES, None], "o_custkey * 3"),
    "well_status": pick([*X.WELL_STATUSES, None], "o_custkey * 7"),
    "water_depth_category": pick([*X.WATER_DEPTHS, None], "o_custkey"),
    "oil_gas_sector": pick(X.SECTORS, "o_custkey"),
    "environment": pick(X.ENVIRONMENTS, "o_orderkey + o_custkey"),
    "lifecycle_stage": pick(X.LIFECYCLE_STAGES, "o_orderkey * 3"),
    "incident_type": pick(_TYPES, "o_orderkey + o_custkey * 3"),
    "is_well_integrity_related": "CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "well_integrity_category": pick([*X.WELL_INTEGRITY_CATEGORIES, None, None], "o_orderkey * 5 + o_custkey"),
    "suspected_failed_component": "CASE WHEN o_orderkey % 31 = 0 THEN 'annular preventer' END",
    "barrier_function_impacted": pick([*X.BARRIER_FUNCTIONS, None], "o_orderkey"),
    "is_process_safety_event": "CASE o_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "process_safety_category": pick([*X.PROCESS_SAFETY_CATEGORIES, None], "o_orderkey + o_custkey"),
    "severity": "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'moderate' ELSE 'low' END",
    "severity_score": "CAST(floor(o_totalprice / 5500) AS INT)",
    "confidence": pick(X.CONFIDENCES, "o_orderkey * 2 + o_custkey"),
    "confidence_score": "CAST((o_orderkey * 13) % 101 AS INT)",
    "relevance_score": "CAST((o_custkey * 17 + o_orderkey) % 101 AS INT)",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'updated' ELSE 'under_review' END",
    "model_severity": pick([*X.SEVERITIES, None], "o_orderkey"),
    "fatalities": "CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey % 7 AS INT) END",
    "injuries": "CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey % 14 AS INT) END",
    "missing_persons": "CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey % 5 AS INT) END",
    "evacuated_persons": "CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_custkey % 160 AS INT) END",
    "hydrocarbon_release": "CASE o_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "fire": "CASE WHEN o_orderkey % 6 = 0 THEN TRUE END",
    "explosion": "CASE WHEN o_orderkey % 11 = 0 THEN TRUE END",
    "spill": "CASE WHEN o_custkey % 12 = 0 THEN TRUE END",
    "shutdown": "CASE WHEN o_orderkey % 14 = 0 THEN TRUE END",
    "well_control_event": "CASE WHEN o_orderkey % 25 = 0 THEN TRUE END",
    "environmental_impact": "CASE o_custkey % 10 WHEN 0 THEN 'Large slick reported' WHEN 1 THEN 'Minor sheen' WHEN 2 THEN ' ' END",
    "production_impact": "CASE WHEN o_custkey % 7 = 0 THEN 'Output reduced' END",
    "asset_damage": "CASE WHEN o_custkey % 15 = 0 THEN 'Crane damaged' END",
    "is_mock": "o_orderkey % 100 <> 0",
})

# Secondary types travel as a comma-separated text in the view and become an array where they are used.
SECONDARY_TYPES = f"CASE WHEN o_orderkey % 4 = 0 THEN concat({pick(('fire', 'explosion', 'oil_spill', 'evacuation'), 'o_custkey')}, ',injury') ELSE '' END"
INCIDENT[1]["secondary_types"] = SECONDARY_TYPES

EVIDENCE = ("lineitem JOIN supplier ON l_suppkey = s_suppkey", {
    "incident_id": "l_orderkey",
    "article_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "publisher": "s_name",
    "source_tier": "CAST(1 + s_suppkey % 5 AS INT)",
    "published_at": "CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_shipdate END",
    "title": "concat('Part ', l_partkey, ' reported by ', s_name)",
    "excerpt": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('Item ', l_partkey, ' of order ', l_orderkey, ', status ', l_linestatus, '.') END",
    "url": "concat('https://', lower(s_name), '.example.com/', l_partkey)",
})

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
VERSION = ("events", {
    "incident_id": "user_id",
    "event_id": "event_id",
    "seen_at": "ts",
    "day": "CAST(ts AS DATE)",
    "fatalities": f"CASE WHEN {_K} % 5 = 0 THEN {_K} % 4 END",
    "injuries": f"CASE WHEN {_K} % 3 = 0 THEN {_K} % 6 END",
    "missing_persons": f"CASE WHEN {_K} % 11 = 0 THEN {_K} % 3 END",
    "evacuated_persons": f"CASE WHEN {_K} % 13 = 0 THEN {_K} END",
    "severity_score": "CAST(least(100, floor(value)) AS INT)",
    "severity": "CASE WHEN least(100, floor(value)) >= 80 THEN 'critical' WHEN least(100, floor(value)) >= 60 THEN 'high' WHEN least(100, floor(value)) >= 35 THEN 'moderate' ELSE 'low' END",
    "environmental_impact": f"CASE WHEN {_K} % 17 = 0 THEN 'sheen' END",
    "production_impact": f"CASE WHEN {_K} % 19 = 0 THEN 'reduced' END",
    "shutdown": "CASE WHEN event_type = 'error' THEN TRUE END",
    "operator": f"CASE WHEN {_K} % 6 = 0 THEN concat('Operator ', {_K} % 3) END",
    "asset": f"CASE WHEN {_K} % 4 = 0 THEN concat('Unit ', {_K} % 5) END",
    "well_name": f"CASE WHEN {_K} % 23 = 0 THEN 'W-1' END",
    "is_well_integrity_related": f"CASE WHEN event_type = 'purchase' THEN TRUE WHEN {_K} % 29 = 0 THEN FALSE END",
    "well_integrity_category": f"CASE {_K} % 12 WHEN 0 THEN 'well_control' WHEN 1 THEN 'bop' WHEN 2 THEN 'multiple_barrier_failure' END",
    "suspected_failed_component": "CAST(NULL AS {text})",
    "barrier_function_impacted": f"CASE WHEN {_K} % 31 = 0 THEN 'both' END",
    "is_process_safety_event": "CASE WHEN event_type = 'click' THEN TRUE END",
    "process_safety_category": "CASE WHEN event_type = 'click' THEN 'fire' END",
    "cause": f"CASE WHEN {_K} % 37 = 0 THEN 'corrosion' END",
    "has_official_source": f"{_K} % 41 = 0",
    "incident_date": f"CASE WHEN {_K} % 7 = 0 THEN CAST(ts AS DATE) END",
    "incident_type": pick(_TYPES, "event_id"),
    "relevance_score": f"{_K}",
})

STATE = ("events", {
    "user_id": "user_id % 25",
    "incident_id": f"{_K} * 37 + event_id % 37",
    "state": "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'saved' WHEN 'purchase' THEN 'monitoring' WHEN 'signup' THEN 'new' ELSE 'archived' END",
    "updated_at": "ts",
    "event_id": "event_id",
})

CALL = ("events", {
    "run_id": "CAST(ts AS DATE)",
    "call_id": "event_id",
    "provider": "concat('provider-', user_id % 7)",
    "results": _K,
    "duration_ms": "CAST(floor(value * 10) AS BIGINT)",
    "retries": f"{_K} % 3",
    "error": f"CASE WHEN event_type = 'error' AND user_id % 7 <> 2 THEN concat('status ', 500 + {_K} % 4) END",
    "started_at": "ts",
})

DEVICE = ("customer", {
    "user_id": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END",
    "token": "concat('token-', c_custkey)",
    "active": "c_custkey % 9 <> 0",
})
PREFERENCE = ("customer", {
    "user_id": "c_custkey",
    "enabled": "c_custkey % 8 <> 0",
    "sound": "c_custkey % 2 = 0",
    "critical_only": "c_custkey % 6 = 0",
    "min_severity": pick(X.SEVERITIES, "c_custkey"),
    "severities": "CASE WHEN c_custkey % 5 = 0 THEN 'critical,high' ELSE '' END",
    "incident_types": "CASE WHEN c_custkey % 7 = 0 THEN 'fire,blowout,explosion' ELSE '' END",
    "countries": "CASE WHEN c_custkey % 3 = 0 THEN concat('nation_', c_nationkey) ELSE '' END",
    "well_integrity_alerts": "c_custkey % 4 <> 0",
    "well_control_alerts": "c_custkey % 5 <> 1",
})

PAGE = ("pages", {
    "id": "page_id",
    "url": "CASE page_id % 9 WHEN 0 THEN concat(url, '') WHEN 4 THEN replace(url, 'example', 'example.co') ELSE url END",
    "html": "html",
})

VIEWS = {"v_article": ARTICLE, "v_bulletin": BULLETIN, "v_dispatch": DISPATCH, "v_incident": INCIDENT, "v_evidence": EVIDENCE, "v_version": VERSION,
         "v_state": STATE, "v_call": CALL, "v_device": DEVICE, "v_preference": PREFERENCE, "v_page": PAGE}
_SPARK = {"ts": "TIMESTAMP_NTZ", "text": "STRING"}
_DUCK = {"ts": "TIMESTAMP", "text": "VARCHAR"}
_TABLES = ("orders", "customer", "nation", "region", "lineitem", "supplier", "documents", "events", "pages", "part")


def _select(view: str, words: dict, columns=None) -> str:
    source, exprs = VIEWS[view]
    chosen = columns or list(exprs)
    fill = lambda e: e.replace("{ts}", words["ts"]).replace("{text}", words["text"])
    return "SELECT " + ", ".join(f"{fill(exprs[c])} AS {c}" for c in chosen) + f" FROM {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame. Tables are passed by name to `spark.sql`, so no temporary view is left behind."""
    source, _ = VIEWS[name]
    used = [t for t in _TABLES if t in source.replace("(", " ").split()]
    sql = _select(name, _SPARK)
    frames = {}
    for t in used:
        frames[t] = table(spark, sf_dir, t)
    for t in used:
        sql = _replace_word(sql, t)
    return spark.sql(sql, **{f"{t}_": frames[t] for t in used})


def _replace_word(sql: str, name: str) -> str:
    import re

    head, _, tail = sql.rpartition(" FROM ")
    return head + " FROM " + re.sub(rf"\b{name}\b", "{" + name + "_}", tail)


def with_sql(*names: str) -> str:
    """`WITH v AS (...), ...` for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({_select(n, _DUCK)})" for n in names)
