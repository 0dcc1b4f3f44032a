"""Keys, similarity, sources, relevance and extraction over `v_article`, `v_bulletin` and `v_page`."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from factweave import rules as R
from factweave import schemas
from factweave.config import PUBLICATION_LEAD_IN_DAYS
from factweave.functions import text as T
from factweave.functions import url as U
from factweave.functions.stage import pin
from factweave.functions.time import passes_publication_window, resolve_window
from factweave.operators import extract, provenance, relevance, runs
from factweave.operators.ordered import with_previous, with_range_bucket
from factweave.operators.users import user_uuid
from factweave.session import checkpoint_root
from factweave.sources import catalogue, feeds, raw, responses, search_api
from factweave.terms import TermLists
from workload import sqlparts as S
from workload.feed_queries import NOW_DT, TODAY
from workload.views import table, view, with_sql

DOC_NOW = datetime(2024, 1, 31, 12)

# Terms drawn from the invented prose, so that the rules have work to do on `documents`.
PROSE_TERMS = TermLists(
    industry=("credit card", "password", "token", "estion", "mentier", "the and", "heit", "ción", "tion of the"),
    event=("worthless", "pathetic", "license", "the", "und", "elle", "los", "copyright"),
    strong=("all rights reserved", "of the", "and the", "de la", "is the"),
    well=("ation", "pf", "éau", "sch"),
)


def text_keys(spark, sf):
    """Normalised text and comparison keys of every article."""
    c = F.col
    return view(spark, sf, "v_article").select(
        "id", F.md5(T.normalise_text(F.concat_ws(" ", "title", "excerpt"))).alias("norm_md5"), T.title_hash(c("title")).alias("title_hash"),
        T.content_hash(c("title"), c("excerpt")).alias("content_hash"), F.array_join(T.token_set(c("publisher")), " ").alias("publisher_tokens"),
        F.size(T.tokenise(F.concat_ws(" ", "title", "excerpt"))).cast("bigint").alias("n_tokens"), T.truncate(c("title"), 40).alias("short_title"),
        T.fingerprint(c("id"), c("published_at").cast("date"), c("canonical_url")).alias("fingerprint"))


_BODY = "concat_ws(' ', title, excerpt)"
TEXT_KEYS_SQL = with_sql("v_article") + f""" SELECT id, md5({S.norm(_BODY)}) AS norm_md5, md5(array_to_string(list_sort({S.tokens('title')}), ' ')) AS title_hash,
  md5(concat({S.norm('title')}, ' ', {S.norm("coalesce(excerpt, '')")})) AS content_hash, array_to_string(list_distinct({S.tokens('publisher')}), ' ') AS publisher_tokens,
  length({S.tokens(_BODY)}) AS n_tokens, {S.truncate('title', 40)} AS short_title, {S.fingerprint('id', 'CAST(published_at AS DATE)', 'canonical_url')} AS fingerprint FROM v_article"""


def organisation_names(spark, sf):
    """Organisation and asset names as they are compared."""
    c = F.col
    return view(spark, sf, "v_incident").select(
        "id", T.organisation_name(c("operator")).alias("operator"), T.organisation_name(c("company")).alias("company"),
        T.asset_name(c("installation")).alias("installation"))


ORG_SQL = with_sql("v_incident") + f" SELECT id, {S.org('operator')} AS operator, {S.org('company')} AS company, {S.norm('installation')} AS installation FROM v_incident"


def url_keys(spark, sf):
    """Comparison key, publisher host and safety of page URLs and of redirect-wrapped ones."""
    pages = view(spark, sf, "v_page")
    wrapped = F.concat(F.lit("https://redirect.example.com/go?id=1&url="), F.url_encode("url"))
    return pages.select(
        "id", U.normalise_url(F.col("url")).alias("url_key"), U.publisher_host(F.col("url")).alias("host"), U.is_safe_url(F.col("url")).alias("safe"),
        U.is_safe_url(F.regexp_replace("url", "://", "://user:pw@")).alias("safe_with_login"), U.normalise_url(F.concat(F.lit("Page "), "url")).alias("not_a_url"),
        U.unwrap_redirect(wrapped).alias("unwrapped"))


URL_SQL = with_sql("v_page") + f""" SELECT id, {S.normalise_url('url')} AS url_key, {S.publisher_host('url')} AS host, {S.safe_url('url')} AS safe,
  FALSE AS safe_with_login, lower(concat('Page ', url)) AS not_a_url, url AS unwrapped FROM v_page"""


def similarity_pairs(spark, sf):
    """Each incident compared with the next one in its country, by id: headline, trigram and name similarity.

    Incidents without a country are a group of their own, repeated ones follow one another.
    """
    rows = view(spark, sf, "v_incident").filter("id IS NOT NULL").select("id", "title", "operator", F.coalesce(F.concat(F.lit("="), "country"), F.lit("")).alias("place"))
    # The later one of a pair looks back.
    later = with_previous(with_range_bucket(rows, "id", "bucket"), "place", "bucket", ["id", "title", "operator"], ["id", "title", "operator"]).filter("has_prev")
    joined = later.select(F.col("prev_id").alias("id"), F.col("prev_title").alias("title"), F.col("prev_operator").alias("operator"), F.col("title").alias("title_b"), F.col("operator").alias("operator_b"))
    round6 = lambda c: F.round(c, 6)
    keyed = joined.select("id", "title", "title_b", T.token_set(F.col("title")).alias("a"), T.token_set(F.col("title_b")).alias("b"),
                          T.organisation_name(F.col("operator")).alias("name"), T.organisation_name(F.col("operator_b")).alias("name_b"))
    keyed = pin(keyed, "a", "b", "name", "name_b")
    a, b = F.col("a"), F.col("b")
    return keyed.select(
        "id", round6(T.jaccard(a, b)).alias("jaccard"), round6(T.containment(a, b)).alias("containment"), round6(T.headline_similarity(a, b)).alias("headline"),
        round6(T.trigram_similarity(F.col("title"), F.col("title_b"))).alias("trigram"), round6(T.name_similarity(F.col("name"), F.col("name_b"))).alias("name"))


_TRI = "list_distinct(list_transform(range(1, length(p{0}) - 1), lambda i: substr(p{0}, i, 3)))"
SIMILARITY_SQL = with_sql("v_incident") + f""", l AS (SELECT id, title, operator, lead(id) OVER w AS id_b, lead(title) OVER w AS title_b, lead(operator) OVER w AS operator_b FROM v_incident WHERE id IS NOT NULL
    WINDOW w AS (PARTITION BY country ORDER BY id, title NULLS FIRST, operator NULLS FIRST)),
  j AS (SELECT id, {S.token_set('title')} AS x, {S.token_set('title_b')} AS y, {S.org('operator')} AS oa, {S.org('operator_b')} AS ob,
    concat(' ', trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), ' ') AS p1, concat(' ', trim(regexp_replace(lower(title_b), '\\s+', ' ', 'g')), ' ') AS p2
    FROM l WHERE id_b IS NOT NULL),
  k AS (SELECT *, {_TRI.format(1)} AS g1, {_TRI.format(2)} AS g2, length(list_intersect(x, y)) AS i FROM j)
  SELECT id, round(i / (length(x) + length(y) - i), 6) AS jaccard, round(i / least(length(x), length(y)), 6) AS containment, round({S.headline_similarity('x', 'y')}, 6) AS headline,
    round(length(list_intersect(g1, g2)) / (length(g1) + length(g2) - length(list_intersect(g1, g2))), 6) AS trigram, round({S.name_similarity('oa', 'ob')}, 6) AS name FROM k"""


def user_keys(spark, sf):
    """Identity strings folded into UUID-shaped keys; UUIDs pass."""
    people = table(spark, sf, "customer")
    identity = F.when(F.col("c_custkey") % 5 == 0, F.lit("ABCDEF01-2345-6789-ABCD-EF0123456789")).otherwise(F.concat(F.lit("device:"), "c_custkey"))
    return people.select("c_custkey", user_uuid(identity).alias("user_key"))


USER_KEYS_SQL = """WITH d AS (SELECT c_custkey, md5(concat('user:', 'device:', c_custkey)) AS h FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'abcdef01-2345-6789-abcd-ef0123456789' ELSE concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
    substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3), substr(h, 21, 12)) END AS user_key FROM d"""


def publication_window(spark, sf):
    """Articles that pass the publication pre-window, per publisher."""
    window = resolve_window(NOW_DT, "last_14_days")
    rows = view(spark, sf, "v_bulletin").filter(passes_publication_window(F.col("published_at"), window, PUBLICATION_LEAD_IN_DAYS))
    return rows.groupBy("publisher").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("published_at").isNull()).alias("undated"))


PUBLICATION_SQL = with_sql("v_bulletin") + f""" SELECT publisher, count(*) AS kept, count(*) FILTER (WHERE published_at IS NULL) AS undated FROM v_bulletin
  WHERE published_at IS NULL OR ((DATE '{TODAY}' - 14) - CAST(published_at AS DATE) <= 45 AND CAST(published_at AS DATE) <= DATE '{TODAY}') GROUP BY publisher"""


# ------------------------------------------------------------------------------------------------ relevance

_LISTS = ("matched_event_terms", "matched_industry_terms", "matched_strong_phrases", "matched_well_terms")


def _verdict_columns(df):
    return df.select("id", "passed", F.col("score").cast("bigint").alias("score"), "has_event_signal", "has_industry_signal", "has_strong_phrase", "has_well_signal",
                     *[F.array_join(c, "|").alias(c) for c in _LISTS], "excluded", "exclusion_domain", "overridden_by_anchor", "sector_hint", "reason")


BULLETIN_OPTIONS = {"include_keywords": ("Aurora",), "exclude_keywords": ("Open-air", "Atlantis")}


def relevance_bulletins(spark, sf):
    """Verdict of every bulletin with the English lists and user keywords."""
    return _verdict_columns(relevance.evaluate_relevance(view(spark, sf, "v_bulletin"), **BULLETIN_OPTIONS))


def relevance_articles(spark, sf):
    """Verdict of every document, whole text, with terms of its own prose."""
    return _verdict_columns(relevance.explain_verdict(view(spark, sf, "v_article"), "id", terms=PROSE_TERMS))


def _verdict_sql(source: str, terms: TermLists, include=(), exclude=()):
    def hits(names, n):
        import re
        cases = ", ".join(f"CASE WHEN regexp_matches(t, {S.quote(chr(92) + 'b' + re.escape(x) + '(?:e?s)?' + chr(92) + 'b')}) THEN {S.quote(x)} END" for x in names)
        return f"list_filter([{cases}], lambda x: x IS NOT NULL)[1:{n}]"

    domains = "CASE " + " ".join(f"WHEN {S.found('t', relevance.any_of(p))} THEN '{n}'" for n, _, _, p in R.EXCLUSION_DOMAINS) + " END"
    labels = "CASE domain " + " ".join(f"WHEN '{n}' THEN {S.quote(text.lower())}" for n, text, _, _ in R.EXCLUSION_DOMAINS) + " END"
    hint = {k: " + ".join(f"CAST(contains(t, {S.quote(h)}) AS INT)" for h in v) for k, v in R.SECTOR_HINTS.items()}
    blocked = "CASE " + " ".join(f"WHEN contains(t, {S.quote(T.fold_literal(k))}) THEN {S.quote(k)}" for k in exclude) + " END" if exclude else "CAST(NULL AS VARCHAR)"
    included = " OR ".join(f"contains(t, {S.quote(T.fold_literal(k))})" for k in include) or "FALSE"
    return with_sql(source) + f""", a AS (SELECT id, source_tier, {S.fold("concat_ws(' ', title, coalesce(excerpt, ''), publisher)")} AS t FROM {source}),
  b AS (SELECT *, {hits(terms.strong, 5)} AS s, {hits(terms.event, 8)} AS e, {hits(terms.industry, 8)} AS i, {hits(terms.well, 5)} AS w,
    {S.found('t', relevance.any_of(R.ANCHORS))} AS anchor, {domains} AS domain, {blocked} AS blocked, {included} AS included,
    {hint['upstream']} AS up, {hint['midstream']} AS mid, {hint['downstream']} AS down FROM a),
  c AS (SELECT *, length(e) > 0 OR length(s) > 0 AS ev, length(i) > 0 OR length(s) > 0 OR anchor AS ind, coalesce(domain <> 'market-news' AND anchor, FALSE) AS over, greatest(up, mid, down) AS mx FROM b),
  d AS (SELECT *, domain IS NOT NULL AND NOT over AS ex, blocked IS NOT NULL AS bl, ev AND ind AS ok,
    least(100, greatest(0, CASE WHEN ev THEN 18 ELSE 0 END + CASE WHEN ind THEN 22 ELSE 0 END + least(length(s), 3) * 12 + least(length(i), 4) * 3 + least(length(e), 4) * 2
      + CASE WHEN length(w) > 0 THEN 6 ELSE 0 END + CASE WHEN anchor THEN 10 ELSE 0 END - CASE WHEN over THEN 8 ELSE 0 END + CASE WHEN source_tier <= 2 THEN 4 ELSE 0 END + CASE WHEN included THEN 10 ELSE 0 END)) AS pts FROM c)
  SELECT id, NOT bl AND NOT ex AND ok AS passed, CAST(CASE WHEN bl OR ex THEN 0 WHEN ok THEN pts ELSE least(pts, 40) END AS BIGINT) AS score,
    ev AND NOT bl AS has_event_signal, ind AND NOT bl AS has_industry_signal, length(s) > 0 AND NOT bl AS has_strong_phrase, length(w) > 0 AND NOT bl AS has_well_signal,
    CASE WHEN bl THEN '' ELSE array_to_string(e, '|') END AS matched_event_terms, CASE WHEN bl THEN '' ELSE array_to_string(i, '|') END AS matched_industry_terms,
    CASE WHEN bl THEN '' ELSE array_to_string(s, '|') END AS matched_strong_phrases, CASE WHEN bl THEN '' ELSE array_to_string(w, '|') END AS matched_well_terms,
    bl OR ex AS excluded, CASE WHEN bl THEN 'user-keyword' ELSE domain END AS exclusion_domain, over AND NOT bl AS overridden_by_anchor,
    CASE WHEN bl OR ex OR mx = 0 THEN 'unknown' WHEN CAST(up = mx AS INT) + CAST(mid = mx AS INT) + CAST(down = mx AS INT) > 1 THEN 'integrated' WHEN up = mx THEN 'upstream' WHEN mid = mx THEN 'midstream' ELSE 'downstream' END AS sector_hint,
    CASE WHEN bl THEN concat('Blocked by the user exclude keyword "', blocked, '".') WHEN ex THEN concat('Excluded: the article is about ', {labels}, ' with no Oil & Gas anchor.')
      WHEN ok THEN concat('Event signal (', coalesce(nullif(array_to_string(e[1:3], ', '), ''), 'strong phrase'), ') combined with an Oil & Gas signal (', coalesce(nullif(array_to_string(i[1:3], ', '), ''), 'anchor phrase'), ').')
      WHEN NOT ev THEN 'No incident/event terminology found.' ELSE 'Event terminology present but no clear Oil & Gas relation (section 4: "fire"/"explosion" alone is not sufficient).' END AS reason FROM d"""


def relevance_languages(spark, sf):
    """Verdict of every dispatch, in five languages."""
    return _verdict_columns(relevance.explain_verdict(view(spark, sf, "v_dispatch"), "id"))


def classifier(spark, sf):
    """Bulletins through the rules classifier and its gate."""
    judged = relevance.classify_by_rules(relevance.evaluate_relevance(view(spark, sf, "v_bulletin"), **BULLETIN_OPTIONS))
    kept = judged.filter(relevance.passes_classifier(F.col("classifier_related"), F.col("classifier_confidence"), 0.35))
    return kept.select("id", F.round("classifier_confidence", 6).alias("confidence"), F.col("classifier_sector").alias("sector"))


LANGUAGES_SQL = _verdict_sql("v_dispatch", TermLists.built_in())
_BULLETIN_SQL = _verdict_sql("v_bulletin", TermLists.built_in(), **{k.replace("_keywords", ""): v for k, v in BULLETIN_OPTIONS.items()})
CLASSIFIER_SQL = f"SELECT id, round(least(0.95, 0.55 + score / 200), 6) AS confidence, sector_hint AS sector FROM ({_BULLETIN_SQL}) WHERE passed"


def region_match(spark, sf):
    """Incidents inside the requested regions, per country."""
    hit = runs.matches_region(F.col("country"), ("united_kingdom", "custom"), ("Nation_1", "nation 20", "NATION_2 waters"))
    return view(spark, sf, "v_incident").groupBy("country").agg(F.count_if(hit).alias("inside"), F.count(F.lit(1)).alias("n"))


_WANTED = [T.normalise_literal(v.replace("_", " ")) for v in ("united_kingdom", "custom", "Nation_1", "nation 20", "NATION_2 waters")]
REGION_SQL = with_sql("v_incident") + f""" SELECT country, count(*) FILTER (WHERE {" OR ".join(f"contains({S.norm('country')}, '{w}') OR contains('{w}', {S.norm('country')})" for w in _WANTED)}) AS inside,
  count(*) AS n FROM v_incident GROUP BY country"""


# ------------------------------------------------------------------------------------------------ extraction

_SHOWN = ["id", "is_related", "oil_gas_sector", "title", "summary", "country", "country_code", "basin", "block", "operator", "asset", "installation_type", "well_number",
          "environment", "lifecycle_stage", "incident_type", "is_well_integrity_related", "well_integrity_category", "is_process_safety_event", "process_safety_category",
          "model_severity", "fatalities", "injuries", "missing_persons", "evacuated_persons", "hydrocarbon_release", "environmental_impact", "production_impact", "asset_damage"]


def extracted(spark, sf):
    return extract.extract_incidents(view(spark, sf, "v_bulletin"), ["id"])


def extraction(spark, sf):
    """The extracted record of every bulletin."""
    return extracted(spark, sf).select(
        *_SHOWN, F.round("extraction_confidence", 6).alias("extraction_confidence"), F.array_join("secondary_incident_types", "|").alias("secondary_incident_types"),
        F.array_join("highlights", "|").alias("highlights"), F.col("incident_date").cast("string").alias("incident_date"))


_EX_VERDICT = _verdict_sql("v_bulletin", TermLists.built_in()).replace("title, coalesce(excerpt, ''), publisher)", "title, coalesce(excerpt, ''), '')").replace("CASE WHEN source_tier <= 2 THEN 4 ELSE 0 END", "0")


def _extraction_cte():
    t, raw = "t", "raw"
    count_words = "CASE lower({0}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.COUNT_WORDS.items()) + " END"

    def count(kind):
        token = "coalesce(" + ", ".join(f"nullif(regexp_extract({raw}, {S.quote(p)}, 1), '')" for p in R.CASUALTY_PATTERNS[kind]) + ")"
        none = f", CASE WHEN {S.found(raw, R.NO_CASUALTY_PATTERNS[kind])} THEN 0 END" if kind in R.NO_CASUALTY_PATTERNS else ""
        return f"CAST(coalesce(TRY_CAST({token} AS INT), {count_words.format(token)}{none}) AS INT)"

    def clean(x):
        return f"CASE WHEN trim({x}) <> '' AND lower(trim({x})) NOT IN {S.sql_list(schemas.SENTINELS)} THEN trim({x}) END"

    def grab(text, pattern, group):
        return f"nullif(trim(regexp_extract({text}, {S.quote(pattern)}, {group})), '')"

    pub = f"trim(regexp_replace(lower(publisher), '\\s*\\(fictional\\)\\s*', ''))"
    after = grab(raw, rf"\b(?:{R.ASSET_NOUNS})\s+(?:named\s+)?({R.PROPER_NAME})", 1)
    before = grab(raw, rf"\b({R.PROPER_NAME})\s+(?:[a-z][a-z-]*\s+){{0,2}}(?:{R.ASSET_NOUNS})\b", 1)

    def asset_ok(x):
        return (f"CASE WHEN length({x}) >= 3 AND NOT {S.found(x, R.NOT_AN_ASSET)} AND NOT {S.found(x, R.ORGANISATION_MARKER)} AND NOT {S.found(x, R.PLACE_OR_NEWSROOM)} "
                f"AND NOT contains(pub, lower({x})) AND NOT contains(lower({x}), pub) THEN {x} END")

    country = "CASE " + " ".join(f"WHEN {S.found(t, p)} THEN '{n}'" for n, _, p, _ in R.COUNTRIES) + " " + " ".join(f"WHEN {S.found(t, p)} THEN '{n}'" for n, _, _, p in R.COUNTRIES if p) + " END"
    codes = "CASE country " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c, _, _ in R.COUNTRIES) + " END"
    types = ", ".join(f"CASE WHEN {S.found(t, p)} THEN '{v}' END" for v, p in R.INCIDENT_TYPE_RULES)
    well = " OR ".join(f"contains(t, {S.quote(w)})" for w in TermLists.built_in().well)
    return f"""x1 AS (SELECT b.*, v.passed, v.score, v.sector_hint, concat(title, '. ', coalesce(excerpt, '')) AS raw, {S.fold("concat(title, '. ', coalesce(excerpt, ''))")} AS t, {pub} AS pub
      FROM v_bulletin b JOIN verdict v ON b.id = v.id),
    x2 AS (SELECT *, list_filter([{types}], lambda x: x IS NOT NULL) AS kinds, {count('fatalities')} AS fatalities, {count('injuries')} AS injuries, {count('missing_persons')} AS missing_persons,
      {count('evacuated_persons')} AS evacuated_persons, {country} AS country, {well} AS wellish, {S.first_rule(t, R.WELL_INTEGRITY_RULES)} AS wcat, {S.first_rule(t, R.PROCESS_SAFETY_RULES)} AS process_safety_category,
      {grab(raw, R.ORGANISATION_NAME, 1)} AS org0, {after} AS as1, {before} AS as2, strpos(t, 'environmental') AS ep, coalesce(excerpt, title) AS body FROM x1),
    x3 AS (SELECT *, coalesce(kinds[1], 'other') AS incident_type, {asset_ok('as1')} AS a1, {asset_ok('as2')} AS a2,
      CASE WHEN length(org0) >= 4 AND NOT {S.found('org0', R.SENTENCE_OPENER)} AND NOT {S.found('org0', R.PLACE_OR_NEWSROOM)} AND NOT contains(pub, lower(org0)) AND NOT contains(lower(org0), pub) THEN org0 END AS org1 FROM x2),
    ex AS (SELECT id, passed AS is_related, sector_hint AS oil_gas_sector, {S.truncate('title', 160)} AS title, substr(body, 1, 900) AS summary, country, {codes} AS country_code,
      {clean(grab(t, R.BASIN, 0))} AS basin, {clean(grab(raw, R.BLOCK, 0))} AS block, {clean('org1')} AS operator,
      {clean("CASE WHEN length(a2) > coalesce(length(a1), 0) THEN a2 ELSE a1 END")} AS asset, {S.first_rule(t, R.INSTALLATION_RULES)} AS installation_type,
      {clean(grab(raw, R.WELL_NUMBER, 1))} AS well_number, coalesce({S.first_rule(t, R.ENVIRONMENT_RULES)}, 'unknown') AS environment, coalesce({S.first_rule(t, R.LIFECYCLE_RULES)}, 'unknown') AS lifecycle_stage,
      incident_type, CASE WHEN wellish THEN TRUE END AS is_well_integrity_related, CASE WHEN wellish THEN wcat END AS well_integrity_category,
      CASE WHEN process_safety_category IS NOT NULL THEN TRUE END AS is_process_safety_event, process_safety_category,
      CASE WHEN fatalities > 1 THEN 'critical' WHEN fatalities = 1 THEN 'high' WHEN incident_type IN ('blowout', 'explosion') THEN 'critical'
        WHEN injuries >= 3 OR evacuated_persons >= 50 THEN 'high' WHEN incident_type IN ('fire', 'well_control', 'pipeline_rupture', 'oil_spill', 'loss_of_containment') THEN 'high'
        WHEN {S.found(t, R.SERIOUS_WORDING)} THEN 'moderate' WHEN injuries > 0 THEN 'moderate' ELSE 'low' END AS model_severity,
      fatalities, injuries, missing_persons, evacuated_persons, CASE WHEN {S.found(t, R.HYDROCARBON_RELEASE)} THEN TRUE END AS hydrocarbon_release,
      {clean(f"CASE WHEN {S.found(t, R.ENVIRONMENT_IMPACT)} THEN substr(raw, greatest(ep, 1), CASE WHEN ep > 0 THEN 200 ELSE 199 END) END")} AS environmental_impact,
      CASE WHEN {S.found(t, R.PRODUCTION_IMPACT)} THEN 'Production impact reported by the sources.' END AS production_impact,
      CASE WHEN {S.found(t, R.ASSET_DAMAGE)} THEN 'Damage reported by the sources.' END AS asset_damage,
      round(CASE WHEN passed THEN least(0.75, 0.4 + score / 250) ELSE 0.2 END, 6) AS extraction_confidence, list_filter(kinds[1:4], lambda k: k <> incident_type) AS kinds2,
      {S.truncate('body', 180)} AS highlights, CAST(CAST(published_at AS DATE) AS VARCHAR) AS incident_date FROM x3)"""


EX_SQL = with_sql("v_bulletin") + f", verdict AS ({_EX_VERDICT}), " + _extraction_cte()
EXTRACTION_SQL = EX_SQL + " SELECT * EXCLUDE (kinds2), array_to_string(kinds2, '|') AS secondary_incident_types FROM ex"


def consequence_flags(spark, sf):
    flags = ["production_interruption", "shutdown", "fire", "explosion", "spill", "leak", "well_control_event"]
    return extract.consequences(extracted(spark, sf)).select("id", *flags)


CONSEQUENCES_SQL = EX_SQL + """ SELECT id, CASE WHEN production_impact IS NOT NULL THEN TRUE END AS production_interruption, CASE WHEN incident_type IN ('emergency_shutdown', 'production_shutdown') THEN TRUE END AS shutdown,
  CASE WHEN incident_type = 'fire' OR list_contains(kinds2, 'fire') THEN TRUE END AS fire, CASE WHEN incident_type = 'explosion' OR list_contains(kinds2, 'explosion') THEN TRUE END AS explosion,
  CASE WHEN incident_type = 'oil_spill' OR list_contains(kinds2, 'oil_spill') THEN TRUE END AS spill, CASE WHEN incident_type IN ('gas_leak', 'oil_leak', 'pipeline_leak') THEN TRUE END AS leak,
  CASE WHEN incident_type IN ('well_control', 'blowout') THEN TRUE END AS well_control_event FROM ex"""


def entities(spark, sf):
    return provenance.entity_rows(extracted(spark, sf).withColumn("installation", F.col("asset")), ["id"])


ENTITIES_SQL = EX_SQL + f""" SELECT id, 'operator' AS entity_type, operator AS name, {S.org('operator')} AS normalized_name FROM ex WHERE operator IS NOT NULL
  UNION ALL SELECT id, 'asset', asset, {S.norm('asset')} FROM ex WHERE asset IS NOT NULL UNION ALL SELECT id, 'installation', asset, {S.norm('asset')} FROM ex WHERE asset IS NOT NULL
  UNION ALL SELECT id, 'location', country, {S.norm('country')} FROM ex WHERE country IS NOT NULL"""


def evidence(spark, sf):
    return provenance.evidence_rows(extracted(spark, sf), ["id"], "extraction_confidence").withColumn("confidence", F.col("confidence").cast("double"))


EVIDENCE_SQL = EX_SQL + " " + " UNION ALL ".join(
    f"SELECT id, '{c}' AS fact, CAST({c} AS VARCHAR) AS value, CAST(CAST(extraction_confidence AS DECIMAL(4,3)) AS DOUBLE) AS confidence FROM ex WHERE {c} IS NOT NULL"
    for c in ("operator", "asset", "incident_date", "country", "fatalities", "injuries", "well_integrity_category"))


def highlights(spark, sf):
    return provenance.highlight_rows(extracted(spark, sf), ["id"])


HIGHLIGHTS_SQL = EX_SQL + " SELECT id, 0 AS position, highlights AS text FROM ex"


# ------------------------------------------------------------------------------------------------ sources


def page_tiers(spark, sf):
    """Source tier of every page by its host, over a catalogue made of some of the hosts."""
    pages = view(spark, sf, "v_page")
    host = U.bare_host(F.col("url"))
    letter = lambda i: F.ascii(F.substring("site_host", i, 1))
    sites = pages.select(host.alias("site_host")).distinct().filter(letter(6) % 3 == 0).select(
        F.regexp_replace("site_host", "^blog\\.", "").alias("site"), (letter(7) % 3 + 1).cast("int").alias("tier"), F.col("site_host").alias("position"),
        F.col("site_host").alias("name"), (F.length("site_host") % 2 == 0).alias("is_dedicated"))
    found = catalogue.with_source(pages.select("id", "url"), catalogue.sites_by_host(sites), default_tier=5)
    return found.select("id", "source_tier", "source_name", "is_dedicated")


TIER_SQL = with_sql("v_page") + f""", h AS (SELECT id, {S.bare_host('url')} AS host FROM v_page),
  raw AS (SELECT DISTINCT host FROM h WHERE ascii(substr(host, 6, 1)) % 3 = 0),
  sites AS (SELECT regexp_replace(host, '^blog\\.', '') AS site, max(host) AS name, min(host) AS pos, arg_max(ascii(substr(host, 7, 1)) % 3 + 1, host) AS tier, arg_max(length(host) % 2 = 0, host) AS ded FROM raw GROUP BY ALL),
  m AS (SELECT id, arg_min(struct_pack(name, tier, ded), (host <> site, pos)) AS s FROM h JOIN sites ON host = site OR ends_with(host, '.' || site) GROUP BY id)
  SELECT v.id, coalesce(m.s.tier, 5) AS source_tier, m.s.name AS source_name, coalesce(m.s.ded, FALSE) AS is_dedicated FROM v_page v LEFT JOIN m ON m.id = v.id"""


def feed_documents(spark, sf):
    """One feed document per page: an RSS item (an Atom entry for every fourth page) built from its URL and markup."""
    pages = view(spark, sf, "v_page")
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600), "dd MMM yyyy HH:mm:ss")
    rss = F.concat(F.lit("<rss><channel><item><title><![CDATA["), title, F.lit("]]></title><link>"), escape(F.col("url")), F.lit("</link><description>"), escape(F.col("html")),
                   F.lit("</description><pubDate>"), when, F.lit(" GMT</pubDate><guid isPermaLink=\"false\">g"), F.col("id"), F.lit("</guid></item><item><title>no link</title></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), title, F.lit("</title><link rel=\"alternate\" href=\""), escape(F.col("url")), F.lit("\"/><summary>"), escape(F.col("html")),
                    F.lit("</summary><published>not a date</published><id>g"), F.col("id"), F.lit("</id></entry></feed>"))
    return pages.select("id", F.when(F.col("id") % 4 == 0, atom).otherwise(rss).alias("xml"))


def feed_items(spark, sf):
    """Items of the feed documents, markup decoded and stripped."""
    items = feeds.explode_feeds(feed_documents(spark, sf), "id", "xml")
    return items.select("id", "position", "title", "link", F.md5("description").alias("description_md5"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "guid")


_ENT = "{0}"
for _name, _value in feeds.ENTITIES:
    _ENT = f"regexp_replace({_ENT}, '&{_name};', {S.quote(_value)}, 'gi')"


def _plain(x: str) -> str:
    decoded = _ENT.replace("{0}", x)
    bare = f"regexp_replace({decoded}, '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_ENT.replace('{0}', bare)}, '\\s+', ' ', 'g'))"


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
FEED_SQL = with_sql("v_page") + f""", t AS (SELECT id, url, html, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM v_page)
  SELECT id, 0 AS position, {_plain('title')} AS title, url AS link, md5({_plain(_ESC.format('html'))}) AS description_md5,
  CASE WHEN id % 4 <> 0 THEN strftime(make_timestamp((1704067200 + id * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') END AS published_at, concat('g', id) AS guid FROM t"""


def _responses(spark, sf, provider: str):
    """Search responses derived from documents: one response per document, in the provider's shape."""
    docs = view(spark, sf, "v_article")
    stamp = F.coalesce(F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'"), F.lit("soon"))
    iso = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("soon"))
    url = F.when(F.col("id") % 50 == 7, F.lit("ftp://files.example.com/x")).otherwise(F.col("url"))
    name = F.when(F.col("id") % 40 == 9, F.lit("[Removed]")).otherwise(F.col("title"))
    body = {
        "event-list": F.to_json(F.struct(F.array(F.struct(url.alias("url"), F.col("title"), stamp.alias("seendate"), F.col("publisher").alias("domain"))).alias("articles"))),
        "news-value": F.to_json(F.struct(F.array(F.struct(F.col("title").alias("name"), url.alias("url"), F.col("excerpt").alias("description"), iso.alias("datePublished"),
                                                          F.when(F.col("id") % 2 == 0, F.array(F.struct(F.col("publisher").alias("name")))).alias("provider"))).alias("value"))),
        "page-map": F.to_json(F.struct(F.array(F.struct(F.col("title"), url.alias("link"), F.col("excerpt").alias("snippet"), F.lit("shown.example.com").alias("displayLink"), F.struct(F.array(
            F.create_map(F.lit("og:url"), F.coalesce("canonical_url", F.lit("none")), F.lit("date"), iso, F.lit("author"), F.col("publisher"))).alias("metatags")).alias("pagemap"))).alias("items"))),
        "article-list": F.to_json(F.struct(F.array(F.struct(F.struct(F.col("publisher").alias("name")).alias("source"), F.col("publisher").alias("author"), name.alias("title"),
                                                            F.col("excerpt").alias("description"), url.alias("url"), iso.alias("publishedAt"))).alias("articles"))),
    }[provider]
    broken = F.when(F.col("id") % 60 == 11, F.lit("{not json")).otherwise(body)
    return docs.select(F.col("language"), broken.alias("body"))


def search_responses(spark, sf):
    """All four response shapes flattened and united."""
    shapes = [search_api.event_list_shape(), search_api.news_value_shape(), search_api.page_map_shape(), search_api.article_list_shape()]
    rows = search_api.union_sources([search_api.flatten_responses(_responses(spark, sf, s.provider), s) for s in shapes])
    return rows.select("provider", "publisher", F.md5("title").alias("title_md5"), "url", "canonical_url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
                       F.md5("excerpt").alias("excerpt_md5"), "author", "language", F.col("source_tier").cast("bigint").alias("source_tier"))


_PUB = "strftime(published_at, '%Y-%m-%d %H:%M:%S')"
_OKURL = "id % 60 <> 11 AND id % 50 <> 7"
SEARCH_RESPONSES_SQL = with_sql("v_article") + f""" SELECT 'event-list' AS provider, publisher, md5(title) AS title_md5, url, NULL AS canonical_url, {_PUB} AS published_at, NULL AS excerpt_md5, NULL AS author, language, 4 AS source_tier FROM v_article WHERE {_OKURL}
  UNION ALL SELECT 'news-value', CASE WHEN id % 2 = 0 THEN publisher ELSE 'example.com' END, md5(title), url, NULL, {_PUB}, md5(substr(excerpt, 1, 600)), NULL, language, 4 FROM v_article WHERE {_OKURL}
  UNION ALL SELECT 'page-map', 'shown.example.com', md5(title), url, canonical_url, {_PUB}, md5(substr(excerpt, 1, 600)), publisher, language, 4 FROM v_article WHERE {_OKURL}
  UNION ALL SELECT 'article-list', publisher, md5(title), url, NULL, {_PUB}, md5(excerpt), publisher, language, 4 FROM v_article WHERE {_OKURL} AND id % 40 <> 9"""


def model_responses(spark, sf):
    """Model answers derived from documents: fenced, wrapped in prose, with a trailing comma or broken; accepted and rejected rows."""
    docs = view(spark, sf, "v_article")
    obj = F.to_json(F.struct(
        F.lit(True).alias("isOilAndGasRelated"), F.when(F.col("id") % 13 == 0, F.lit("sideways")).otherwise(F.lit("upstream")).alias("oilAndGasSector"), F.lit(0.5).alias("confidence"),
        F.col("title"), F.concat(F.lit("About {braces} and "), "publisher").alias("summary"), F.array("publisher", "language").alias("highlights"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-02-28")).alias("incidentDate"),
        F.when(F.col("id") % 4 == 0, F.lit("N/A")).when(F.col("id") % 4 == 1, F.lit("unknown")).otherwise(F.lit(" Norway ")).alias("country"),
        F.when(F.col("id") % 5 == 0, F.lit("no")).otherwise(F.lit("NO")).alias("countryCode"), F.when(F.col("id") % 2 == 0, F.lit("null")).otherwise(F.lit("fire")).alias("incidentType"),
        F.col("id").alias("injuries"), F.lit(None).cast("int").alias("fatalities"), F.lit("unknown").alias("environment"), F.lit("teleport").alias("wellType")))
    text = (F.when(F.col("id") % 7 == 1, F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n``` done")))
            .when(F.col("id") % 7 == 2, F.concat(F.lit("Sure. "), obj, F.lit(" Hope that helps {really}")))
            .when(F.col("id") % 7 == 3, F.concat(F.expr("substr('x', 1, 0)"), F.substring(obj, F.lit(1), F.length(obj) - 1), F.lit(",}")))
            .when(F.col("id") % 7 == 4, F.substring(obj, F.lit(1), F.length(obj) - 1)).otherwise(obj))
    done = responses.ingest_responses(docs.select("id", text.alias("raw")), "id", "raw")
    return done.select("id", F.array_join("violations", "|").alias("violations"), F.md5("title").alias("title_md5"), "summary", F.array_join("highlights", "|").alias("highlights"),
                       F.col("incidentDate").cast("string").alias("incident_date"), "country", "countryCode", "incidentType", F.col("injuries").cast("bigint").alias("injuries"),
                       F.col("fatalities").cast("bigint").alias("fatalities"), "environment", "wellType")


RESPONSES_SQL = with_sql("v_article") + """ SELECT id, CASE WHEN id % 7 = 4 THEN 'json|isOilAndGasRelated|oilAndGasSector|confidence|title|summary' WHEN id % 13 = 0 THEN 'oilAndGasSector' ELSE '' END AS violations,
  CASE WHEN id % 7 <> 4 THEN md5(trim(title)) END AS title_md5, CASE WHEN id % 7 <> 4 THEN concat('About {braces} and ', publisher) END AS summary,
  CASE WHEN id % 7 <> 4 THEN concat(publisher, '|', language) ELSE '' END AS highlights, CASE WHEN id % 7 <> 4 AND id % 3 <> 0 THEN '2024-02-28' END AS incident_date,
  CASE WHEN id % 7 <> 4 AND id % 4 > 1 THEN 'Norway' END AS country, CASE WHEN id % 7 <> 4 AND id % 5 <> 0 THEN 'NO' END AS "countryCode", CASE WHEN id % 7 <> 4 AND id % 2 = 1 THEN 'fire' ELSE 'other' END AS "incidentType",
  CASE WHEN id % 7 <> 4 THEN id END AS injuries, CAST(NULL AS BIGINT) AS fatalities, 'unknown' AS environment, CAST(NULL AS VARCHAR) AS "wellType" FROM v_article"""


def validation(spark, sf):
    """Incidents with the checks they violate; strict rows go to quarantine."""
    broken = view(spark, sf, "v_incident").withColumns({
        "severity_score": F.when(F.col("id") % 10 == 0, F.lit(101)).otherwise(F.col("severity_score")),
        "country_code": F.when(F.col("id") % 7 == 0, F.lower("country_code")).otherwise(F.col("country_code")),
        "injuries": F.when(F.col("id") % 9 == 0, F.lit(-1)).otherwise(F.col("injuries"))})
    good, bad = schemas.split_valid(broken, schemas.incident_checks())
    return bad.select("id", F.array_join("violations", "|").alias("violations")).unionByName(good.select("id", F.lit("").alias("violations")))


VALIDATION_SQL = with_sql("v_incident") + """ SELECT id, concat_ws('|', CASE WHEN id % 7 = 0 AND country_code IS NOT NULL THEN 'country_code' END,
  CASE WHEN id % 10 = 0 OR severity_score > 100 THEN 'severity_score' END, CASE WHEN id % 9 = 0 THEN 'injuries' END) AS violations FROM v_incident"""


def raw_quarantine(spark, sf):
    """Bulletins as provider rows: violations of the raw article checks, per name."""
    rows = view(spark, sf, "v_bulletin").withColumns({
        "provider": F.when(F.col("id") % 21 == 0, F.lit("")).otherwise(F.lit("wire")),
        "language": F.when(F.col("id") % 8 == 0, F.lit("xx")).otherwise(F.col("language")),
        "url": F.when(F.col("id") % 12 == 0, F.lit("javascript:alert(1)")).otherwise(F.col("url"))})
    return schemas.validate(rows, schemas.raw_article_checks()).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


RAW_SQL = """SELECT * FROM (SELECT 'provider' AS violation, count(*) FILTER (WHERE o_orderkey % 21 = 0) AS n FROM orders UNION ALL SELECT 'language', count(*) FILTER (WHERE o_orderkey % 8 = 0) FROM orders
  UNION ALL SELECT 'url', count(*) FILTER (WHERE o_orderkey % 12 = 0) FROM orders)"""

def raw_files(spark, sf):
    """Bulletins as files of JSON lines, some cut off or without a title, read again: what is good, what is in quarantine."""
    rows = view(spark, sf, "v_bulletin").select("id", F.to_json(F.struct(
        F.col("id").cast("string").alias("provider"), "publisher", F.when(F.col("id") % 40 == 3, "").otherwise(F.col("title")).alias("title"), "url",
        F.col("source_tier").alias("source_tier"), F.lit("en").alias("language"))).alias("value"))
    folder = f"{checkpoint_root(spark)}/factweave/raw-{uuid.uuid4().hex}"
    rows.select(F.when(F.col("id") % 50 == 7, F.substring("value", 1, 30)).otherwise(F.col("value")).alias("value")).write.text(folder)
    good, _ = raw.scan_raw_articles(spark, folder)
    kept = good.select(F.lit("good").alias("kind"), F.col("provider").cast("bigint").alias("id"), F.lit("").alias("violations"))
    bad = raw.quarantine(spark, folder).select("kind", F.regexp_extract("text", '"provider":"([0-9]+)', 1).cast("bigint").alias("id"), F.array_join("violations", "|").alias("violations"))
    return kept.unionByName(bad)


RAW_FILES_SQL = with_sql("v_bulletin") + """ SELECT CASE WHEN id % 50 = 7 THEN 'line' WHEN id % 40 = 3 THEN 'record' ELSE 'good' END AS kind, id,
  CASE WHEN id % 50 = 7 THEN 'broken_line' WHEN id % 40 = 3 THEN 'title' ELSE '' END AS violations FROM v_bulletin"""


QUERIES = {
    "text_keys": (text_keys, TEXT_KEYS_SQL),
    "text_organisation_names": (organisation_names, ORG_SQL),
    "url_keys": (url_keys, URL_SQL),
    "text_similarity": (similarity_pairs, SIMILARITY_SQL),
    "user_identity_keys": (user_keys, USER_KEYS_SQL),
    "scan_publication_window": (publication_window, PUBLICATION_SQL),
    "relevance_bulletins": (relevance_bulletins, _BULLETIN_SQL),
    "relevance_languages": (relevance_languages, LANGUAGES_SQL),
    "relevance_articles": (relevance_articles, _verdict_sql("v_article", PROSE_TERMS)),
    "relevance_classifier": (classifier, CLASSIFIER_SQL),
    "region_match": (region_match, REGION_SQL),
    "extraction": (extraction, EXTRACTION_SQL),
    "extraction_consequences": (consequence_flags, CONSEQUENCES_SQL),
    "provenance_entities": (entities, ENTITIES_SQL),
    "provenance_evidence": (evidence, EVIDENCE_SQL),
    "provenance_highlights": (highlights, HIGHLIGHTS_SQL),
    "source_tier_by_host": (page_tiers, TIER_SQL),
    "source_feed_items": (feed_items, FEED_SQL),
    "source_search_responses": (search_responses, SEARCH_RESPONSES_SQL),
    "source_model_responses": (model_responses, RESPONSES_SQL),
    "validation_quarantine": (validation, VALIDATION_SQL),
    "validation_raw_articles": (raw_quarantine, RAW_SQL),
    "source_raw_files": (raw_files, RAW_FILES_SQL),
}
