"""Deduplication, linkage, scores, versions, alerts, users, runs and stores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from factweave.operators import alerts, changes, dedup, linkage, provenance, runs, saved_queries, scoring, store, users
from factweave.operators.skew import keep_first, salted_join
from workload import sqlparts as S
from workload.feed_queries import SECONDARY, TODAY, current_states, inc_sql, incidents, _STATES_SQL
from workload.views import pick, table, view, with_sql

# ------------------------------------------------------------------------------------------------ deduplication


def exact_duplicates(spark, sf):
    """Earliest bulletin with the same URL or content key."""
    return dedup.exact_duplicates(view(spark, sf, "v_bulletin"))


def _keys_sql(v: str) -> str:
    return f"""k AS (SELECT seq, published_at, {S.normalise_url('canonical_url')} AS canonical_key, {S.normalise_url('coalesce(canonical_url, url)')} AS normalized_url,
      md5(concat({S.norm('title')}, ' ', {S.norm("coalesce(excerpt, '')")})) AS content_hash, md5(array_to_string(list_sort({S.tokens('title')}), ' ')) AS title_hash,
      nullif({S.org('publisher')}, '') AS pub, {S.publisher_host('url')} AS host, {S.token_set('title')} AS toks FROM {v})"""


EXACT_SQL = with_sql("v_bulletin") + ", " + _keys_sql("v_bulletin") + """, c AS (SELECT seq, 0 AS rank, 'canonical_url' AS reason, min(seq) OVER (PARTITION BY canonical_key) AS m FROM k WHERE canonical_key IS NOT NULL
  UNION ALL SELECT seq, 1, 'normalized_url', min(seq) OVER (PARTITION BY normalized_url) FROM k UNION ALL SELECT seq, 2, 'content_hash', min(seq) OVER (PARTITION BY content_hash) FROM k)
  SELECT seq, min(m) AS matched_seq, arg_min(reason, (m, rank)) AS reason FROM c WHERE m < seq GROUP BY seq"""


def first_wins(spark, sf):
    """Keep or drop every document in arrival order, with the rule and the article it repeats."""
    return dedup.first_wins(view(spark, sf, "v_article")).withColumn("similarity", F.round("similarity", 6))


_EDGES = f"""{_keys_sql('v_article')}, p AS (SELECT a.seq, b.seq AS other, a.*, b.canonical_key AS c2, b.normalized_url AS n2, b.content_hash AS h2, b.title_hash AS t2, b.pub AS p2, b.host AS o2, b.toks AS k2,
    abs(epoch(a.published_at) - epoch(b.published_at)) AS gap, length(list_intersect(a.toks, b.toks)) AS i FROM k a JOIN k b ON b.seq < a.seq),
  e AS (SELECT seq, other, CASE WHEN canonical_key = c2 THEN 'canonical_url' WHEN normalized_url = n2 THEN 'normalized_url' WHEN content_hash = h2 THEN 'content_hash'
      WHEN title_hash = t2 AND (pub = p2 OR host = o2) AND (gap IS NULL OR gap <= 604800) THEN 'title_hash_same_publisher'
      WHEN (gap IS NULL OR gap <= 172800) AND ((length(toks) = 0 AND length(k2) = 0) OR (length(toks) > 0 AND length(k2) > 0 AND i * 19 >= least(length(toks), length(k2)) * 17)) THEN 'fuzzy_syndication' END AS reason,
      CASE WHEN length(toks) = 0 AND length(k2) = 0 THEN 1.0 ELSE greatest(i / (length(toks) + length(k2) - i), 0.95 * i / least(length(toks), length(k2))) END AS sim FROM p)"""
FIRST_WINS_SQL = with_sql("v_article").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_EDGES}, edges AS MATERIALIZED (SELECT * FROM e WHERE reason IS NOT NULL),
  nb AS MATERIALIZED (SELECT k.seq, row_number() OVER (ORDER BY k.seq) AS step, coalesce((SELECT list(other ORDER BY other) FROM edges x WHERE x.seq = k.seq), []) AS others FROM k),
  walk AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS kept
    UNION ALL SELECT nb.step, CASE WHEN list_has_any(walk.kept, nb.others) THEN walk.kept ELSE list_append(walk.kept, nb.seq) END FROM walk JOIN nb ON nb.step = walk.step + 1),
  final AS (SELECT unnest(kept) AS seq FROM walk WHERE step = (SELECT max(step) FROM walk)),
  hit AS (SELECT x.seq, arg_min(struct_pack(reason, other, sim), other) AS h FROM edges x JOIN final f ON f.seq = x.other WHERE x.seq NOT IN (SELECT seq FROM final) GROUP BY x.seq)
  SELECT k.seq, h.h.reason IS NOT NULL AS is_duplicate, h.h.reason AS reason, h.h.other AS matched_seq, round(CASE WHEN h.h.reason = 'fuzzy_syndication' THEN h.h.sim WHEN h.h.reason IS NOT NULL THEN 1.0 END, 6) AS similarity
  FROM k LEFT JOIN hit h ON h.seq = k.seq"""


def similar_headlines(spark, sf):
    """Pairs of distinct document headlines that repeat each other within two days."""
    keyed = dedup.with_dedup_keys(view(spark, sf, "v_article"))
    bucket = F.floor(F.unix_timestamp(F.col("published_at").cast("timestamp")) / dedup.FUZZY_WINDOW_SECONDS)
    sets = keyed.select(F.array_join("headline_tokens", " ").alias("set_id"), F.col("headline_tokens").alias("tokens"), bucket.alias("bucket"), F.lit(True).alias("fresh")).distinct()
    pairs = dedup.similar_headlines(sets)
    return pairs.select(F.md5(F.least("a", "b")).alias("one"), F.md5(F.greatest("a", "b")).alias("other"), F.round("similarity", 6).alias("similarity"))


SIMILAR_SQL = with_sql("v_article") + ", " + _keys_sql("v_article") + """, s AS (SELECT DISTINCT array_to_string(toks, ' ') AS id, toks, floor(epoch(published_at) / 172800) AS b FROM k WHERE length(toks) > 0),
  p AS (SELECT DISTINCT x.id AS a, y.id AS c, x.toks AS tx, y.toks AS ty FROM s x JOIN s y ON x.id < y.id AND (x.b IS NULL OR y.b IS NULL OR abs(x.b - y.b) <= 1)),
  q AS (SELECT *, length(list_intersect(tx, ty)) AS i FROM p)
  SELECT md5(a) AS one, md5(c) AS other, round(greatest(i / (length(tx) + length(ty) - i), 0.95 * i / least(length(tx), length(ty))), 6) AS similarity FROM q WHERE i * 19 >= least(length(tx), length(ty)) * 17"""


def known_lookup(spark, sf):
    """Stored bulletins that share a key with an incoming batch (every third bulletin is the batch)."""
    rows = dedup.with_dedup_keys(view(spark, sf, "v_bulletin"))
    return dedup.known_articles(rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0")).select("id")


KNOWN_SQL = with_sql("v_bulletin") + f""", k AS (SELECT id, canonical_url, {S.normalise_url('coalesce(canonical_url, url)')} AS n, md5(concat({S.norm('title')}, ' ', {S.norm("coalesce(excerpt, '')")})) AS c,
    md5(array_to_string(list_sort({S.tokens('title')}), ' ')) AS t FROM v_bulletin), b AS (SELECT * FROM k WHERE id % 3 = 0)
  SELECT id FROM k WHERE id % 3 <> 0 AND (n IN (SELECT n FROM b) OR c IN (SELECT c FROM b) OR t IN (SELECT t FROM b) OR canonical_url IN (SELECT canonical_url FROM b WHERE canonical_url IS NOT NULL))"""


# ------------------------------------------------------------------------------------------------ linkage


def _sides(spark, sf):
    base = view(spark, sf, "v_incident").withColumn("entities", F.filter(F.array("vessel", "drilling_contractor", "service_company"), lambda x: x.isNotNull()))
    return base.filter("status = 'under_review'"), base.filter("status <> 'under_review'")


def link_candidates(spark, sf):
    """Pairs worth scoring: how many per candidate."""
    cands, stored = _sides(spark, sf)
    pairs, lefts, rights = linkage.candidate_classes(linkage.stored_facts(cands, "id", "position"), linkage.stored_facts(stored, "id", "position"), F.lit(TODAY).cast("date"))
    sums = rights.groupBy("b_class").agg(F.count(F.lit(1)).alias("n"), F.sum("b.key").alias("keys"))
    met = pairs.join(sums, "b_class").groupBy("a_class").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))
    per = salted_join(lefts.select("a_class", F.col("a.key").alias("id")), met, "a_class", "id")
    return per.groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.sum("keys").alias("checksum"))


_BLOCK = f"""((b.incident_date IS NULL) OR (b.incident_date BETWEEN coalesce(a.incident_date, DATE '{TODAY}') - (CASE WHEN a.incident_date IS NULL THEN 8 ELSE 7 END)
  AND coalesce(a.incident_date, DATE '{TODAY}') + (CASE WHEN a.incident_date IS NULL THEN 8 ELSE 7 END))) AND (a.country_code IS NULL OR b.country_code IS NULL OR a.country_code = b.country_code)"""
LINK_CANDIDATES_SQL = with_sql("v_incident") + f""", c AS (SELECT * FROM v_incident WHERE status = 'under_review'), s AS (SELECT * FROM v_incident WHERE status <> 'under_review')
  SELECT a.id, count(*) AS pairs, CAST(sum(b.id) AS BIGINT) AS checksum FROM c a JOIN s b ON {_BLOCK} GROUP BY a.id"""


def best_match(spark, sf):
    """Best stored incident per candidate, its decision, and whether the tie-break accepts it."""
    cands, stored = _sides(spark, sf)
    best = linkage.link_to_incidents(cands, stored, date.fromisoformat(TODAY))
    return best.select("candidate", "incident", F.round("score", 6).alias("score"), "decision", "accepted")


def _match_sql(cand: str, other: str, extra: str = "TRUE") -> str:
    facts = f"""f AS (SELECT id, status, incident_date, country_code, {S.norm('country')} AS country, nullif({S.org('operator')}, '') AS operator, nullif({S.org('coalesce(operator, company)')}, '') AS party,
        nullif({S.norm('asset')}, '') AS asset, nullif({S.norm('installation')}, '') AS inst, nullif({S.norm('field')}, '') AS field, nullif({S.norm('well_name')}, '') AS well, incident_type, {S.token_set('title')} AS toks,
        list_transform(list_filter([vessel, drilling_contractor, service_company], lambda x: x IS NOT NULL), lambda x: {S.norm('x')}) AS ents FROM v_incident)"""
    pairs = [("well", "well"), ("asset", "asset"), ("inst", "inst"), ("field", "field"), ("asset", "inst"), ("inst", "asset")]
    asset = "greatest(" + ", ".join(S.name_similarity(f"a.{x}", f"b.{y}") for x, y in pairs) + ")"
    operator = f"greatest({S.name_similarity('a.operator', 'b.operator')}, {S.name_similarity('a.party', 'b.party')})"
    weights = {"date": 0.2, "country": 0.15, "operator": 0.2, "asset": 0.2, "type": 0.1, "headline": 0.1, "ents": 0.05}
    total = " + ".join(f"coalesce(s_{k}, 0.0) * {w}" for k, w in weights.items())
    weight = " + ".join(f"CASE WHEN s_{k} IS NULL THEN 0.0 ELSE {w} END" for k, w in weights.items())
    return f"""{facts},
      p AS (SELECT a.id AS candidate, b.id AS incident, CASE abs(date_diff('day', a.incident_date, b.incident_date)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.85 WHEN 3 THEN 0.55 WHEN 4 THEN 0.55 ELSE CASE WHEN a.incident_date IS NOT NULL AND b.incident_date IS NOT NULL THEN 0.3 END END AS s_date,
          CASE WHEN a.country = b.country THEN 1.0 END AS s_country, {operator} AS s_operator, {asset} AS s_asset, CASE WHEN a.incident_type = b.incident_type THEN 1.0 ELSE 0.2 END AS s_type, {S.headline_similarity('a.toks', 'b.toks')} AS s_headline,
          CASE WHEN length(a.ents) > 0 AND length(b.ents) > 0 THEN length(list_filter(a.ents, lambda x: list_contains(b.ents, x))) / least(length(a.ents), length(b.ents)) END AS s_ents
        FROM f a JOIN f b ON {_BLOCK} AND {cand} AND {other} AND {extra} WHERE NOT coalesce(a.country <> b.country, FALSE)),
      q AS (SELECT *, round(CAST(({total}) AS DOUBLE) / greatest({weight}, 0.75), 9) AS score FROM p),
      r AS (SELECT *, CASE WHEN (coalesce(s_asset >= 0.95, FALSE) AND coalesce(s_date >= 0.85, FALSE)) OR score >= 0.72 THEN 'same' WHEN score >= 0.55 OR (s_headline >= 0.75 AND coalesce(s_date >= 0.85, FALSE)) THEN 'review' ELSE 'different' END AS decision FROM q),
      t AS (SELECT *, decision = 'same' OR (decision = 'review' AND s_headline >= 0.7) AS accepted FROM r WHERE NOT (decision = 'different' AND score = 0))"""


BEST_MATCH_SQL = with_sql("v_incident") + ", " + _match_sql("a.status = 'under_review'", "b.status <> 'under_review'") + """
  SELECT candidate, arg_min(incident, (-score, incident)) AS incident, round(max(score), 6) AS score, arg_min(decision, (-score, incident)) AS decision, arg_min(accepted, (-score, incident)) AS accepted FROM t GROUP BY candidate"""


def batch_groups(spark, sf):
    """New candidates grouped among themselves in arrival order: each one's leader."""
    cands, _ = _sides(spark, sf)
    return linkage.group_batch(cands, date.fromisoformat(TODAY))


BATCH_GROUPS_SQL = with_sql("v_incident").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _match_sql("a.status = 'under_review'", "b.status = 'under_review'", "b.id < a.id").replace("\n      t AS (", "\n      t AS MATERIALIZED (") + """,
  n AS MATERIALIZED (SELECT f.id, row_number() OVER (ORDER BY f.id) AS step, coalesce(any_value(o.options), []) AS options FROM f
    LEFT JOIN (SELECT candidate, list(struct_pack(p := incident, ok := accepted) ORDER BY -score, incident) AS options FROM t GROUP BY candidate) o ON o.candidate = f.id WHERE f.status = 'under_review' GROUP BY f.id),
  walk AS (SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS candidate, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS leaders
    UNION ALL SELECT step, id, CASE WHEN best.ok THEN best.p ELSE id END, CASE WHEN best.ok THEN leaders ELSE list_append(leaders, id) END
    FROM (SELECT n.step, n.id, w.leaders, list_filter(n.options, lambda x: list_contains(w.leaders, x.p))[1] AS best FROM walk w JOIN n ON n.step = w.step + 1))
  SELECT candidate, leader FROM walk WHERE step > 0"""


# ------------------------------------------------------------------------------------------------ scores


def severity(spark, sf):
    return scoring.score_severity(incidents(spark, sf).drop("severity_score", "severity")).select(
        "id", "severity_rule_score", "severity_score", "severity", F.array_join("severity_factors", "|").alias("factors"))


def _severity_sql():
    kinds = f"list_concat([incident_type], {SECONDARY})"
    rules = [
        ("CASE WHEN fatalities >= 5 THEN 75 WHEN fatalities > 1 THEN 60 WHEN fatalities = 1 THEN 45 ELSE 0 END", "CASE WHEN fatalities > 1 THEN concat(fatalities, ' fatalities reported') WHEN fatalities = 1 THEN '1 fatality reported' END"),
        ("CASE WHEN missing_persons > 0 THEN least(30, 15 + missing_persons * 5) ELSE 0 END", "CASE WHEN missing_persons > 0 THEN concat(missing_persons, ' person(s) missing') END"),
        ("CASE WHEN injuries >= 10 THEN 28 WHEN injuries >= 3 THEN 18 WHEN injuries > 0 THEN 10 ELSE 0 END", "CASE WHEN injuries >= 3 THEN concat(injuries, ' injuries reported') WHEN injuries > 0 THEN concat(injuries, ' injury/injuries reported') END"),
        ("CASE WHEN evacuated_persons >= 100 THEN 18 WHEN evacuated_persons > 0 THEN 10 ELSE 0 END", "CASE WHEN evacuated_persons > 0 THEN concat(evacuated_persons, ' people evacuated') END"),
        (f"CASE WHEN list_has_any({kinds}, ['blowout', 'explosion', 'well_control']) THEN 25 WHEN list_has_any({kinds}, ['fire', 'loss_of_containment', 'hydrocarbon_release', 'toxic_gas_release', 'pipeline_rupture', 'oil_spill', 'well_integrity', 'structural_failure']) THEN 15 ELSE 0 END",
         f"CASE WHEN list_has_any({kinds}, ['blowout', 'explosion', 'well_control']) THEN 'Loss of well control / explosion class event' WHEN list_has_any({kinds}, ['fire', 'loss_of_containment', 'hydrocarbon_release', 'toxic_gas_release', 'pipeline_rupture', 'oil_spill', 'well_integrity', 'structural_failure']) THEN 'Major hazard event class' END"),
        ("CASE WHEN explosion THEN 12 ELSE 0 END", "CASE WHEN explosion THEN 'Explosion confirmed' END"),
        ("CASE WHEN fire THEN 8 ELSE 0 END", "CASE WHEN fire THEN 'Fire confirmed' END"),
        ("CASE WHEN hydrocarbon_release THEN 10 ELSE 0 END", "CASE WHEN hydrocarbon_release THEN 'Hydrocarbon release confirmed' END"),
        ("CASE WHEN spill THEN 8 ELSE 0 END", "CASE WHEN spill THEN 'Spill confirmed' END"),
        ("CASE WHEN well_integrity_category = 'multiple_barrier_failure' THEN 20 WHEN well_integrity_category IN ('primary_barrier_failure', 'secondary_barrier_failure') THEN 12 WHEN is_well_integrity_related THEN 8 ELSE 0 END",
         "CASE WHEN well_integrity_category = 'multiple_barrier_failure' THEN 'Multiple barrier failure' WHEN well_integrity_category IN ('primary_barrier_failure', 'secondary_barrier_failure') THEN 'Well barrier failure' WHEN is_well_integrity_related THEN 'Well integrity involved' END"),
        ("CASE WHEN is_process_safety_event THEN 6 ELSE 0 END", "CASE WHEN is_process_safety_event THEN 'Process safety event' END"),
        ("CASE WHEN trim(environmental_impact) <> '' THEN CASE WHEN regexp_matches(environmental_impact, '(?i)major|significant|large|widespread|severe|thousands|barrels') THEN 14 ELSE 6 END ELSE 0 END",
         "CASE WHEN trim(environmental_impact) <> '' THEN CASE WHEN regexp_matches(environmental_impact, '(?i)major|significant|large|widespread|severe|thousands|barrels') THEN 'Major environmental impact reported' ELSE 'Environmental impact reported' END END"),
        ("CASE WHEN shutdown THEN 6 ELSE 0 END", "CASE WHEN shutdown THEN 'Shutdown' END"),
        ("CASE WHEN trim(production_impact) <> '' THEN 4 ELSE 0 END", "CASE WHEN trim(production_impact) <> '' THEN 'Production affected' END"),
    ]
    return with_sql("v_incident") + f""", r AS (SELECT id, model_severity, CAST(least(100, greatest(0, 10 + {' + '.join(p for p, _ in rules)})) AS INT) AS rs, concat_ws('|', {', '.join(w for _, w in rules)}) AS factors FROM v_incident),
      b AS (SELECT *, CAST(CASE WHEN model_severity IS NULL THEN rs ELSE floor(rs * 0.75 + CASE model_severity WHEN 'low' THEN 20 WHEN 'moderate' THEN 45 WHEN 'high' THEN 70 ELSE 90 END * 0.25 + 0.5) END AS INT) AS s FROM r)
      SELECT id, rs AS severity_rule_score, s AS severity_score, CASE WHEN s >= 80 THEN 'critical' WHEN s >= 60 THEN 'high' WHEN s >= 35 THEN 'moderate' ELSE 'low' END AS severity, factors FROM b"""


def confidence(spark, sf):
    """Confidence of every incident from its sources, agreement and completeness."""
    base = incidents(spark, sf)
    records = view(spark, sf, "v_evidence").select("incident_id", "publisher", F.col("excerpt").substr(1, 4).alias("kind"))
    agreement = scoring.cross_source_agreement(records, "incident_id", ["publisher", "kind"]).withColumnRenamed("incident_id", "id")
    joined = base.join(agreement, "id", "left").withColumn("completeness", scoring.data_completeness())
    args = (F.col("highest_source_tier"), F.col("source_count"), F.coalesce("strong_sources", F.lit(0)), F.col("agreement"), F.col("completeness"))
    model = F.when(F.col("id") % 4 != 0, (F.col("id") % 100) / 100)
    score = scoring.confidence_score(*args, model, F.col("id") % 2 == 0)
    return joined.withColumn("s", score).select(
        "id", F.round("completeness", 6).alias("completeness"), F.round("agreement", 6).alias("agreement"), F.col("s").alias("score"), scoring.confidence_band(F.col("s")).alias("band"),
        F.array_join(scoring.confidence_factors(*args, F.col("id") % 2 == 0), "|").alias("factors"))


_PRESENT = " + ".join(f"CASE WHEN CAST({c} AS VARCHAR) NOT IN ('', 'unknown') THEN 1 ELSE 0 END" for c in scoring.COMPLETENESS_FIELDS)
CONFIDENCE_SQL = inc_sql() + f""", ag AS (SELECT incident_id, count(*) AS n, count(publisher) AS n1, count(DISTINCT lower(trim(publisher))) AS d1, count(nullif(substr(excerpt, 1, 4), '')) AS n2, count(DISTINCT lower(trim(nullif(substr(excerpt, 1, 4), '')))) AS d2 FROM v_evidence GROUP BY incident_id),
  st AS (SELECT incident_id, count(*) FILTER (WHERE source_tier <= 2) AS strong FROM v_evidence GROUP BY incident_id),
  x AS (SELECT inc.*, ({_PRESENT}) / 9 AS comp, CASE WHEN ag.n >= 2 AND (n1 >= 2 OR n2 >= 2) THEN (CASE WHEN n1 >= 2 AND d1 = 1 THEN 1 ELSE 0 END + CASE WHEN n2 >= 2 AND d2 = 1 THEN 1 ELSE 0 END) / (CASE WHEN n1 >= 2 THEN 1 ELSE 0 END + CASE WHEN n2 >= 2 THEN 1 ELSE 0 END) END AS agr,
      coalesce(st.strong, 0) AS strong, greatest(1, inc.source_count) AS pubs, CASE WHEN id % 4 <> 0 THEN (id % 100) / 100 END AS model FROM inc LEFT JOIN ag ON ag.incident_id = id LEFT JOIN st ON st.incident_id = id),
  y AS (SELECT *, CAST(least(100, greatest(0, CASE highest_source_tier WHEN 1 THEN 45 WHEN 2 THEN 32 WHEN 3 THEN 25 WHEN 4 THEN 14 ELSE 5 END + CASE WHEN pubs >= 4 THEN 18 WHEN pubs = 3 THEN 13 WHEN pubs = 2 THEN 8 ELSE -5 END
      + CASE WHEN strong >= 2 THEN 6 ELSE 0 END + coalesce(floor((agr - 0.5) * 24 + 0.5), 0) + floor(comp * 14 + 0.5) + CASE WHEN id % 2 = 0 THEN 4 ELSE 0 END + coalesce(floor((model - 0.5) * 16 + 0.5), 0))) AS INT) AS s FROM x)
  SELECT id, round(comp, 6) AS completeness, round(agr, 6) AS agreement, s AS score, CASE WHEN s >= 75 THEN 'high' WHEN s >= 50 THEN 'medium' ELSE 'low' END AS band,
    concat_ws('|', CASE WHEN highest_source_tier = 1 THEN 'Official regulator or operator source present' ELSE concat('Best available source is tier ', highest_source_tier) END,
      CASE WHEN pubs >= 2 THEN concat(pubs, ' independent publishers') ELSE 'Single source only' END, CASE WHEN strong >= 2 THEN 'Multiple high-authority sources' END,
      CASE WHEN agr >= 0.8 THEN 'Sources agree on the key facts' WHEN agr < 0.5 THEN 'Sources disagree on some facts' END,
      CASE WHEN comp >= 0.7 THEN 'Structured data is largely complete' WHEN comp < 0.35 THEN 'Few structured details available' END, CASE WHEN id % 2 = 0 THEN 'Per-field provenance recorded' END) AS factors FROM y"""


def relevance_score(spark, sf):
    base = incidents(spark, sf).drop("relevance_score")
    age = F.abs(F.datediff(F.lit(TODAY).cast("date"), F.col("incident_date")))
    related = F.when(F.col("id") % 15 == 0, F.lit(False)).when(F.col("id") % 15 < 12, F.lit(True))
    parts = scoring.relevance_components(F.col("confidence_score"), F.when(F.col("id") % 3 != 0, (F.col("id") % 20) / 20), F.col("oil_gas_sector"), F.col("highest_source_tier"), age,
                                         F.col("country") == "NATION_1", (F.col("id") % 7).cast("int"), F.col("id") % 2 == 0)
    return scoring.score_relevance(base, parts, related).select("id", "relevance_score", "outcome", "relevance_reason")


RELEVANCE_SCORE_SQL = inc_sql() + f""", c AS (SELECT id, CASE WHEN id % 15 = 0 THEN TRUE ELSE FALSE END AS veto, confidence_score / 100 * 20 + CASE WHEN id % 3 <> 0 THEN (id % 20) / 20 * 15 ELSE 8.0 END AS p0, least(id % 7, 4) * 2.5 + CASE WHEN id % 2 = 0 THEN 5.0 ELSE 0.0 END AS p1,
    CASE oil_gas_sector WHEN 'unknown' THEN 2.0 WHEN 'integrated' THEN 7.0 ELSE 10.0 END AS p2, CASE highest_source_tier WHEN 1 THEN 20.0 WHEN 2 THEN 16.0 WHEN 3 THEN 14.0 WHEN 4 THEN 8.0 ELSE 4.0 END AS p3,
    CASE WHEN incident_date IS NULL THEN 5.0 WHEN abs(date_diff('day', incident_date, DATE '{TODAY}')) <= 1 THEN 12.0 WHEN abs(date_diff('day', incident_date, DATE '{TODAY}')) <= 7 THEN 10.0 WHEN abs(date_diff('day', incident_date, DATE '{TODAY}')) <= 14 THEN 8.0
      WHEN abs(date_diff('day', incident_date, DATE '{TODAY}')) <= 30 THEN 6.0 ELSE 2.0 END AS p4, CASE WHEN country = 'NATION_1' THEN 8.0 ELSE 4.0 END AS p5 FROM inc),
  s AS (SELECT *, CAST(CASE WHEN veto THEN 0 ELSE least(100, floor(round(CAST(p0 + p1 + p2 + p3 + p4 + p5 AS DOUBLE), 9) + 0.5)) END AS INT) AS rs FROM c),
  o AS (SELECT *, CASE WHEN veto THEN 'reject' WHEN rs >= 70 THEN 'feed' WHEN rs >= 50 THEN 'review' ELSE 'reject' END AS outcome FROM s),
  l AS (SELECT id, unnest([struct_pack(v := p0, i := 0, n := 'oilGasRelevance'), struct_pack(v := p1, i := 1, n := 'incidentTerminology'), struct_pack(v := p2, i := 2, n := 'sectorRelevance'), struct_pack(v := p3, i := 3, n := 'sourceQuality'), struct_pack(v := p4, i := 4, n := 'recency'), struct_pack(v := p5, i := 5, n := 'locationRelevance')]) AS e FROM s),
  k AS (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY e.v DESC, e.i) AS r FROM l), t AS (SELECT id, string_agg(concat(e.n, '=', CAST(floor(e.v + 0.5) AS BIGINT)), ', ' ORDER BY r) AS top FROM k WHERE r <= 3 GROUP BY id)
  SELECT o.id, rs AS relevance_score, outcome, CASE WHEN veto THEN 'The Oil & Gas relevance classifier rejected the article.' ELSE concat('Relevance ', rs, '/100 (', top, ') -> ', outcome, '.') END AS relevance_reason FROM o JOIN t ON t.id = o.id"""


# ------------------------------------------------------------------------------------------------ versions

_ORDER = ["seen_at", "event_id"]
_LATEST = [c for c in changes.SNAPSHOT_COLUMNS if c != "incident_date"]


def merged(spark, sf):
    return changes.merge_versions(view(spark, sf, "v_version"), "incident_id", "day", _ORDER, latest=_LATEST)


def merged_versions(spark, sf):
    """State of every fact after each of its versions."""
    return merged(spark, sf).select("event_id", "fatalities", "injuries", "operator", "asset", "shutdown", "severity_score", "well_integrity_category", "relevance_score",
                                    "incident_type", F.col("incident_date").cast("string").alias("incident_date"))


_W = "(PARTITION BY incident_id ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_MERGED_CTE = f""", m AS (SELECT incident_id, event_id, seen_at, {', '.join(f'last_value({c} IGNORE NULLS) OVER {_W} AS {c}' for c in _LATEST)}, first_value(incident_date IGNORE NULLS) OVER {_W} AS incident_date,
  first_value(incident_type IGNORE NULLS) OVER {_W} AS incident_type, max(relevance_score) OVER {_W} AS relevance_score FROM v_version)"""
MERGED_SQL = with_sql("v_version") + _MERGED_CTE + """ SELECT event_id, fatalities, injuries, operator, asset, shutdown, severity_score, well_integrity_category, relevance_score, incident_type, CAST(incident_date AS VARCHAR) AS incident_date FROM m"""


def material(spark, sf):
    return changes.detect_changes(merged(spark, sf), "incident_id", "day", _ORDER)


def material_changes(spark, sf):
    """What changed between consecutive merged versions, with the fingerprint of the facts."""
    return material(spark, sf).select("incident_id", "event_id", "is_material", F.array_join("changes", "|").alias("changes"), F.array_join("descriptions", "|").alias("descriptions"), "fingerprint", "change_reason")


def _changes_cte():
    lag = ", ".join(f"lag({c}) OVER w AS b_{c}" for c in changes.SNAPSHOT_COLUMNS)
    well = ("is_well_integrity_related", "well_integrity_category", "suspected_failed_component", "barrier_function_impacted")
    moved = " OR ".join(f"b_{c} IS DISTINCT FROM {c}" for c in well)
    stop = "coalesce(shutdown, FALSE) AND NOT coalesce(b_shutdown, FALSE)"
    rules = [
        ("fatalities_confirmed", "b_fatalities IS NULL AND fatalities > 0", "concat('Fatalities confirmed: ', fatalities, '.')"),
        ("fatalities_increased", "fatalities > b_fatalities", "concat('Fatalities revised from ', b_fatalities, ' to ', fatalities, '.')"),
        ("injuries_changed", "injuries IS NOT NULL AND b_injuries IS DISTINCT FROM injuries", "CASE WHEN b_injuries IS NULL THEN concat('Injuries reported: ', injuries, '.') ELSE concat('Injuries revised from ', b_injuries, ' to ', injuries, '.') END"),
        ("missing_persons", "missing_persons > 0 AND b_missing_persons IS DISTINCT FROM missing_persons", "concat('Missing persons: ', missing_persons, '.')"),
        ("severity_increased", "severity_score - b_severity_score >= 15", "concat('Severity raised from ', b_severity, ' to ', severity, '.')"),
        ("major_escalation", "severity_score - b_severity_score >= 30", "'Major escalation reported.'"),
        ("environmental_impact", "b_environmental_impact IS NULL AND environmental_impact IS NOT NULL", "'Environmental impact reported.'"),
        ("official_investigation", "coalesce(has_official_source, FALSE) AND NOT coalesce(b_has_official_source, FALSE)", "'An official source or investigation update is now attached.'"),
        ("cause_confirmed", "b_cause IS NULL AND cause IS NOT NULL", "'A cause has been reported.'"),
        ("production_shutdown", f"({stop}) OR (b_production_impact IS NULL AND production_impact IS NOT NULL)", f"CASE WHEN {stop} THEN 'Production shutdown reported.' ELSE 'Production impact reported.' END"),
        ("well_integrity_information", f"({moved}) AND is_well_integrity_related", "'New well integrity information reported.'"),
        ("well_control_development", "b_well_integrity_category IS DISTINCT FROM well_integrity_category AND well_integrity_category IN ('well_control', 'multiple_barrier_failure')", "'Significant well control development reported.'"),
        ("incident_date_established", "b_incident_date IS NULL AND incident_date IS NOT NULL", "concat('Incident date established: ', incident_date, '.')"),
        ("operator_statement", "coalesce(b_operator, '') = '' AND operator IS NOT NULL", "concat('Operator identified: ', operator, '.')"),
    ]
    return _MERGED_CTE + f""", g AS (SELECT *, {lag}, lag(event_id) OVER w AS b_event FROM m WINDOW w AS (PARTITION BY incident_id ORDER BY seen_at, event_id)),
      ch AS (SELECT *, concat_ws('|', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in rules)}) AS changes, concat_ws('|', {', '.join(f'CASE WHEN {c} THEN {d} END' for _, c, d in rules)}) AS descriptions,
        {S.fingerprint(*changes.FINGERPRINT_COLUMNS)} AS fingerprint FROM g WHERE b_event IS NOT NULL)"""


CHANGES_SQL = with_sql("v_version") + _changes_cte() + """ SELECT incident_id, event_id, changes <> '' AS is_material, changes, descriptions, fingerprint,
  CASE WHEN changes <> '' THEN concat('Material update: ', replace(changes, '|', ', '), '.') ELSE 'No change in the reported facts — treated as a republication (no notification).' END AS change_reason FROM ch"""


def recorded_changes(spark, sf):
    """Each fingerprint once per fact, at its first appearance."""
    updates = material(spark, sf).select("incident_id", "fingerprint", "seen_at", "event_id")
    return changes.record_once(updates, "incident_id", _ORDER).select("incident_id", "fingerprint", "event_id")


RECORDED_SQL = with_sql("v_version") + _changes_cte() + " SELECT incident_id, fingerprint, arg_min(event_id, (seen_at, event_id)) AS event_id FROM ch GROUP BY incident_id, fingerprint"


# ------------------------------------------------------------------------------------------------ alerts


def _preferences(spark, sf):
    as_list = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return view(spark, sf, "v_preference").withColumns({c: as_list(c) for c in ("severities", "incident_types", "countries")})


def _alert_rows(spark, sf):
    """Alerts of one run per day: new incidents and updates."""
    base = view(spark, sf, "v_incident").withColumnRenamed("id", "incident_id")
    kinds = F.explode(F.array(F.struct(F.lit("new_incident").alias("kind"), F.lit(0).alias("seq")), F.struct(F.lit("material_update").alias("kind"), F.lit(1).alias("seq"))))
    rows = base.withColumn("k", kinds).filter((F.col("k.seq") == 0) | (F.col("incident_id") % 3 == 0)).select("*", "k.kind", "k.seq").drop("k")
    return rows.withColumns({
        "run_id": F.coalesce(F.col("incident_date").cast("string"), F.lit("undated")), "descriptions": F.array(F.concat(F.lit("Fatalities confirmed: "), F.coalesce(F.col("fatalities").cast("string"), F.lit("none")), F.lit("."))),
        "fingerprint": F.when(F.col("kind") == "new_incident", alerts.new_incident_fingerprint()).otherwise(F.md5(F.concat(F.lit("u"), "incident_id")))})


def _history(spark, sf):
    """Alerts already sent: to some users for their nation's incidents."""
    rows = view(spark, sf, "v_incident").filter("id % 2 = 0").withColumnRenamed("id", "incident_id")
    return rows.select(F.when(F.col("incident_id") % 4 == 0, F.lit(None).cast("bigint")).otherwise(F.col("incident_id") % 50).alias("user_id"), "incident_id", alerts.new_incident_fingerprint().alias("fingerprint"))


def alert_messages(spark, sf):
    """Messages of the alert fan-out, of all runs."""
    out = alerts.fan_out(_alert_rows(spark, sf), view(spark, sf, "v_device"), _preferences(spark, sf), _history(spark, sf), ["seq"])
    return out.select("run_id", "incident_id", "user_id", "token", "kind", "title", "body", "sound")


_FP = S.fingerprint("'new'", "id", "severity", "fatalities", "injuries")
_ALERT_CTE = f""", al AS (SELECT *, coalesce(CAST(incident_date AS VARCHAR), 'undated') AS run_id, k.kind AS kind, k.seq AS seq, CASE WHEN k.seq = 0 THEN {_FP} ELSE md5(concat('u', id)) END AS fp
    FROM v_incident, (VALUES ('new_incident', 0), ('material_update', 1)) k(kind, seq) WHERE (k.seq = 0 OR id % 3 = 0) AND status <> 'under_review' AND confidence_score >= 50),
  hist AS (SELECT CASE WHEN id % 4 = 0 THEN NULL ELSE id % 50 END AS user_id, id AS incident_id, {_FP} AS fp FROM v_incident WHERE id % 2 = 0),
  aud AS (SELECT d.user_id, d.token, coalesce(p.enabled, TRUE) AS enabled, coalesce(p.sound, TRUE) AS sound, coalesce(p.critical_only, FALSE) AS critical_only, coalesce(p.min_severity, 'moderate') AS min_severity, coalesce(p.severities, '') AS severities,
      coalesce(p.incident_types, '') AS incident_types, coalesce(p.countries, '') AS countries, coalesce(p.well_integrity_alerts, TRUE) AS wi, coalesce(p.well_control_alerts, TRUE) AS wc FROM v_device d LEFT JOIN v_preference p ON p.user_id = d.user_id WHERE d.active),
  pr AS (SELECT al.*, aud.user_id, aud.token, aud.sound FROM al JOIN aud ON aud.enabled AND (NOT critical_only OR severity = 'critical')
      AND list_position(['low', 'moderate', 'high', 'critical'], severity) >= list_position(['low', 'moderate', 'high', 'critical'], min_severity)
      AND (severities = '' OR list_contains(string_split(severities, ','), severity)) AND (incident_types = '' OR list_contains(string_split(incident_types, ','), incident_type))
      AND (countries = '' OR list_contains(string_split(lower(countries), ','), lower(coalesce(country, '')))) AND (wi OR NOT coalesce(is_well_integrity_related, FALSE)) AND (wc OR incident_type NOT IN ('well_control', 'blowout'))
      WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id IS NOT DISTINCT FROM aud.user_id AND h.incident_id = al.id AND h.fp = al.fp)),
  fi AS (SELECT run_id, id, min(seq) AS s FROM pr GROUP BY run_id, id)"""
_LEAD = "split_part(coalesce(summary, title), chr(10), 1)"
_UPD = "concat('Fatalities confirmed: ', coalesce(CAST(fatalities AS VARCHAR), 'none'), '.')"
ALERT_SQL = with_sql("v_incident", "v_device", "v_preference") + _ALERT_CTE + f""" SELECT pr.run_id, pr.id AS incident_id, user_id, token, kind, CASE WHEN seq = 0 THEN 'NEW INCIDENT' ELSE 'INCIDENT UPDATE' END AS title,
  CASE WHEN seq = 0 THEN concat({S.truncate(_LEAD, 140)}, chr(10), concat_ws(' · ', nullif(country, ''), CASE WHEN environment <> 'unknown' THEN {S.label('environment')} END, concat({S.label('severity')}, ' severity')))
    ELSE concat({S.truncate('title', 90)}, chr(10), {S.truncate(_UPD, 140)}) END AS body, sound FROM pr JOIN fi ON fi.run_id = pr.run_id AND fi.id = pr.id AND fi.s = pr.seq"""


def alert_history_append(spark, sf):
    """Rows that all runs add to the notification history, per user."""
    history = _history(spark, sf)
    messages = alerts.fan_out(_alert_rows(spark, sf), view(spark, sf, "v_device"), _preferences(spark, sf), history, ["seq"])
    return alerts.deliveries_to_history(messages, history).groupBy("user_id").agg(F.count(F.lit(1)).alias("added"))


ALERT_HISTORY_SQL = with_sql("v_incident", "v_device", "v_preference") + _ALERT_CTE + """, d AS (SELECT DISTINCT user_id, pr.id, fp FROM pr JOIN fi ON fi.run_id = pr.run_id AND fi.id = pr.id AND fi.s = pr.seq)
  SELECT user_id, count(*) AS added FROM d GROUP BY user_id"""


# ------------------------------------------------------------------------------------------------ users


def user_export(spark, sf):
    """One JSON document per user with states, devices and preferences."""
    tables = {"preferences": view(spark, sf, "v_preference").select("user_id", "min_severity", "enabled"), "incident_state": current_states(spark, sf).select("user_id", "incident_id", "state"),
              "devices": view(spark, sf, "v_device").select("user_id", "token")}
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.export_users(people, tables).select("user_id", F.md5("document").alias("document_md5"))


USER_EXPORT_SQL = with_sql("v_preference", "v_state", "v_device") + _STATES_SQL + """, p AS (SELECT user_id, string_agg(concat('{"min_severity":"', min_severity, '","enabled":', CASE WHEN enabled THEN 'true' ELSE 'false' END, '}'), ',') AS j FROM v_preference GROUP BY user_id),
  s AS (SELECT user_id, string_agg(j, ',' ORDER BY j) AS j FROM (SELECT user_id, concat('{"incident_id":', incident_id, ',"state":"', state, '"}') AS j FROM states) GROUP BY user_id),
  d AS (SELECT user_id, string_agg(concat('{"token":"', token, '"}'), ',') AS j FROM v_device WHERE user_id IS NOT NULL GROUP BY user_id)
  SELECT c_custkey AS user_id, md5(concat('{"preferences":[', coalesce(p.j, ''), '],"incident_state":[', coalesce(s.j, ''), '],"devices":[', coalesce(d.j, ''), ']}')) AS document_md5
  FROM customer LEFT JOIN p ON p.user_id = c_custkey LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN d ON d.user_id = c_custkey"""


def user_erase(spark, sf):
    """Rows left in every table after erasing every fourth user; owned rows go with their owner, shared facts stay."""
    tables = {"states": current_states(spark, sf), "devices": view(spark, sf, "v_device"), "preferences": view(spark, sf, "v_preference"),
              "device_log": view(spark, sf, "v_device").select("token", "active"), "incidents": view(spark, sf, "v_incident").select("id")}
    gone = table(spark, sf, "customer").filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("user_id"))
    left = users.erase_users(tables, gone, {"device_log": ("devices", "token")})
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
        out = one if out is None else out.unionByName(one)
    return out


USER_ERASE_SQL = with_sql("v_state", "v_device") + _STATES_SQL + """ SELECT 'states' AS table_name, count(*) AS rows_left FROM states WHERE NOT (user_id % 4 = 1 AND user_id IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'devices', count(*) FROM v_device WHERE user_id IS NULL OR user_id % 4 <> 1
  UNION ALL SELECT 'preferences', count(*) FROM customer WHERE c_custkey % 4 <> 1 UNION ALL SELECT 'device_log', count(*) FROM v_device WHERE user_id IS NULL OR user_id % 4 <> 1 UNION ALL SELECT 'incidents', count(*) FROM orders"""


# ------------------------------------------------------------------------------------------------ runs


def source_statistics(spark, sf):
    return runs.source_statistics(view(spark, sf, "v_call"))


STATS_SQL = with_sql("v_call") + """ SELECT provider, count(*) FILTER (WHERE error IS NULL) AS queries_executed, CAST(sum(results) FILTER (WHERE error IS NULL) AS BIGINT) AS results_found, CAST(sum(duration_ms) FILTER (WHERE error IS NULL) AS BIGINT) AS duration_ms,
  count(error) AS error_count, CAST(sum(retries) FILTER (WHERE error IS NULL) AS BIGINT) AS retry_count, count(error) = 0 AS healthy, arg_max(error, CASE WHEN error IS NOT NULL THEN call_id END) AS error_message FROM v_call GROUP BY provider"""


def source_failures(spark, sf):
    return runs.failures(view(spark, sf, "v_call"))


FAILURES_SQL = with_sql("v_call") + """ SELECT provider, count(*) AS failed_queries, arg_max(error, call_id) AS last_error, concat(provider, ': ', count(*), CASE WHEN count(*) = 1 THEN ' query' ELSE ' queries' END, ' failed (', arg_max(error, call_id), ')') AS message
  FROM v_call WHERE error IS NOT NULL GROUP BY provider"""

_STAGES = ("rejected", "duplicate", "deferred", "rejected_late", "created", "updated", "created", "rejected")


def run_funnel(spark, sf):
    """Funnel of each day's run, from stage-tagged calls."""
    calls = view(spark, sf, "v_call")
    stage = F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.element_at(F.array(*[F.lit(s) for s in _STAGES]), (F.col("call_id") % len(_STAGES) + 1).cast("int")))
    return runs.funnel(calls.select(F.col("run_id").cast("string").alias("run_id"), stage.alias("stage")))


FUNNEL_SQL = with_sql("v_call") + f""", s AS (SELECT CAST(run_id AS VARCHAR) AS run_id, CASE WHEN error IS NOT NULL THEN 'error' ELSE {pick(_STAGES, 'call_id')} END AS stage FROM v_call)
  SELECT run_id, count(*) FILTER (WHERE stage <> 'error') AS results_found, count(*) FILTER (WHERE stage IN ('rejected', 'rejected_late')) AS rejected, count(*) FILTER (WHERE stage = 'duplicate') AS duplicates,
  count(*) FILTER (WHERE stage IN ('created', 'updated', 'rejected_late', 'deferred')) AS potential, count(*) FILTER (WHERE stage = 'created') AS created, count(*) FILTER (WHERE stage = 'updated') AS updated, count(*) FILTER (WHERE stage = 'deferred') AS deferred,
  CASE WHEN count(*) FILTER (WHERE stage = 'error') > 0 THEN 'partial' ELSE 'completed' END AS status FROM s GROUP BY run_id"""


def latest_run(spark, sf):
    by_day = view(spark, sf, "v_call").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.min("started_at").alias("started_at"), F.count(F.lit(1)).alias("calls"))
    return runs.latest_run(by_day).select("run_id", "calls")


LATEST_SQL = with_sql("v_call") + " SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS calls FROM v_call GROUP BY run_id ORDER BY min(started_at) DESC LIMIT 1"


def budget(spark, sf):
    """The best candidates within the budget and the deferred rest, counted per severity."""
    base = view(spark, sf, "v_incident").select("id", "severity", F.col("relevance_score").alias("score"), (F.col("id") % 5 + 1).alias("source_tier"))
    best, rest = runs.within_budget(base, 120)
    tag = lambda df, name: df.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("checksum")).withColumn("part", F.lit(name))
    return tag(best, "budget").unionByName(tag(rest, "deferred"))


BUDGET_SQL = with_sql("v_incident") + """, r AS (SELECT id, severity, row_number() OVER (ORDER BY relevance_score DESC, id % 5 + 1, id) <= 120 AS inside FROM v_incident)
  SELECT severity, count(*) AS n, CAST(sum(id) AS BIGINT) AS checksum, CASE WHEN inside THEN 'budget' ELSE 'deferred' END AS part FROM r GROUP BY severity, inside"""


def _requests(spark, sf):
    return view(spark, sf, "v_incident").select("id", F.col("incident_type").alias("kind"), F.lit("v1").alias("version"), F.col("oil_gas_sector").alias("model"), (F.col("id") % 300).cast("string").alias("content_hash"))


def _answers(spark, sf):
    calls = view(spark, sf, "v_version")
    sector = F.element_at(F.array(*[F.lit(s) for s in ("upstream", "midstream", "downstream", "integrated", "unknown")]), (F.col("event_id") % 5 + 1).cast("int"))
    return calls.select(F.col("incident_type").alias("kind"), F.lit("v1").alias("version"), sector.alias("model"), (F.col("event_id") % 300).cast("string").alias("content_hash"), F.concat(F.lit("answer "), "event_id").alias("answer"), F.col("seen_at").alias("stored_at"))


_ANSWER_NOW = "2024-01-30 00:00:00"


def answer_reuse(spark, sf):
    """Requests answered by a fresh stored answer, and those still to do."""
    now = F.lit(_ANSWER_NOW).cast("timestamp_ntz")
    answered = runs.reuse_answers(_requests(spark, sf), _answers(spark, sf), now, 5 * 24 * 3600).filter("answer IS NOT NULL").select("id", "answer")
    todo = runs.still_to_do(_requests(spark, sf), _answers(spark, sf), now, 5 * 24 * 3600).select("id", F.lit("to do").alias("answer"))
    return answered.unionByName(todo)


ANSWER_SQL = with_sql("v_incident", "v_version") + f""", a AS (SELECT incident_type AS kind, {pick(('upstream', 'midstream', 'downstream', 'integrated', 'unknown'), 'event_id')} AS model, CAST(event_id % 300 AS VARCHAR) AS h, arg_max(concat('answer ', event_id), seen_at) AS answer
    FROM v_version WHERE date_diff('second', seen_at, TIMESTAMP '{_ANSWER_NOW}') < 432000 GROUP BY ALL)
  SELECT v.id, coalesce(a.answer, 'to do') AS answer FROM v_incident v LEFT JOIN a ON a.kind = v.incident_type AND a.model = v.oil_gas_sector AND a.h = CAST(v.id % 300 AS VARCHAR)"""

_PLAN = ("\"{0}\" incident", "{0} fire", "{0} explosion {1}", "\"gas leak\" {1}")


def _plan_queries(spark, sf):
    """Saved queries made of the part names and nations."""
    parts = table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_partkey", "p_size")
    words = F.array(*[F.lit(x) for x in ("oil platform", "drilling rig", "refinery", "pipeline rupture", "well control", "lng terminal", "production platform", "tank farm")])
    noun = F.element_at(words, (F.col("p_partkey") % 8 + 1).cast("int"))
    other = F.element_at(words, (F.col("p_size") % 8 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('"'), noun, F.lit('" incident'))).when(F.col("p_partkey") % 4 == 1, F.concat(noun, F.lit(" fire"))).when(
        F.col("p_partkey") % 4 == 2, F.concat(noun, F.lit(" explosion "), other)).otherwise(F.concat(F.lit('"gas leak" '), other))
    return parts.select(text.alias("text"), F.lit("en").alias("language"), F.lit("worldwide").alias("region"), (F.col("p_size") * 2).alias("priority"), F.col("p_partkey").alias("position"))


_PLAN_CTE = f""" q AS (SELECT p_partkey, p_size * 2 AS priority, CASE p_partkey % 4 WHEN 0 THEN concat('"', n, '" incident') WHEN 1 THEN concat(n, ' fire') WHEN 2 THEN concat(n, ' explosion ', o) ELSE concat('"gas leak" ', o) END AS text
    FROM (SELECT *, {pick(('oil platform', 'drilling rig', 'refinery', 'pipeline rupture', 'well control', 'lng terminal', 'production platform', 'tank farm'), 'p_partkey')} AS n,
      {pick(('oil platform', 'drilling rig', 'refinery', 'pipeline rupture', 'well control', 'lng terminal', 'production platform', 'tank farm'), 'p_size')} AS o FROM part)),
  k AS (SELECT concat('en:worldwide:', substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g'), 1, 60)) AS query_id, * FROM q),
  pl AS (SELECT query_id, arg_min(text, p_partkey) AS text, arg_min(priority, p_partkey) AS priority FROM k GROUP BY query_id ORDER BY arg_min(priority, p_partkey) DESC, query_id LIMIT 40)"""


def query_plan(spark, sf):
    """The deterministic plan: first per id, by priority, within the query budget."""
    return saved_queries.plan(_plan_queries(spark, sf), 40).select("query_id", "text", "priority")


def _seeds(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_name").alias("text"), F.lit("en").alias("language"), F.when(F.col("p_partkey") % 3 == 0, F.lit("core")).otherwise(F.lit("regional")).alias("kind"),
        F.lit("upstream").alias("sector"), F.lit("safety").alias("category"), F.col("p_size").cast("bigint").alias("priority"), F.col("p_partkey").cast("bigint").alias("position"))


def query_candidates(spark, sf):
    """Candidate queries: part names as they are or with places of two regions, nations as keywords."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    hints = nations.select(F.col("r_name").alias("region"), F.col("n_name").alias("hint"), F.floor(F.col("n_nationkey") / 5).cast("bigint").alias("hint_position"))
    keywords = nations.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" gas"))).otherwise(F.col("n_name")).alias("keyword"),
                              F.lit("en").alias("language"), F.col("n_nationkey").cast("bigint").alias("position"))
    return saved_queries.expand_plan(_seeds(spark, sf), hints, ["worldwide", "ASIA", "EUROPE"], keywords)


CANDIDATES_SQL = """WITH s AS (SELECT p_name AS text, p_partkey % 3 = 0 AS core, CAST(p_size AS BIGINT) AS priority, CAST(p_partkey AS BIGINT) AS position FROM part),
  n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
  h AS (SELECT r_name AS region, n_name AS hint, n_nationkey // 5 AS hp FROM n WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey // 5 < 3),
  k AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN concat(n_name, ' gas') ELSE n_name END AS keyword, n_nationkey AS position FROM n)
  SELECT text, 'en' AS language, 'worldwide' AS region, NULL AS country, 'upstream' AS sector, 'safety' AS category, priority, position FROM s WHERE core
  UNION ALL SELECT concat_ws(' ', text, hint), 'en', region, hint, 'upstream', 'regional', priority, position * 100 + hp + 100000 FROM s, h WHERE NOT core
  UNION ALL SELECT CASE WHEN regexp_matches(keyword, '(?i)oil|gas|petro|well|rig|platform|refin|pipeline') THEN keyword ELSE concat(keyword, ' (oil OR gas OR petroleum)') END,
    'en', 'worldwide', NULL, 'unknown', 'user-keyword', 110 - position, position + 1000000 FROM k"""


def percolation_all(spark, sf):
    """Bulletins answering each query of a plan without a budget."""
    plan = saved_queries.plan(_plan_queries(spark, sf), 1_000_000)
    found = saved_queries.percolate(view(spark, sf, "v_bulletin"), plan)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("articles"), F.sum("hits").alias("hits"), F.min("article_id").alias("first_article"))


def percolation(spark, sf):
    """Bulletins answering each saved query."""
    plan = saved_queries.plan(_plan_queries(spark, sf), 40)
    found = saved_queries.percolate(view(spark, sf, "v_bulletin"), plan, exclude=("Atlantis",), max_results=None)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("articles"), F.sum("hits").alias("hits"), F.min("article_id").alias("first_article"))


_PT = S.tokens("replace(text, '\"', '')")
PERCOLATE_SQL = with_sql("v_bulletin") + "," + _PLAN_CTE + f""", c AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda p: lower(p)), lambda p: p <> '') AS ph, {_PT} AS terms FROM pl),
  a AS (SELECT id, {S.fold("concat_ws(' ', title, coalesce(excerpt, ''), publisher)")} AS t FROM v_bulletin),
  m AS (SELECT query_id, id, length(list_filter(terms, lambda x: contains(t, x))) AS hits FROM a JOIN c ON length(list_filter(ph, lambda p: contains(t, p))) > 0 OR length(list_filter(terms, lambda x: contains(t, x))) * 2 >= length(terms) WHERE NOT contains(t, 'atlantis'))
  SELECT query_id, count(*) AS articles, CAST(sum(hits) AS BIGINT) AS hits, min(id) AS first_article FROM m GROUP BY query_id"""

# ------------------------------------------------------------------------------------------------ stores


def store_upsert(spark, sf):
    """Articles after an upsert: the first half is stored, all are incoming; old rows stay, missing scores are filled."""
    rows = dedup.with_dedup_keys(view(spark, sf, "v_bulletin")).select("id", "normalized_url", "title", (F.col("id") % 90).alias("relevance_score"))
    stored = keep_first(rows.filter("id % 2 = 0"), ["normalized_url"], "id").withColumn("relevance_score", F.when(F.col("id") % 4 == 0, F.col("relevance_score")))
    incoming = rows.filter("id % 2 = 1 OR id % 5 < 3").withColumn("relevance_score", F.when(F.col("id") % 3 == 0, F.col("relevance_score")))
    return store.upsert_articles(stored, incoming, ["id"]).select("normalized_url", "id", "relevance_score")


UPSERT_SQL = with_sql("v_bulletin") + f""", r AS (SELECT id, {S.normalise_url('coalesce(canonical_url, url)')} AS n, id % 90 AS sc FROM v_bulletin),
  st AS (SELECT n, min(id) AS id, CASE WHEN min(id) % 4 = 0 THEN arg_min(sc, id) END AS sc FROM r WHERE id % 2 = 0 GROUP BY n),
  ic AS (SELECT n, min(id) AS id, CASE WHEN min(id) % 3 = 0 THEN arg_min(sc, id) END AS sc FROM r WHERE id % 2 = 1 OR id % 5 < 3 GROUP BY n)
  SELECT coalesce(st.n, ic.n) AS normalized_url, coalesce(st.id, ic.id) AS id, CASE WHEN st.id IS NULL THEN ic.sc ELSE coalesce(ic.sc, st.sc) END AS relevance_score FROM st FULL JOIN ic ON st.n = ic.n"""


def store_patch(spark, sf):
    """Incidents after patches: a patch replaces a value only where it has one; unknown ids are inserted."""
    base = view(spark, sf, "v_incident").select("id", "operator", "asset", "severity_score", "status")
    patches = base.filter("id % 3 = 0").select(F.when(F.col("id") % 30 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 2 == 0, F.lit("patched")).alias("operator"), (F.col("severity_score") + 1).alias("severity_score"))
    return store.patch_incidents(base, patches)


PATCH_SQL = with_sql("v_incident") + """, p AS (SELECT CASE WHEN id % 30 = 0 THEN -id - 1 ELSE id END AS id, CASE WHEN id % 2 = 0 THEN 'patched' END AS operator, severity_score + 1 AS severity_score FROM v_incident WHERE id % 3 = 0)
  SELECT coalesce(v.id, p.id) AS id, coalesce(p.operator, v.operator) AS operator, v.asset, coalesce(p.severity_score, v.severity_score) AS severity_score, v.status FROM v_incident v FULL JOIN p ON p.id = v.id"""


def store_children(spark, sf):
    """Entities after an upsert on their natural key, last one wins; then highlights replaced per incident."""
    base = view(spark, sf, "v_incident")
    rows = provenance.entity_rows(base, ["id"]).withColumnRenamed("id", "incident_id")
    stored = keep_first(rows.filter("incident_id % 2 = 0"), ["incident_id", "entity_type", "normalized_name"], "name")
    fresh = rows.filter("incident_id % 3 = 0").withColumn("name", F.upper("name"))
    merged_rows = store.upsert_children(stored, fresh, ["incident_id", "entity_type", "normalized_name"], ["name"])
    lines = base.select(F.col("id").alias("incident_id"), F.lit("highlight").alias("entity_type"), F.col("title").alias("name"), F.lit("old").alias("normalized_name"))
    replaced = store.replace_children(lines, lines.filter("incident_id % 5 = 0").withColumn("normalized_name", F.lit("new")), "incident_id")
    return merged_rows.unionByName(replaced).groupBy("entity_type", "normalized_name").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"))


def _children_sql():
    ents = " UNION ALL ".join(f"SELECT id, '{kind}' AS entity_type, {col} AS name, {S.org(col) if org else S.norm(col)} AS normalized_name FROM v_incident WHERE trim({col}) <> ''" for kind, col, org in provenance.ENTITY_COLUMNS)
    return with_sql("v_incident") + f""", e AS ({ents}), s AS (SELECT id, entity_type, normalized_name, min(name) AS name FROM e WHERE id % 2 = 0 GROUP BY ALL), f AS (SELECT id, entity_type, normalized_name, max(upper(name)) AS name FROM e WHERE id % 3 = 0 GROUP BY ALL),
      m AS (SELECT coalesce(s.id, f.id) AS id, coalesce(s.entity_type, f.entity_type) AS entity_type, coalesce(s.normalized_name, f.normalized_name) AS normalized_name, coalesce(f.name, s.name) AS name FROM s FULL JOIN f ON s.id = f.id AND s.entity_type = f.entity_type AND s.normalized_name = f.normalized_name
        UNION ALL SELECT id, 'highlight', CASE WHEN id % 5 = 0 THEN 'new' ELSE 'old' END, title FROM v_incident)
      SELECT entity_type, normalized_name, count(*) AS n, max(name) AS name FROM m GROUP BY entity_type, normalized_name"""


QUERIES = {
    "dedup_exact_keys": (exact_duplicates, EXACT_SQL),
    "dedup_first_wins": (first_wins, FIRST_WINS_SQL),
    "dedup_similar_headlines": (similar_headlines, SIMILAR_SQL),
    "dedup_known_lookup": (known_lookup, KNOWN_SQL),
    "link_candidate_pairs": (link_candidates, LINK_CANDIDATES_SQL),
    "link_best_match": (best_match, BEST_MATCH_SQL),
    "link_batch_groups": (batch_groups, BATCH_GROUPS_SQL),
    "score_severity": (severity, _severity_sql()),
    "score_confidence": (confidence, CONFIDENCE_SQL),
    "score_relevance": (relevance_score, RELEVANCE_SCORE_SQL),
    "versions_merged": (merged_versions, MERGED_SQL),
    "versions_material_changes": (material_changes, CHANGES_SQL),
    "versions_recorded_once": (recorded_changes, RECORDED_SQL),
    "alert_messages": (alert_messages, ALERT_SQL),
    "alert_history_append": (alert_history_append, ALERT_HISTORY_SQL),
    "user_export": (user_export, USER_EXPORT_SQL),
    "user_erase": (user_erase, USER_ERASE_SQL),
    "run_source_statistics": (source_statistics, STATS_SQL),
    "run_source_failures": (source_failures, FAILURES_SQL),
    "run_funnel": (run_funnel, FUNNEL_SQL),
    "run_latest": (latest_run, LATEST_SQL),
    "run_budget": (budget, BUDGET_SQL),
    "run_answer_reuse": (answer_reuse, ANSWER_SQL),
    "query_plan": (query_plan, "WITH" + _PLAN_CTE + " SELECT query_id, text, priority FROM pl"),
    "query_percolation": (percolation, PERCOLATE_SQL),
    "query_percolation_all": (percolation_all, PERCOLATE_SQL.replace(" LIMIT 40)", ")").replace(" WHERE NOT contains(t, 'atlantis')", "")),
    "query_candidates": (query_candidates, CANDIDATES_SQL),
    "store_upsert_articles": (store_upsert, UPSERT_SQL),
    "store_patch_incidents": (store_patch, PATCH_SQL),
    "store_children": (store_children, _children_sql()),
}
