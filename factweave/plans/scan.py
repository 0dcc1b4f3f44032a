"""One scan: raw articles in, new and updated incidents, links, changes, provenance and a funnel out.

The stages are ordered by cost, as filters: window, keywords, exact and fuzzy duplicates, budget, classifier, extraction,
date, relevance. What survives is linked to stored incidents, the rest is grouped among itself. Wide intermediate
results are written once (`materialise`) because several outputs read them.

Grouping inside a batch compares facts as first reported; a sequential run would compare with facts an earlier article
of the same batch had already merged.

An update keeps what an incident was created with: only consequences, names and well or process-safety facts are patched,
a missing date is filled, relevance never falls. Counters cover every article ever linked, not those of this batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.config import CLASSIFIER_REJECT_BELOW, PUBLICATION_LEAD_IN_DAYS, ScanConfig
from factweave.functions.text import truncate
from factweave.functions.time import effective_date, effective_date_is_estimate, passes_publication_window, passes_window, resolve_window
from factweave.operators import alerts, changes, dedup, extract, linkage, provenance, relevance, runs, scoring
from factweave.operators.ordered import running_merge, with_previous
from factweave.operators.skew import keep_last
from factweave.session import materialise
from factweave.terms import TermLists

_PATCHED = ["fatalities", "injuries", "missing_persons", "evacuated_persons", "hydrocarbon_release", "environmental_impact",
            "production_impact", "production_interruption", "shutdown", "asset_damage", "fire", "explosion", "spill", "leak",
            "well_control_event", "operator", "asset", "installation", "field", "well_name", "is_well_integrity_related",
            "well_integrity_category", "suspected_failed_component", "barrier_function_impacted", "is_process_safety_event",
            "process_safety_category"]
# As created, NULL included; of these only a missing date is ever filled.
_FIXED = ["incident_type", "title", "summary", "company", "country", "country_code", "basin", "block", "installation_type",
          "well_number", "oil_gas_sector", "environment", "lifecycle_stage", "incident_date_is_estimated",
          "secondary_incident_types", "status"]


@dataclass(frozen=True)
class ScanResult:
    """Tables of one run. `incidents` holds the final state of every created or updated incident, `links` the articles this
    run attached (with publisher and tier, which later counters need), `changes` the updates not recorded before."""

    stages: DataFrame
    articles: DataFrame
    links: DataFrame
    versions: DataFrame
    changes: DataFrame
    incidents: DataFrame
    entities: DataFrame
    evidence: DataFrame
    highlights: DataFrame


def scan(articles: DataFrame, config: ScanConfig, now: datetime, terms: TermLists | None = None, stored_articles: DataFrame | None = None,
         stored_incidents: DataFrame | None = None, dedicated: str | None = None, stored_links: DataFrame | None = None,
         stored_changes: DataFrame | None = None) -> ScanResult:
    """Run one scan over `articles` (`seq` is the arrival order and the article id of the batch).

    Stored articles take part in deduplication, stored incidents (columns of `ScanResult.incidents`) in linking, stored links
    (columns of `ScanResult.links`) in the counters of the incidents they belong to, stored changes in recording each change
    once. Batch `seq` values must be above every stored one.
    """
    if (stored_incidents is None) != (stored_links is None):
        raise ValueError("stored incidents and their stored links are needed together")
    terms = terms or TermLists.built_in()
    window = resolve_window(now, config.period)
    c = F.col

    in_time = passes_publication_window(c("published_at"), window, PUBLICATION_LEAD_IN_DAYS)
    judged = relevance.evaluate_relevance(articles.withColumn("_in_time", in_time), terms, config.include_keywords, config.exclude_keywords, dedicated=dedicated)
    judged = materialise(judged, "scan-judged")
    candidates = judged.filter("_in_time AND passed")

    known = None
    if stored_articles is not None:
        known = dedup.known_articles(dedup.with_dedup_keys(candidates), stored_articles)
    verdicts = materialise(dedup.first_wins(candidates, known), "scan-dedup")
    unique = candidates.join(verdicts.filter("NOT is_duplicate").select("seq"), "seq", "left_semi")

    if config.max_extractions is None:
        considered, deferred = unique, unique.limit(0)
    else:
        considered, deferred = runs.within_budget(unique, config.max_extractions, "seq")
    if config.include_keywords or config.exclude_keywords or dedicated:
        # The classifier judges the article alone, without the user's keywords.
        asked = considered.drop(*relevance.VERDICT_COLUMNS)
        answers = relevance.classify_by_rules(relevance.evaluate_relevance(asked, terms)).select(
            "seq", "classifier_related", "classifier_confidence", "classifier_sector")
        considered = considered.join(answers, "seq")
    else:
        considered = relevance.classify_by_rules(considered)
    accepted = considered.filter(relevance.passes_classifier(c("classifier_related"), c("classifier_confidence"), CLASSIFIER_REJECT_BELOW))

    facts = extract.consequences(extract.extract_incidents(accepted, ["seq"], terms))
    carried = accepted.select("seq", "publisher", "source_tier", "url", "published_at", c("title").alias("article_title"), "excerpt", c("score").alias("heuristic"),
                              "classifier_related", "classifier_confidence", F.size("matched_event_terms").alias("term_hits"), "has_strong_phrase")
    records = facts.join(carried, "seq").filter("is_related")
    day = effective_date(c("incident_date"), c("published_at"), config.date_axis)
    records = records.withColumn("_day", day).withColumn(
        "incident_date_is_estimated", effective_date_is_estimate(c("incident_date"), c("published_at"), config.date_axis))
    records = records.filter(passes_window(c("_day"), window))
    parts = scoring.relevance_components(
        c("heuristic"), c("classifier_confidence"), c("oil_gas_sector"), c("source_tier"), F.abs(F.datediff(F.lit(now.date()), c("_day"))),
        runs.matches_region(c("country"), config.regions, config.custom_countries), c("term_hits"), c("has_strong_phrase"))
    records = scoring.score_relevance(records, parts, c("classifier_related"), config.relevance_feed, config.relevance_review)
    records = materialise(records.filter("outcome <> 'reject'"), "scan-records")

    # Link to stored incidents first, group what is left among itself.
    targets = records.select("seq").limit(0).select(c("seq").alias("candidate"), c("seq").alias("incident_id"))
    if stored_incidents is not None:
        linked = linkage.link_to_incidents(records, stored_incidents, now.date(), key="seq", order="seq")
        targets = materialise(linked.filter("accepted").select("candidate", c("incident").alias("incident_id")), "scan-linked")
    fresh = records.join(targets.select(c("candidate").alias("seq")), "seq", "left_anti")
    grouped = linkage.group_batch(fresh, now.date(), key="seq", order="seq")
    links = targets.unionByName(grouped.select("candidate", c("leader").alias("incident_id")))
    links = materialise(links.withColumnRenamed("candidate", "seq").join(records.select("seq", "publisher", "source_tier"), "seq"), "scan-links")

    versions = _versions(records, links.select("seq", "incident_id"), stored_incidents)
    moved = _changes(versions)
    incidents = _final_state(versions, moved, _all_links(links, stored_links), now)
    recorded = moved
    if stored_changes is not None:
        recorded = moved.join(stored_changes.select("incident_id", "fingerprint"), ["incident_id", "fingerprint"], "left_anti").select(*moved.columns)
    created = links.filter("seq = incident_id")

    stage = lambda df, name: df.select("seq", F.lit(name).alias("stage"))
    stages = (
        stage(judged.filter("NOT (_in_time AND passed)"), "rejected")
        .unionByName(stage(verdicts.filter("is_duplicate"), "duplicate"))
        .unionByName(stage(deferred, "deferred"))
        .unionByName(stage(created, "created"))
        .unionByName(stage(links.filter("seq <> incident_id"), "updated"))
        .unionByName(stage(considered.select("seq").join(links.select("seq"), "seq", "left_anti"), "rejected_late"))
    )
    stored_rows = dedup.with_dedup_keys(judged.join(records.select("seq", "relevance_score"), "seq").drop("_in_time", *relevance.VERDICT_COLUMNS))
    provenance_rows = records.join(links.select("seq", "incident_id"), "seq")
    return ScanResult(
        stages=stages,
        articles=stored_rows,
        # An incident carries the number of the article it was created from, which stays its primary source.
        links=links.select("seq", "incident_id", c("seq").alias("article_id"), "publisher", "source_tier", (c("seq") == c("incident_id")).alias("is_primary")),
        versions=versions,
        changes=recorded,
        incidents=incidents,
        entities=keep_last(provenance.entity_rows(provenance_rows, ["incident_id", "seq"]), ["incident_id", "entity_type", "normalized_name"], "seq"),
        evidence=provenance.evidence_rows(provenance_rows, ["incident_id", "seq"], "extraction_confidence"),
        highlights=provenance.highlight_rows(provenance_rows.filter("seq = incident_id"), ["incident_id"]),
    )


def _all_links(links: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The links of this run and all earlier ones of the same incidents."""
    columns = ["incident_id", "publisher", "source_tier"]
    if stored is None:
        return links.select(*columns)
    touched = links.filter("seq <> incident_id").select("incident_id").distinct()
    return links.select(*columns).unionByName(stored.join(touched, "incident_id", "left_semi").select(*columns))


def _versions(records: DataFrame, links: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Every reported version of each incident, the stored state first, merged so that nothing is erased."""
    c = F.col
    columns = ["incident_id", "seq", *_PATCHED, "incident_date", *_FIXED, "model_severity", "relevance_score", "source_tier", "publisher",
               "extraction_confidence", "completeness", "reported_operator", "reported_country", "reported_asset", "reported_date", "has_official_source"]
    reported = records.join(links, "seq").withColumns({
        "completeness": scoring.data_completeness(), "reported_operator": c("operator"), "reported_country": c("country"), "reported_asset": c("asset"),
        "reported_date": c("incident_date"), "title": truncate(c("title"), 200), "has_official_source": F.coalesce(c("source_tier") == 1, F.lit(False)),
        "status": F.when(c("outcome") == "feed", F.lit("new")).otherwise(F.lit("under_review"))}).select(*columns)
    if stored is not None:
        touched = links.filter("seq <> incident_id").select("incident_id").distinct()
        base = stored.join(touched, stored["seq"] == touched["incident_id"], "left_semi").withColumn("incident_id", c("seq"))
        reported = reported.unionByName(base.select(*columns))
    # Arrival order decides; a bucket of it keeps one much-reported incident from being one task's work.
    staged = reported.withColumn("_bucket", F.floor(c("seq") / 10_000)).withColumn("_created", F.struct(*_FIXED)).drop(*_FIXED)
    merged = running_merge(staged, "incident_id", "_bucket", ["seq"], latest=_PATCHED, earliest=["_created", "incident_date"],
                           largest=["relevance_score", "has_official_source"])
    merged = merged.select("_bucket", *[c(f"_created.{name}").alias(name) if name in _FIXED else c(name) for name in columns])
    scored = scoring.score_severity(merged)
    return materialise(scored.withColumn("cause", F.lit(None).cast("string")), "scan-versions")


def _changes(versions: DataFrame) -> DataFrame:
    """Changes between consecutive versions, each fingerprint once per incident.

    A report is compared with the merged state before it; the date it gives itself goes into the fingerprint.
    """
    linked = with_previous(versions, "incident_id", "_bucket", ["seq"], list(changes.SNAPSHOT_COLUMNS)).filter("has_prev")
    linked = linked.withColumn("incident_date", F.coalesce("reported_date", "incident_date"))
    moved = changes.material_changes(linked)
    shown = moved.select("incident_id", "seq", "changes", "descriptions", "fingerprint", "is_material", "change_reason")
    return materialise(changes.record_once(shown, "incident_id", ["seq"]), "scan-changes")


def _final_state(versions: DataFrame, moved: DataFrame, links: DataFrame, now: datetime) -> DataFrame:
    """Last merged version of each incident with source counters, confidence and status."""
    c = F.col
    before = ["operator", "country", "asset"]
    last = keep_last(with_previous(versions, "incident_id", "_bucket", ["seq"], before).drop("_bucket"), ["incident_id"], "seq")
    counters = scoring.source_inputs(links, "incident_id")
    material = moved.filter("is_material").select("incident_id").distinct().withColumn("_moved", F.lit(True))
    joined = last.drop("has_official_source").join(counters, "incident_id").join(material, "incident_id", "left")
    agreement = F.when(c("has_prev"), scoring.pair_agreement([(c(f"prev_{name}"), c(f"reported_{name}")) for name in before]))
    score = scoring.confidence_score(c("highest_source_tier"), c("source_count"), c("strong_sources"), agreement, c("completeness"), c("extraction_confidence"), F.lit(True))
    joined = joined.withColumn("confidence_score", score)
    return joined.withColumns({
        "confidence": scoring.confidence_band(c("confidence_score")), "status": F.when(c("_moved"), F.lit("updated")).otherwise(c("status")),
        "last_updated_at": F.lit(now).cast("timestamp_ntz")}).drop("_moved", "has_prev", *[f"prev_{name}" for name in before]).withColumn("seq", c("incident_id"))


def alert_rows(result: ScanResult, run_id: str) -> DataFrame:
    """What `alerts.fan_out` takes, ordered by `seq`: one row per created incident and per material change recorded by this run.

    The gates look at the state of the incident at the end of the run.
    """
    c = F.col
    state = result.incidents.drop("seq")
    created = result.links.filter("is_primary").select("incident_id", "seq").join(state, "incident_id").withColumns({
        "kind": F.lit("new_incident"), "fingerprint": alerts.new_incident_fingerprint(), "descriptions": F.array().cast("array<string>")})
    changed = result.changes.filter("is_material").select("incident_id", "seq", "fingerprint", "descriptions").join(state, "incident_id").withColumn("kind", F.lit("material_update"))
    return created.unionByName(changed).withColumn("run_id", F.lit(run_id)).withColumn("incident_type", F.coalesce(c("incident_type"), F.lit("unknown")))


def funnel(result: ScanResult, run_id: str) -> DataFrame:
    """Counts of one run."""
    return runs.funnel(result.stages.withColumn("run_id", F.lit(run_id)))
