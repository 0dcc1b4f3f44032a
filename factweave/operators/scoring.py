"""Severity, confidence and relevance scores. Pure arithmetic over columns; halves round up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.config import (MODEL_SEVERITY_POINTS, RELEVANCE_FEED, RELEVANCE_REVIEW, TIER_CONFIDENCE_POINTS,
                              TIER_RELEVANCE_POINTS)
from factweave.functions.text import half_up
from factweave.rules import CRITICAL_TYPES, HIGH_TYPES, MAJOR_ENVIRONMENT

COMPLETENESS_FIELDS = (
    "incident_date", "country", "operator", "asset", "incident_type", "environment", "lifecycle_stage",
    "oil_gas_sector", "summary",
)


def _lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def severity_band(score: Column) -> Column:
    return (F.when(score >= 80, F.lit("critical")).when(score >= 60, F.lit("high"))
            .when(score >= 35, F.lit("moderate")).otherwise(F.lit("low")))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 75, F.lit("high")).when(score >= 50, F.lit("medium")).otherwise(F.lit("low"))


def _bands(*pairs: tuple[Column, Column | int]) -> Column:
    """Points of the first condition that holds, else 0."""
    chain = None
    for condition, points in pairs:
        chain = F.when(condition, points) if chain is None else chain.when(condition, points)
    return chain.otherwise(0)


def severity_contributions() -> list[tuple[Column, Column]]:
    """(points, explanation) of every rule, explanation NULL when the rule gives nothing."""
    c = F.col
    dead, missing, hurt, moved = (F.coalesce(c(n), F.lit(0)) for n in ("fatalities", "missing_persons", "injuries", "evacuated_persons"))
    kinds = F.concat(F.array(c("incident_type")), F.coalesce(c("secondary_incident_types"), F.array().cast("array<string>")))
    critical = F.arrays_overlap(kinds, F.array(*[F.lit(t) for t in CRITICAL_TYPES]))
    high = F.arrays_overlap(kinds, F.array(*[F.lit(t) for t in HIGH_TYPES]))
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    category = F.coalesce(c("well_integrity_category"), F.lit(""))
    barrier = category.isin("primary_barrier_failure", "secondary_barrier_failure")
    spoiled = F.coalesce(F.length(F.trim(c("environmental_impact"))) > 0, F.lit(False))
    major = spoiled & c("environmental_impact").rlike(MAJOR_ENVIRONMENT)
    stopped = F.coalesce(F.length(F.trim(c("production_impact"))) > 0, F.lit(False))
    count = lambda n: n.cast("string")
    return [
        (_bands((dead >= 5, 75), (dead > 1, 60), (dead == 1, 45)),
         F.when(dead > 1, text(count(dead), " fatalities reported")).when(dead == 1, F.lit("1 fatality reported"))),
        (_bands((missing > 0, F.least(F.lit(30), 15 + missing * 5))), F.when(missing > 0, text(count(missing), " person(s) missing"))),
        (_bands((hurt >= 10, 28), (hurt >= 3, 18), (hurt > 0, 10)),
         F.when(hurt >= 3, text(count(hurt), " injuries reported")).when(hurt > 0, text(count(hurt), " injury/injuries reported"))),
        (_bands((moved >= 100, 18), (moved > 0, 10)), F.when(moved > 0, text(count(moved), " people evacuated"))),
        (_bands((critical, 25), (high, 15)),
         F.when(critical, F.lit("Loss of well control / explosion class event")).when(high, F.lit("Major hazard event class"))),
        (_bands((yes("explosion"), 12)), F.when(yes("explosion"), F.lit("Explosion confirmed"))),
        (_bands((yes("fire"), 8)), F.when(yes("fire"), F.lit("Fire confirmed"))),
        (_bands((yes("hydrocarbon_release"), 10)), F.when(yes("hydrocarbon_release"), F.lit("Hydrocarbon release confirmed"))),
        (_bands((yes("spill"), 8)), F.when(yes("spill"), F.lit("Spill confirmed"))),
        (_bands((category == "multiple_barrier_failure", 20), (barrier, 12), (yes("is_well_integrity_related"), 8)),
         F.when(category == "multiple_barrier_failure", F.lit("Multiple barrier failure")).when(barrier, F.lit("Well barrier failure"))
         .when(yes("is_well_integrity_related"), F.lit("Well integrity involved"))),
        (_bands((yes("is_process_safety_event"), 6)), F.when(yes("is_process_safety_event"), F.lit("Process safety event"))),
        (_bands((major, 14), (spoiled, 6)),
         F.when(major, F.lit("Major environmental impact reported")).when(spoiled, F.lit("Environmental impact reported"))),
        (_bands((yes("shutdown"), 6)), F.when(yes("shutdown"), F.lit("Shutdown"))),
        (_bands((stopped, 4)), F.when(stopped, F.lit("Production affected"))),
    ]


def score_severity(facts: DataFrame) -> DataFrame:
    """Add rule score, blended score, band and explanations; the model's opinion weighs a quarter."""
    parts = severity_contributions()
    rule = _clamp(F.lit(10) + reduce(lambda a, b: a + b, [points for points, _ in parts]))
    factors = F.array_compact(F.array(*[why for _, why in parts]))
    model = _lookup(MODEL_SEVERITY_POINTS, F.col("model_severity"))
    staged = facts.select("*", rule.cast("int").alias("severity_rule_score"), factors.alias("severity_factors"))
    # 0.75 * rule + 0.25 * model, rounded half up, in whole numbers.
    blended = F.floor((F.col("severity_rule_score") * 3 + model + 2) / 4)
    staged = staged.withColumn("severity_score", F.coalesce(blended, F.col("severity_rule_score")).cast("int"))
    return staged.withColumn("severity", severity_band(F.col("severity_score")))


def data_completeness(columns=COMPLETENESS_FIELDS) -> Column:
    """Share of key fields that are present and not 'unknown'."""
    present = [F.coalesce(~F.col(c).cast("string").isin("", "unknown"), F.lit(False)).cast("int") for c in columns]
    return reduce(lambda a, b: a + b, present) / len(columns)


def confidence_score(best_tier: Column, publishers: Column, strong_sources: Column, agreement: Column,
                     completeness: Column, model_confidence: Column, has_evidence: Column) -> Column:
    """0-100 from source authority, corroboration, agreement, completeness, provenance and the model."""
    n = F.greatest(F.lit(1), publishers)
    score = (
        _lookup(TIER_CONFIDENCE_POINTS, best_tier.cast("int"))
        + _bands((n >= 4, 18), (n == 3, 13), (n == 2, 8), (n == 1, -5))
        + _bands((strong_sources >= 2, 6))
        + F.coalesce(half_up((agreement - 0.5) * 24), F.lit(0))
        + half_up(completeness * 14)
        + F.when(has_evidence, 4).otherwise(0)
        + F.coalesce(half_up((model_confidence - 0.5) * 16), F.lit(0))
    )
    return _clamp(score).cast("int")


def confidence_factors(best_tier: Column, publishers: Column, strong_sources: Column, agreement: Column,
                       completeness: Column, has_evidence: Column) -> Column:
    n = F.greatest(F.lit(1), publishers)
    return F.array_compact(F.array(
        F.when(best_tier == 1, F.lit("Official regulator or operator source present"))
        .otherwise(F.concat(F.lit("Best available source is tier "), best_tier.cast("string"))),
        F.when(n >= 2, F.concat(n.cast("string"), F.lit(" independent publishers"))).otherwise(F.lit("Single source only")),
        F.when(strong_sources >= 2, F.lit("Multiple high-authority sources")),
        F.when(agreement >= 0.8, F.lit("Sources agree on the key facts")).when(agreement < 0.5, F.lit("Sources disagree on some facts")),
        F.when(completeness >= 0.7, F.lit("Structured data is largely complete")).when(completeness < 0.35, F.lit("Few structured details available")),
        F.when(has_evidence, F.lit("Per-field provenance recorded")),
    ))


def source_inputs(evidence: DataFrame, key: str, publisher: str = "publisher", tier: str = "source_tier") -> DataFrame:
    """Per incident: distinct publishers, best tier (5 when unknown), number of tier 1-2 sources, official flag.

    Publishers are first reduced to one row per (incident, publisher), so a hot incident is spread over its
    publishers before the final small aggregate.
    """
    per_publisher = evidence.groupBy(key, publisher).agg(
        F.min(tier).alias("_best"), F.count_if(F.col(tier) <= 2).alias("_strong"))
    best = F.coalesce(F.min("_best"), F.lit(5))
    return per_publisher.groupBy(key).agg(
        F.count(publisher).alias("source_count"),
        best.cast("int").alias("highest_source_tier"),
        F.sum("_strong").alias("strong_sources"),
        (best == 1).alias("has_official_source"),
    )


def cross_source_agreement(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Share of comparable fields (two or more values) on which all records of a key agree, NULL below two records.

    A single aggregate: a field agrees when its smallest and largest normalised values are equal, so no value list
    is ever collected.
    """
    value = lambda f: F.nullif(F.col(f).cast("string"), F.lit(""))
    aggs = [F.count(F.lit(1)).alias("_records")]
    for f in fields:
        norm = F.lower(F.trim(value(f)))
        aggs += [F.count(value(f)).alias(f"_n_{f}"), F.min(norm).alias(f"_lo_{f}"), F.max(norm).alias(f"_hi_{f}")]
    comparable = reduce(lambda a, b: a + b, [(F.col(f"_n_{f}") >= 2).cast("int") for f in fields])
    agreeing = reduce(lambda a, b: a + b, [((F.col(f"_n_{f}") >= 2) & (F.col(f"_lo_{f}") == F.col(f"_hi_{f}"))).cast("int") for f in fields])
    return records.groupBy(key).agg(*aggs).select(
        key, F.when((F.col("_records") >= 2) & (comparable > 0), agreeing / comparable).alias("agreement"))


def pair_agreement(pairs: list[tuple[Column, Column]]) -> Column:
    """`cross_source_agreement` of exactly two records that already sit in one row."""
    clean = lambda c: F.nullif(F.trim(F.lower(c)), F.lit(""))
    both = [F.nullif(a, F.lit("")).isNotNull() & F.nullif(b, F.lit("")).isNotNull() for a, b in pairs]
    comparable = reduce(lambda a, b: a + b, [x.cast("int") for x in both])
    agreeing = reduce(lambda a, b: a + b, [(x & clean(a).eqNullSafe(clean(b))).cast("int") for x, (a, b) in zip(both, pairs)])
    return F.when(comparable > 0, agreeing / comparable)


def relevance_components(heuristic: Column, model_confidence: Column, sector: Column, tier: Column, age_days: Column,
                         in_region: Column, term_hits: Column, strong_phrase: Column) -> dict[str, Column]:
    """The six parts of the relevance score."""
    return {
        "oilGasRelevance": heuristic / 100 * 20 + F.coalesce(model_confidence * 15, F.lit(8.0)),
        "incidentTerminology": F.least(term_hits, F.lit(4)) * 2.5 + F.when(strong_phrase, 5.0).otherwise(0.0),
        "sectorRelevance": F.when(sector == "unknown", 2.0).when(sector == "integrated", 7.0).otherwise(10.0),
        "sourceQuality": _lookup(TIER_RELEVANCE_POINTS, tier.cast("int")).cast("double"),
        "recency": (F.when(age_days.isNull(), 5.0).when(age_days <= 1, 12.0).when(age_days <= 7, 10.0)
                    .when(age_days <= 14, 8.0).when(age_days <= 30, 6.0).otherwise(2.0)),
        "locationRelevance": F.when(in_region, 8.0).otherwise(4.0),
    }


def score_relevance(df: DataFrame, components: dict[str, Column], related: Column,
                    feed: int = RELEVANCE_FEED, review: int = RELEVANCE_REVIEW) -> DataFrame:
    """Add score, outcome and the reason naming the three largest components; a classifier 'no' vetoes."""
    veto = F.coalesce(~related, F.lit(False))
    order = list(components)
    staged = df.select("*", *[v.alias(f"_part_{k}") for k, v in components.items()], veto.alias("_veto"))
    total = reduce(lambda a, b: a + b, [F.col(f"_part_{k}") for k in order])
    staged = staged.withColumn(
        "relevance_score",
        F.when(F.col("_veto"), 0).otherwise(_clamp(half_up(F.round(total, 9)))).cast("int"))
    score = F.col("relevance_score")
    outcome = (F.when(F.col("_veto"), F.lit("reject")).when(score >= feed, F.lit("feed"))
               .when(score >= review, F.lit("review")).otherwise(F.lit("reject")))
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(f"_part_{k}")).alias("minus"), F.lit(i).alias("position"), F.lit(k).alias("name"))
        for i, k in enumerate(order)]))
    top = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: F.concat(
        s["name"], F.lit("="), half_up(-s["minus"]).cast("string"))), ", ")
    reason = F.when(F.col("_veto"), F.lit("The Oil & Gas relevance classifier rejected the article.")).otherwise(
        F.concat(F.lit("Relevance "), score.cast("string"), F.lit("/100 ("), top, F.lit(") -> "), F.col("outcome"), F.lit(".")))
    staged = staged.withColumn("outcome", outcome)
    return staged.withColumn("relevance_reason", reason).drop("_veto", *[f"_part_{k}" for k in order])
