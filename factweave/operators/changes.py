"""Versions of a fact: conservative merge, material changes, fingerprint, recorded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import fingerprint
from factweave.operators.ordered import running_merge, with_previous
from factweave.operators.skew import keep_first

SNAPSHOT_COLUMNS = (
    "fatalities", "injuries", "missing_persons", "evacuated_persons", "severity", "severity_score",
    "environmental_impact", "production_impact", "shutdown", "operator", "asset", "well_name",
    "is_well_integrity_related", "well_integrity_category", "suspected_failed_component",
    "barrier_function_impacted", "is_process_safety_event", "process_safety_category", "cause",
    "has_official_source", "incident_date",
)
FINGERPRINT_COLUMNS = (
    "fatalities", "injuries", "missing_persons", "evacuated_persons", "severity", "environmental_impact",
    "production_impact", "shutdown", "operator", "asset", "well_name", "is_well_integrity_related",
    "well_integrity_category", "suspected_failed_component", "barrier_function_impacted",
    "is_process_safety_event", "process_safety_category", "cause", "has_official_source", "incident_date",
)


def merge_versions(versions: DataFrame, key: str, bucket: str, order: list[str], largest=("relevance_score",),
                   earliest=("incident_date", "incident_type"), latest=None) -> DataFrame:
    """Running state of an incident: later reports fill gaps or replace values, but never erase one."""
    present = set(versions.columns)
    taken = {key, bucket, *order, *largest, *earliest}
    latest = [c for c in versions.columns if c not in taken] if latest is None else list(latest)
    return running_merge(versions, key, bucket, order, latest,
                         [c for c in earliest if c in present], [c for c in largest if c in present])


def change_rules(before: str, after: str = "") -> list[tuple[str, Column, Column]]:
    """(code, condition, description) of every material change, in reporting order."""
    b = lambda n: F.col(before + n)
    a = lambda n: F.col(after + n)
    is_true = lambda c: F.coalesce(c, F.lit(False))
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    appeared = lambda n: b(n).isNull() & a(n).isNotNull()
    moved = lambda n: a(n).isNotNull() & ~b(n).eqNullSafe(a(n))
    rise = a("severity_score") - b("severity_score")
    well = ("is_well_integrity_related", "well_integrity_category", "suspected_failed_component", "barrier_function_impacted")
    well_moved = ~F.struct(*[b(n) for n in well]).eqNullSafe(F.struct(*[a(n) for n in well]))
    stopped = is_true(a("shutdown")) & ~is_true(b("shutdown"))
    return [
        ("fatalities_confirmed", b("fatalities").isNull() & (a("fatalities") > 0), say("Fatalities confirmed: ", a("fatalities"), ".")),
        ("fatalities_increased", a("fatalities") > b("fatalities"), say("Fatalities revised from ", b("fatalities"), " to ", a("fatalities"), ".")),
        ("injuries_changed", moved("injuries"), F.when(b("injuries").isNull(), say("Injuries reported: ", a("injuries"), "."))
         .otherwise(say("Injuries revised from ", b("injuries"), " to ", a("injuries"), "."))),
        ("missing_persons", moved("missing_persons") & (a("missing_persons") > 0), say("Missing persons: ", a("missing_persons"), ".")),
        ("severity_increased", rise >= 15, say("Severity raised from ", b("severity"), " to ", a("severity"), ".")),
        ("major_escalation", rise >= 30, say("Major escalation reported.")),
        ("environmental_impact", appeared("environmental_impact"), say("Environmental impact reported.")),
        ("official_investigation", is_true(a("has_official_source")) & ~is_true(b("has_official_source")),
         say("An official source or investigation update is now attached.")),
        ("cause_confirmed", appeared("cause"), say("A cause has been reported.")),
        ("production_shutdown", stopped | appeared("production_impact"),
         F.when(stopped, F.lit("Production shutdown reported.")).otherwise(F.lit("Production impact reported."))),
        ("well_integrity_information", well_moved & is_true(a("is_well_integrity_related")), say("New well integrity information reported.")),
        ("well_control_development",
         ~b("well_integrity_category").eqNullSafe(a("well_integrity_category"))
         & a("well_integrity_category").isin("well_control", "multiple_barrier_failure"),
         say("Significant well control development reported.")),
        ("incident_date_established", appeared("incident_date"), say("Incident date established: ", a("incident_date"), ".")),
        ("operator_statement", (b("operator").isNull() | (b("operator") == "")) & a("operator").isNotNull(),
         say("Operator identified: ", a("operator"), ".")),
    ]


def material_changes(pairs: DataFrame, before: str = "prev_", after: str = "") -> DataFrame:
    """Add `changes`, `descriptions`, `fingerprint`, `is_material` and `change_reason` to before/after rows."""
    rules = change_rules(before, after)
    hit = lambda value: lambda rule: F.when(F.coalesce(rule[1], F.lit(False)), value(rule))
    codes = F.array_compact(F.array(*map(hit(lambda r: F.lit(r[0])), rules)))
    texts = F.array_compact(F.array(*map(hit(lambda r: r[2]), rules)))
    staged = pairs.select("*", codes.alias("changes"), texts.alias("descriptions"),
                          fingerprint(*[F.col(after + c) for c in FINGERPRINT_COLUMNS]).alias("fingerprint"))
    found = F.size("changes") > 0
    reason = F.when(found, F.concat(F.lit("Material update: "), F.array_join("changes", ", "), F.lit("."))).otherwise(
        F.lit("No change in the reported facts — treated as a republication (no notification)."))
    return staged.select("*", found.alias("is_material"), reason.alias("change_reason"))


def detect_changes(versions: DataFrame, key: str, bucket: str, order: list[str]) -> DataFrame:
    """Compare every version of a fact with the one before it; first versions have nothing to compare with."""
    linked = with_previous(versions, key, bucket, order, list(SNAPSHOT_COLUMNS))
    return material_changes(linked.filter("has_prev"))


def record_once(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first update with a given fingerprint per incident."""
    return keep_first(updates, [key, "fingerprint"], *order)
