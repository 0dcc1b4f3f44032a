"""Model responses: raw text to typed records. Only unambiguous defects are repaired, everything else is rejected."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factweave import taxonomy as X
from factweave.schemas import clock_time, in_range, iso_date, one_of, reported_text

# --- Fixed values: strings that mean an absent value anywhere in a response ------------------------
NULLISH = ("null", "none", "n/a", "na", "not reported", "not specified", "not available", "undefined", "")

TEXT_FIELDS = ("country", "region", "city", "basin", "block", "field", "operator", "company", "licenceHolder", "drillingContractor",
               "serviceCompany", "pipelineOperator", "asset", "installation", "vessel", "wellName", "wellNumber",
               "suspectedFailedComponent", "environmentalImpact", "productionImpact", "assetDamage")
OPTIONAL_ENUMS = {
    "installationType": X.INSTALLATION_TYPES, "wellType": X.WELL_TYPES, "wellStatus": X.WELL_STATUSES,
    "waterDepthCategory": X.WATER_DEPTHS, "wellIntegrityCategory": X.WELL_INTEGRITY_CATEGORIES,
    "barrierFunctionImpacted": X.BARRIER_FUNCTIONS, "processSafetyCategory": X.PROCESS_SAFETY_CATEGORIES,
}
DEFAULTED_ENUMS = {
    "environment": (X.ENVIRONMENTS, "unknown"), "lifecycleStage": (X.LIFECYCLE_STAGES, "unknown"),
    "incidentType": (X.INCIDENT_TYPES, "other"), "severity": (X.SEVERITIES, "low"),
}
COUNTS = ("fatalities", "injuries", "missingPersons", "evacuatedPersons")
FLAGS = ("isWellIntegrityRelated", "isProcessSafetyEvent", "hydrocarbonRelease")


def _cut(text: str | None) -> str | None:
    """The first balanced {...} of a text, braces inside strings ignored."""
    if text is None:
        return None
    start = text.find("{")
    depth, inside, escaped = 0, False, False
    for i, char in enumerate(text[start:] if start >= 0 else ""):
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif char == '"':
            inside = not inside
        elif not inside and char in "{}":
            depth += 1 if char == "{" else -1
            if depth == 0:
                return text[start:start + i + 1]
    return None


@F.pandas_udf(StringType())
def balanced_object(texts: pd.Series) -> pd.Series:
    return texts.map(_cut)


def json_object(raw: Column) -> Column:
    """The JSON object inside a response: fence removed, prose around it cut, trailing commas dropped."""
    text = F.trim(raw)
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    inner = F.when(text.rlike(fence), F.trim(F.regexp_extract(text, fence, 1))).otherwise(text)
    return F.regexp_replace(balanced_object(inner), r",\s*([}\]])", "$1")


def _clean(value: Column) -> Column:
    """Trimmed string; nullish spellings become NULL."""
    trimmed = F.trim(value)
    return F.when(~F.lower(trimmed).isin(*NULLISH), trimmed)


def ingest_responses(responses: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """One row per response: `key`, `violations` (empty when accepted) and the typed record.

    Required fields reject the response; optional ones are nulled when invalid.
    """
    fields = F.from_json("_json", "map<string,string>")
    staged = responses.select(key, json_object(F.col(raw)).alias("_json")).withColumn("m", fields)
    get = lambda name: _clean(F.try_element_at("m", F.lit(name)))
    related = F.lower(get("isOilAndGasRelated"))
    confidence = get("confidence").try_cast("double")
    enum_text = lambda name, allowed, default: F.when(get(name).isNull(), F.lit(default)).otherwise(get(name))
    flag = lambda name: F.when(F.lower(get(name)) == "true", True).when(F.lower(get(name)) == "false", False)
    count = lambda name: F.when(get(name).rlike(r"^\d+$"), get(name).try_cast("int"))
    listed = lambda name: F.coalesce(F.filter(F.transform(F.from_json(F.try_element_at("m", F.lit(name)), "array<string>"), _clean),
                                              lambda x: x.isNotNull()), F.array().cast("array<string>"))
    checks = [
        ("json", F.col("m").isNotNull()),
        ("isOilAndGasRelated", related.isin("true", "false")),
        ("oilAndGasSector", get("oilAndGasSector").isin(*X.SECTORS)),
        ("confidence", confidence.between(0, 1)),
        ("title", get("title").isNotNull()),
        ("summary", get("summary").isNotNull()),
        ("highlights", F.size(listed("highlights")) <= 12),
        *[(name, enum_text(name, allowed, default).isin(*allowed)) for name, (allowed, default) in DEFAULTED_ENUMS.items()],
        ("secondaryIncidentTypes", (F.size(listed("secondaryIncidentTypes")) <= 6)
         & F.forall(listed("secondaryIncidentTypes"), lambda t: t.isin(*X.INCIDENT_TYPES))),
    ]
    violations = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))
    return staged.select(
        key,
        violations.alias("violations"),
        (related == "true").alias("isOilAndGasRelated"), get("oilAndGasSector").alias("oilAndGasSector"), confidence.alias("confidence"),
        get("title").alias("title"), get("summary").alias("summary"), listed("highlights").alias("highlights"),
        iso_date(get("incidentDate")).alias("incidentDate"), clock_time(get("incidentTime")).alias("incidentTime"),
        F.when(get("countryCode").rlike("^[A-Z]{2}$"), get("countryCode")).alias("countryCode"),
        in_range(get("latitude").try_cast("double"), -90, 90).alias("latitude"), in_range(get("longitude").try_cast("double"), -180, 180).alias("longitude"),
        *[reported_text(get(name)).alias(name) for name in TEXT_FIELDS],
        *[one_of(get(name), allowed).alias(name) for name, allowed in OPTIONAL_ENUMS.items()],
        *[enum_text(name, allowed, default).alias(name) for name, (allowed, default) in DEFAULTED_ENUMS.items()],
        listed("secondaryIncidentTypes").alias("secondaryIncidentTypes"),
        *[count(name).alias(name) for name in COUNTS],
        *[flag(name).alias(name) for name in FLAGS],
    )


def accepted(ingested: DataFrame) -> DataFrame:
    return ingested.filter(F.size("violations") == 0).drop("violations")


def rejected(ingested: DataFrame, key: str) -> DataFrame:
    return ingested.filter(F.size("violations") > 0).select(key, "violations")
