"""Relevance, extraction, scores and changes on small hand-written rows."""

import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factweave import rules as R
from factweave.functions import text as T
from factweave.operators import changes, extract, relevance, scoring
from factweave.terms import TermLists

NOW = datetime(2026, 3, 15, 12)


def verdicts(spark, rows, **options):
    df = spark.createDataFrame([(i, t, e, p, 4) for i, (t, e, p) in enumerate(rows)], "id int, title string, excerpt string, publisher string, source_tier int")
    return [r for r in relevance.evaluate_relevance(df, **options).orderBy("id").collect()]


@pytest.mark.parametrize("title, domain", [
    ("Two hurt in copper mine collapse", "mining"), ("Bridge collapse stops traffic", "construction"), ("Passenger plane lands after engine fire", "aviation"),
    ("Lorry crash shuts road", "road"), ("Tram derailment injures ten", "rail"), ("Hotel fire forces guests out", "residential"), ("Barn lost in fire", "agriculture"),
    ("Fire at dairy plant", "pharma-food"), ("Fire in wind turbine", "renewables-nuclear"), ("Explosion at steel mill", "generic-industry"), ("Ferry collision in fog", "unrelated-marine"),
    ("Valve market outlook raised after incident", "market-news"),
])
def test_exclusions(spark, title, domain):
    row = verdicts(spark, [(title, None, "Paper")])[0]
    assert row.exclusion_domain == domain and not row.passed and row.score == 0


def test_anchor_rescues_but_not_market_news(spark):
    rescued, market = verdicts(spark, [("Helicopter ditches near offshore platform, gas leak feared", None, "Paper"), ("Drilling rig market size to grow after blowout", None, "Paper")])
    assert rescued.passed and rescued.overridden_by_anchor and rescued.exclusion_domain == "aviation"
    assert not market.passed and market.exclusion_domain == "market-news"


def test_whole_words_and_plurals(spark):
    soil, leaks, fired = verdicts(spark, [("Soil collapse at farmhouse", None, ""), ("Gas leaks at refineries", None, ""), ("Oil boss fired", None, "")])
    assert not soil.passed and "oil" not in soil.matched_industry_terms
    assert leaks.passed and "leak" in leaks.matched_event_terms and leaks.matched_strong_phrases == ["gas leak"]
    assert not fired.passed and fired.reason == "No incident/event terminology found."


def test_event_alone_is_not_enough(spark):
    row = verdicts(spark, [("Large fire in the old town", None, "Paper")])[0]
    assert row.has_event_signal and not row.has_industry_signal and not row.passed and row.score <= 40


def test_user_keywords(spark):
    rows = [("Gas leak at refinery near Lisboa", None, "Paper")]
    plain, wanted = verdicts(spark, rows)[0], verdicts(spark, rows, include_keywords=["LISBOA"])[0]
    blocked = verdicts(spark, rows, exclude_keywords=["lisboa"])[0]
    assert wanted.score == min(100, plain.score + 10)
    assert not blocked.passed and blocked.score == 0 and blocked.exclusion_domain == "user-keyword" and blocked.matched_event_terms == []


def test_terms_are_a_parameter(spark):
    table = spark.createDataFrame([("industry", "rørledning", 0), ("event", "utslipp", 1), ("strong", "oljeutslipp", 2), ("well", "brønn", 3)], "kind string, term string, position int")
    terms = TermLists.from_table(table)
    row = verdicts(spark, [("Utslipp fra rørledning ved Bergen", None, "")], terms=terms)[0]
    assert row.passed and row.matched_industry_terms == ["rørledning"]
    with pytest.raises(ValueError):
        TermLists(("-oil",), (), (), ())


@pytest.mark.parametrize("title, strong", [
    ("Incêndio na refinaria: vazamento de gás", ["vazamento de gas"]), ("Fuga de gas en el gasoducto, dos heridos", ["fuga de gas"]),
    ("Fuite de pétrole près du terminal pétrolier", ["fuite de petrole"]), ("Brønnkontroll tapt på boreskip etter utblåsning", ["brønnkontroll", "utblasning"]),
    ("Arrêt d'urgence: rupture d'oléoduc", ["rupture d'oleoduc", "arret d'urgence"]),
])
def test_five_languages(spark, title, strong):
    row = verdicts(spark, [(title, None, "Paper")])[0]
    assert row.passed and row.matched_strong_phrases == strong


def extract_one(spark, title, excerpt, publisher="Coast Paper"):
    df = spark.createDataFrame([(1, title, excerpt, publisher, datetime(2026, 3, 1, 8))], "id int, title string, excerpt string, publisher string, published_at timestamp_ntz")
    return extract.consequences(extract.extract_incidents(df, ["id"])).first()


def test_extraction(spark):
    row = extract_one(spark, "Blowout on the jack-up rig Nordlys II", "Kappa Energy said two workers were injured and 120 people were evacuated in Danish North Sea waters. Production was halted near block 9/3a.")
    assert (row.incident_type, row.country, row.country_code) == ("blowout", "Denmark", "DK")
    assert (row.injuries, row.evacuated_persons, row.fatalities) == (2, 120, None)
    assert row.asset == "Nordlys II" and row.operator == "Kappa Energy" and row.installation_type == "jack_up"
    assert row.block == "block 9/3a" and row.production_impact and row.production_interruption is True
    assert row.well_control_event is True and row.fire is None and row.incident_date == date(2026, 3, 1)
    assert row.environment == "offshore" and row.model_severity == "critical"


def test_zero_is_not_null(spark):
    row = extract_one(spark, "Gas leak at refinery", "No fatalities were reported and no injuries.")
    assert (row.fatalities, row.injuries, row.missing_persons) == (0, 0, None)


def test_publisher_is_not_the_operator(spark):
    row = extract_one(spark, "Fire at the refinery", "Vega Petroleum reports a fire.", publisher="Vega Petroleum News")
    assert row.operator is None


FACTS = ("fatalities int, injuries int, missing_persons int, evacuated_persons int, incident_type string, secondary_incident_types array<string>, is_well_integrity_related boolean, "
         "well_integrity_category string, is_process_safety_event boolean, hydrocarbon_release boolean, environmental_impact string, production_impact string, shutdown boolean, fire boolean, "
         "explosion boolean, spill boolean, model_severity string")


def severity(spark, **facts):
    names = [p.split()[0] for p in FACTS.split(", ")]
    values = {**dict.fromkeys(names), "incident_type": "other", "secondary_incident_types": [], **facts}
    return scoring.score_severity(spark.createDataFrame([tuple(values[n] for n in names)], FACTS)).first()


def test_severity(spark):
    assert severity(spark).severity_score == 10 and severity(spark).severity == "low"
    assert severity(spark, fatalities=0).severity_rule_score == severity(spark).severity_rule_score
    row = severity(spark, fatalities=5, incident_type="blowout")
    assert row.severity_score == 100 and row.severity == "critical" and "5 fatalities reported" in row.severity_factors
    blended = severity(spark, incident_type="fire", fire=True, model_severity="critical")
    assert (blended.severity_rule_score, blended.severity_score) == (33, 47)
    assert severity(spark, environmental_impact="Widespread slick").severity_rule_score == 24


def test_confidence(spark):
    score = lambda **k: spark.range(1).select(scoring.confidence_score(*[F.lit(k.get(n, d)).cast(t) for n, d, t in (
        ("tier", 5, "int"), ("pubs", 1, "int"), ("strong", 0, "int"), ("agreement", None, "double"), ("complete", 0.0, "double"), ("model", None, "double"), ("evidence", False, "boolean"))])).first()[0]
    assert score() == 0
    assert score(tier=1, pubs=4, strong=2, agreement=1.0, complete=1.0, model=1.0, evidence=True) == 100
    assert score(tier=3, pubs=2, agreement=0.0) == 25 + 8 - 12
    assert score(tier=3, pubs=3, agreement=0.0, model=0.03) == 25 + 13 - 12 - 8  # -7.52 rounds to -8


def test_agreement_and_completeness(spark):
    df = spark.createDataFrame([(1, "A ", "x"), (1, "a", "y"), (2, "A", None), (3, None, None), (3, "b", None)], "id int, p string, q string")
    got = {r.id: r.agreement for r in scoring.cross_source_agreement(df, "id", ["p", "q"]).collect()}
    assert got == {1: 0.5, 2: None, 3: None}


SNAP = ("fatalities int, injuries int, missing_persons int, evacuated_persons int, severity string, severity_score int, environmental_impact string, production_impact string, shutdown boolean, operator string, "
        "asset string, well_name string, is_well_integrity_related boolean, well_integrity_category string, suspected_failed_component string, barrier_function_impacted string, is_process_safety_event boolean, "
        "process_safety_category string, cause string, has_official_source boolean, incident_date date")


def change(spark, before, after):
    names = [p.split()[0] for p in SNAP.split(", ")]
    base = {**dict.fromkeys(names), "severity": "low", "severity_score": 20, "has_official_source": False}
    rows = [(1, 1, i, *[{**base, **x}[n] for n in names]) for i, x in enumerate((before, {**before, **after}))]
    df = spark.createDataFrame(rows, "id int, bucket int, version int, " + SNAP)
    return changes.detect_changes(df, "id", "bucket", ["version"]).first()


@pytest.mark.parametrize("before, after, code", [
    ({}, {"fatalities": 1}, "fatalities_confirmed"), ({"fatalities": 1}, {"fatalities": 3}, "fatalities_increased"), ({}, {"injuries": 0}, "injuries_changed"),
    ({"injuries": 4}, {"injuries": 2}, "injuries_changed"), ({}, {"missing_persons": 2}, "missing_persons"), ({}, {"severity_score": 35}, "severity_increased"),
    ({}, {"environmental_impact": "slick"}, "environmental_impact"), ({}, {"has_official_source": True}, "official_investigation"), ({}, {"cause": "corrosion"}, "cause_confirmed"),
    ({}, {"shutdown": True}, "production_shutdown"), ({}, {"incident_date": date(2026, 1, 1)}, "incident_date_established"), ({"operator": ""}, {"operator": "Kappa"}, "operator_statement"),
    ({}, {"is_well_integrity_related": True, "well_integrity_category": "bop"}, "well_integrity_information"), ({}, {"well_integrity_category": "well_control"}, "well_control_development"),
])
def test_material(spark, before, after, code):
    assert code in change(spark, before, after).changes


def test_not_material(spark):
    same = change(spark, {"fatalities": 2}, {})
    assert not same.is_material and same.changes == []
    assert change(spark, {"fatalities": 2}, {"fatalities": 1}).changes == []
    assert change(spark, {}, {"severity_score": 34}).changes == []
    assert change(spark, {}, {"fatalities": 0}).changes == []
    assert change(spark, {}, {"severity_score": 50}).changes == ["severity_increased", "major_escalation"]


def test_needed_words_never_hide_a_match(spark):
    """Texts made of pieces of the patterns: `matches` finds what the bare pattern finds, and nearly every pattern tells words."""
    patterns = [p for *_, ps in R.EXCLUSION_DOMAINS for p in ps] + [*R.ANCHORS] + [p for _, p in R.INCIDENT_TYPE_RULES + R.WELL_INTEGRITY_RULES + R.INSTALLATION_RULES]
    patterns += [p for c in R.COUNTRIES for p in c[2:] if p] + [p for ps in R.CASUALTY_PATTERNS.values() for p in ps] + [*R.NO_CASUALTY_PATTERNS.values(), R.BLOCK, R.WELL_NUMBER, r"a|b\w+", r"(?:ab)?c", r"x{0,2}yz"]
    rng = random.Random(3)
    parts = sorted({w for p in patterns for w in re.findall(r"[A-Za-z0-9]+(?: [a-z]+)*", p)})
    texts = [(" ".join(rng.choices(parts, k=6)) * rng.choice([1, 1, 0]),) for _ in range(150)] + [(t.upper(),) for t in ("3 workers killed", "no injuries", "block 22/4b")] + [(None,)]
    df = spark.createDataFrame(texts, "t string")
    differ = [F.count_if(~T.matches(F.col("t"), p).eqNullSafe(F.col("t").rlike(p))).alias(str(i)) for i, p in enumerate(patterns)]
    assert set(df.agg(*differ).first()) == {0}
    assert sum(bool(T.needed_words(p)[0]) for p in patterns) >= 0.95 * len(patterns)
    assert T.needed_words(r"(?i)\bno (injuries|one was (injured|hurt))\b") == (("injuries", "one was "), True)
    assert T.needed_words(r"\w+") == ((), False) and T.needed_words(r"\p{L}+ab") == ((), False)
