"""Enumerated values and their display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: taxonomies ---------------------------------------------------------------------
SECTORS = ("upstream", "midstream", "downstream", "integrated", "unknown")
ENVIRONMENTS = ("offshore", "onshore", "subsea", "unknown")
WATER_DEPTHS = ("shallow_water", "deepwater", "ultra_deepwater", "unknown")
LIFECYCLE_STAGES = (
    "design", "drilling", "completion", "commissioning", "production", "injection",
    "intervention", "workover", "suspension", "p_and_a", "unknown",
)
INSTALLATION_TYPES = (
    "fixed_platform", "jack_up", "semi_submersible", "drillship", "fpso", "fso", "tlp", "spar", "wellhead_platform",
    "subsea_installation", "refinery", "pipeline", "terminal", "lng_facility", "gas_processing_plant",
    "compressor_station", "storage_facility", "unknown",
)
WELL_TYPES = ("producer", "injector", "exploration", "appraisal", "development", "disposal", "gas_storage", "unknown")
WELL_STATUSES = (
    "drilling", "completion", "production", "injection", "intervention", "workover", "suspended", "abandoned",
    "p_and_a", "unknown",
)
INCIDENT_TYPES = (
    "fire", "explosion", "blowout", "well_control", "well_integrity", "gas_leak", "oil_leak", "hydrocarbon_release",
    "toxic_gas_release", "loss_of_containment", "oil_spill", "pipeline_leak", "pipeline_rupture",
    "structural_failure", "equipment_failure", "emergency_shutdown", "production_shutdown", "evacuation",
    "marine_incident", "vessel_collision", "helicopter_incident", "crane_incident", "dropped_object", "fatality",
    "injury", "environmental_event", "process_safety_event", "other",
)
WELL_INTEGRITY_CATEGORIES = (
    "primary_barrier_failure", "secondary_barrier_failure", "multiple_barrier_failure", "well_control", "bop",
    "wellhead", "christmas_tree", "tubing", "casing", "cement", "packer", "annulus", "dhsv_scssv",
    "subsea_safety_system", "integrity_monitoring", "loss_of_containment", "structural_integrity", "unknown",
)
BARRIER_FUNCTIONS = ("primary", "secondary", "both", "unknown")
PROCESS_SAFETY_CATEGORIES = (
    "loss_of_primary_containment", "hydrocarbon_release", "fire", "explosion", "toxic_gas_release", "spill",
    "overpressure", "emergency_shutdown", "structural_failure", "unknown",
)
SEVERITIES = ("low", "moderate", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
STATUSES = ("new", "updated", "monitoring", "under_review", "archived")
USER_STATES = ("new", "read", "saved", "archived", "monitoring")
LANGUAGES = ("en", "pt", "es", "fr", "no")
REGIONS = (
    "worldwide", "united_kingdom", "brazil", "united_states", "norway", "europe", "middle_east", "africa",
    "asia_pacific", "latin_america", "north_america", "custom",
)
LEAK_TYPES = (
    "gas_leak", "oil_leak", "hydrocarbon_release", "loss_of_containment", "toxic_gas_release", "pipeline_leak",
)

# --- Fixed values: display text -------------------------------------------------------------------
ACRONYMS = (
    "bop", "fpso", "fso", "tlp", "spar", "lng", "dhsv", "scssv", "h2s", "esd", "psa", "anp", "hse", "uk", "us",
    "usa", "uae", "p&a",
)
LABEL_OVERRIDES = {
    "unknown": "Unknown", "p_and_a": "P&A", "dhsv_scssv": "DHSV / SCSSV", "bop": "BOP", "fpso": "FPSO", "fso": "FSO",
    "tlp": "TLP", "spar": "SPAR", "lng": "LNG", "lng_facility": "LNG Facility", "jack_up": "Jack-up",
    "semi_submersible": "Semi-submersible", "christmas_tree": "Christmas Tree",
    "oil_gas_sector": "Oil & Gas Sector", "leak_release": "Leak / Release",
    "loss_of_containment": "Loss of Containment", "loss_of_primary_containment": "Loss of Primary Containment",
    "us": "US", "united_kingdom": "United Kingdom", "united_states": "United States", "asia_pacific": "Asia-Pacific",
    "middle_east": "Middle East", "latin_america": "Latin America", "north_america": "North America",
    "last_7_days": "Last 7 Days", "last_14_days": "Last 14 Days", "last_30_days": "Last 30 Days",
    "all_time": "All Time", "today": "Today", "shallow_water": "Shallow Water", "deepwater": "Deepwater",
    "ultra_deepwater": "Ultra-deepwater", "incident_date": "Incident Date", "published_at": "Publication Date",
}
NOT_REPORTED = "Not reported"
TIER_LABELS = {
    1: "Tier 1 — Official regulator / government / operator statement",
    2: "Tier 2 — Major international news organisation",
    3: "Tier 3 — Recognised Oil & Gas publication",
    4: "Tier 4 — Regional / local media",
    5: "Tier 5 — Low-authority or unverified source",
}


def label(value: Column) -> Column:
    """Display text of a taxonomy value: an override, an acronym, or capitalised words."""
    words = F.transform(
        F.split(value, "_"),
        lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w))
        .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))),
    )
    override = F.create_map(*[F.lit(x) for pair in LABEL_OVERRIDES.items() for x in pair])
    return (
        F.when(value.isNull() | (value == ""), F.lit(NOT_REPORTED))
        .otherwise(F.coalesce(F.try_element_at(override, value), F.array_join(words, " ")))
    )


def severity_rank(severity: Column) -> Column:
    """0 for low up to 3 for critical."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def tier_label(tier: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in TIER_LABELS.items() for x in pair])
    return F.try_element_at(mapping, tier.cast("int"))
