"""Vocabulary of the risk pipeline.

FIXED VALUES: everything in this module must equal the values the original
pipeline uses (phrase lists, feature names and their order, display names,
lookup scores, thresholds, tier names).  They are data, not logic; the
operators turn them into broadcastable DataFrames or literal map columns.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: gazetteer phrases per entity label, in their original order.
# ---------------------------------------------------------------------------
COVERAGE_TYPE_PHRASES = [
    "general liability",
    "commercial general liability",
    "professional liability",
    "errors and omissions",
    "workers compensation",
    "workers' compensation",
    "property damage",
    "bodily injury",
    "umbrella coverage",
    "excess liability",
    "commercial auto",
    "inland marine",
    "cyber liability",
    "directors and officers",
    "employment practices liability",
    "business interruption",
    "product liability",
    "completed operations",
]

PERIL_PHRASES = [
    "fire",
    "flood",
    "earthquake",
    "wind damage",
    "hail damage",
    "water damage",
    "theft",
    "vandalism",
    "lightning",
    "explosion",
    "collapse",
    "smoke damage",
    "hurricane",
    "tornado",
    "windstorm",
]

CLAIM_STATUS_PHRASES = [
    "open claim",
    "closed claim",
    "settled",
    "denied",
    "pending review",
    "under investigation",
    "subrogation",
]

PROPERTY_TYPE_PHRASES = [
    "wood-frame residential",
    "masonry commercial",
    "steel frame",
    "fire-resistive",
    "mixed-use",
    "frame construction",
    "joisted masonry",
    "non-combustible",
    "modified fire-resistive",
]

GAZETTEER = (
    [("COVERAGE_TYPE", p) for p in COVERAGE_TYPE_PHRASES]
    + [("PERIL", p) for p in PERIL_PHRASES]
    + [("CLAIM_STATUS", p) for p in CLAIM_STATUS_PHRASES]
    + [("PROPERTY_TYPE", p) for p in PROPERTY_TYPE_PHRASES]
)

# FIXED VALUES: token pattern of a policy number ("PLY-2024-00892").
POLICY_NUMBER_REGEX = r"[A-Z]{2,4}-\d{4}-\d{3,6}"


# ---------------------------------------------------------------------------
# FIXED VALUES: the 28 model features, in model column order, and their
# display names.
# ---------------------------------------------------------------------------
FEATURE_NAMES = [
    "entity_count_total",
    "entity_count_money",
    "entity_count_peril",
    "entity_count_coverage",
    "entity_count_claim_status",
    "entity_count_property_type",
    "entity_count_vehicle",
    "has_open_claim",
    "has_denied_claim",
    "has_fire_peril",
    "has_flood_peril",
    "has_earthquake_peril",
    "has_wind_peril",
    "has_cyber_coverage",
    "has_umbrella_coverage",
    "max_monetary_value",
    "mean_monetary_value",
    "num_monetary_values",
    "prior_claims_indicator",
    "property_risk_score",
    "coverage_breadth",
    "peril_diversity",
    "bodily_injury_count",
    "vehicles_involved",
    "witness_count",
    "police_involved",
    "vehicle_age",
    "multi_vehicle_incident",
]

FEATURE_DISPLAY_NAMES = {
    "entity_count_total": "Total entities in document",
    "entity_count_money": "Monetary values mentioned",
    "entity_count_peril": "Number of perils mentioned",
    "entity_count_coverage": "Coverage types mentioned",
    "entity_count_claim_status": "Claim statuses mentioned",
    "entity_count_property_type": "Property types mentioned",
    "entity_count_vehicle": "Vehicles mentioned",
    "has_open_claim": "Open claim present",
    "has_denied_claim": "Denied claim present",
    "has_fire_peril": "Fire peril present",
    "has_flood_peril": "Flood peril present",
    "has_earthquake_peril": "Earthquake peril present",
    "has_wind_peril": "Wind peril present",
    "has_cyber_coverage": "Cyber coverage requested",
    "has_umbrella_coverage": "Umbrella coverage present",
    "max_monetary_value": "Highest monetary value",
    "mean_monetary_value": "Average monetary value",
    "num_monetary_values": "Count of monetary references",
    "prior_claims_indicator": "Prior claims history",
    "property_risk_score": "Property construction risk",
    "coverage_breadth": "Breadth of coverage requested",
    "peril_diversity": "Variety of perils",
    "bodily_injury_count": "Bodily injuries reported",
    "vehicles_involved": "Vehicles involved in incident",
    "witness_count": "Witnesses present",
    "police_involved": "Police contacted",
    "vehicle_age": "Vehicle age (years)",
    "multi_vehicle_incident": "Multi-vehicle incident",
}

# FIXED VALUES: construction type -> risk score, and the default score.
PROPERTY_RISK = {
    "fire-resistive": 0.1,
    "modified fire-resistive": 0.2,
    "non-combustible": 0.25,
    "masonry commercial": 0.3,
    "joisted masonry": 0.5,
    "steel frame": 0.4,
    "mixed-use": 0.6,
    "frame construction": 0.7,
    "wood-frame residential": 0.8,
}
DEFAULT_PROPERTY_RISK = 0.5
TOP_K_FACTORS = 5
VEHICLE_BASE_YEAR = 2024

# FIXED VALUES: claim-row vocab.
INCIDENT_TO_PERILS = {
    "Single Vehicle Collision": ["collision"],
    "Vehicle Theft": ["theft"],
    "Multi-vehicle Collision": ["collision", "multi-vehicle"],
    "Parked Car": ["vandalism"],
}
SEVERITY_TO_TARGET = {
    "Trivial Damage": 0.0,
    "Minor Damage": 0.0,
    "Major Damage": 1.0,
    "Total Loss": 1.0,
}
SEVERITY_TO_TIER = {
    "Trivial Damage": "LOW",
    "Minor Damage": "MODERATE",
    "Major Damage": "HIGH",
    "Total Loss": "CRITICAL",
}
AUTHORITIES = ["police", "fire", "ambulance"]

# FIXED VALUES: tiers, cut points and display ranges.
TIERS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]
TIER_ORDER = {"LOW": 0, "MODERATE": 1, "HIGH": 2, "CRITICAL": 3}
TIER_THRESHOLDS = (0.25, 0.50, 0.75)
TIER_DISPLAY_RANGE = {
    "LOW": (0.0, 0.35),
    "MODERATE": (0.25, 0.65),
    "HIGH": (0.50, 0.85),
    "CRITICAL": (0.70, 1.0),
}
SEVERITY_STRATA = ["Trivial Damage", "Minor Damage", "Major Damage", "Total Loss"]

# FIXED VALUES: upload validation.
MAX_UPLOAD_MB = 25
MAX_PAGES = 200
PDF_MAGIC = "%PDF-"

# FIXED VALUES: similarity search.
DEFAULT_TOP_K = 5
SEARCH_THRESHOLD = 0.3
FILING_CASE_ID_OFFSET = 10000

# FIXED VALUES: latency histogram bucket edges (upper bounds, +Inf last).
SIMILARITY_BUCKETS = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0, float("inf")]

# FIXED VALUES: narrative fallbacks and messages.
EMPTY_NARRATIVE = "No narrative generated."
EMPTY_SUBMISSION_TEXT = "empty submission"
