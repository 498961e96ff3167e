"""O-C1..O-C5: claim rows -> entity summaries, case records, targets.

Claim attributes are STRING (as read from the CSV, ``?``/'' = missing); every
operator here is a per-row projection with conditional arrays, so it is narrow
and runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.core import empty_str_array, explode_with_pos, lookup, non_null_array, strip


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (c != "?")


def _int(c: Column) -> Column:
    return F.when(_present(c), c.try_cast("bigint"))


def _summary(*entries: tuple[str, Column]) -> Column:
    """Ordered MAP label -> values, labels with an empty list left out."""
    return F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(label).alias("k"), arr.alias("v")) for label, arr in entries]),
            lambda e: F.size(e["v"]) > 0,
        )
    )


def _perils_train(incident: Column) -> Column:
    branches = F.when(F.lit(False), empty_str_array())
    for name, perils in vocab.INCIDENT_TO_PERILS.items():
        branches = branches.when(incident == name, F.array(*[F.lit(p) for p in perils]))
    return branches.otherwise(empty_str_array())


def _vehicle(with_year: bool) -> Column:
    make, model, year = F.col("auto_make"), F.col("auto_model"), F.col("auto_year")
    base = strip(F.concat_ws(" ", F.coalesce(make, F.lit("")), F.coalesce(model, F.lit(""))))
    if with_year:
        base = F.when(
            year.isNotNull() & (year != ""), F.concat(base, F.lit(" ("), year, F.lit(")"))
        ).otherwise(base)
    return F.when(make.isNotNull() & (make != ""), F.array(base)).otherwise(empty_str_array())


def _damage_yes() -> Column:
    return F.upper(F.coalesce(F.col("property_damage"), F.lit(""))) == "YES"


def claim_entities(claims: DataFrame, flavour: str = "train") -> DataFrame:
    """O-C1 (``train``) / O-C2 (``index``): add ``entity_summary``."""
    csl = F.col("policy_csl")
    csl_item = F.when(csl.isNotNull() & (csl != ""), F.concat(F.lit("CSL "), csl))
    umbrella = F.coalesce(_int(F.col("umbrella_limit")), F.lit(0))
    umbrella_item = F.when(
        umbrella > 0, F.concat(F.lit("umbrella $"), F.format_number(umbrella, 0))
    )
    premium = F.col("policy_annual_premium")
    premium_item = F.when(
        _present(premium), F.concat(F.lit("$"), F.format_number(premium.try_cast("double"), 2))
    )
    if flavour == "train":
        ded = F.col("policy_deductable")
        ded_item = F.when(ded.isNotNull() & (ded != "") & (ded != "?"), F.concat(F.lit("deductible $"), ded))
        gains = F.col("capital_gains").try_cast("double")
        gains_item = F.when(
            _present(F.col("capital_gains")) & (gains > 0),
            F.concat(F.lit("$"), F.format_number(gains, 0)),
        )
        perils = F.concat(
            _perils_train(F.col("incident_type")),
            F.when(_damage_yes(), F.array(F.lit("property damage"))).otherwise(empty_str_array()),
        )
        injuries = _int(F.col("bodily_injuries"))
        vehicles_n = _int(F.col("number_of_vehicles_involved"))
        witnesses = _int(F.col("witnesses"))
        authority = F.lower(F.coalesce(F.col("authorities_contacted"), F.lit("")))
        summary = _summary(
            ("PERIL", perils),
            ("COVERAGE_TYPE", non_null_array(csl_item, ded_item, umbrella_item)),
            ("MONEY", non_null_array(premium_item, gains_item)),
            ("VEHICLE", _vehicle(with_year=True)),
            (
                "INJURY",
                non_null_array(
                    F.when(injuries > 0, F.concat(F.col("bodily_injuries"), F.lit(" bodily injuries")))
                ),
            ),
            (
                "INCIDENT_DETAIL",
                non_null_array(
                    F.when(
                        vehicles_n > 1,
                        F.concat(F.col("number_of_vehicles_involved"), F.lit(" vehicles involved")),
                    ),
                    F.when(witnesses > 0, F.concat(F.col("witnesses"), F.lit(" witnesses"))),
                    F.when(
                        authority.isin(*vocab.AUTHORITIES), F.concat(authority, F.lit(" contacted"))
                    ),
                ),
            ),
        )
    elif flavour == "index":
        incident = F.col("incident_type")
        severity = F.col("incident_severity")
        perils = F.concat(
            F.when(incident.isNotNull() & (incident != ""), F.array(F.lower(incident))).otherwise(
                empty_str_array()
            ),
            F.when(_damage_yes(), F.array(F.lit("property damage"))).otherwise(empty_str_array()),
        )
        summary = _summary(
            ("PERIL", perils),
            ("COVERAGE_TYPE", non_null_array(csl_item, umbrella_item)),
            ("MONEY", non_null_array(premium_item)),
            (
                "CLAIM_STATUS",
                F.when(severity.isNotNull() & (severity != ""), F.array(F.lower(severity))).otherwise(
                    empty_str_array()
                ),
            ),
            ("VEHICLE", _vehicle(with_year=False)),
        )
    else:
        raise ValueError(f"unknown flavour {flavour!r}")
    return claims.withColumn("entity_summary", summary)


def summary_long(df: DataFrame, key: str, summary: str = "entity_summary") -> DataFrame:
    """Map column -> long rows (key, label, label_pos, value_pos, value); the
    order-preserving form used for checks and for joins."""
    labels = explode_with_pos(df, [key], F.map_entries(F.col(summary)), "label_pos", "e").select(
        key, F.col("e.key").alias("label"), F.col("label_pos").cast("bigint").alias("label_pos"), "e"
    )
    return explode_with_pos(labels, [key, "label", "label_pos"], F.col("e.value"), "value_pos", "value") \
        .withColumn("value_pos", F.col("value_pos").cast("bigint"))


def claim_cases(claims: DataFrame) -> DataFrame:
    """O-C3: case record per claim (summary text, outcome, tier, amount)."""
    incident = F.coalesce(F.col("incident_type"), F.lit(""))
    make = F.coalesce(F.col("auto_make"), F.lit(""))
    model = F.coalesce(F.col("auto_model"), F.lit(""))
    severity = F.coalesce(F.col("incident_severity"), F.lit(""))
    amount = F.coalesce(F.nullif(F.col("total_claim_amount"), F.lit("")).try_cast("double"), F.lit(0.0))
    summary = F.concat_ws(
        ", ",
        F.when(incident != "", F.lower(incident)),
        F.when(make != "", F.concat(make, F.lit(" "), model)),
        F.concat(F.lit("in "), F.coalesce(F.col("incident_state"), F.lit("?"))),
        F.concat(F.lit("severity: "), F.lower(severity)),
    )
    outcome = F.concat(
        F.lit("claim $"),
        F.format_number(amount, 0),
        F.when(F.col("fraud_reported") == "Y", F.lit(" (fraud reported)")).otherwise(F.lit(" (no fraud)")),
    )
    return claims.select(
        F.col("case_id"),
        F.coalesce(F.col("policy_number"), F.col("case_id").cast("string")).alias("policy_id"),
        summary.alias("summary"),
        outcome.alias("outcome"),
        lookup(vocab.SEVERITY_TO_TIER, severity, "MODERATE").alias("risk_tier"),
        amount.alias("claim_amount"),
    )


def claim_targets(claims: DataFrame) -> DataFrame:
    """O-C4: binary severe flag (default 0) and the amount target."""
    return claims.select(
        "case_id",
        lookup(vocab.SEVERITY_TO_TARGET, F.col("incident_severity"), 0.0).alias("severe"),
        F.coalesce(F.nullif(F.col("total_claim_amount"), F.lit("")).try_cast("double"), F.lit(0.0)).alias(
            "claim_amount"
        ),
    )


def label_balance(targets: DataFrame) -> DataFrame:
    """O-C5: counts and share of severe / not severe (one global aggregate)."""
    return targets.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("severe")).cast("bigint").alias("n_severe"),
        (F.count(F.lit(1)) - F.sum(F.col("severe"))).cast("bigint").alias("n_not_severe"),
        F.round(F.avg(F.col("severe")), 6).alias("share_severe"),
    )
