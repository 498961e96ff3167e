"""Derived input views: the driver's TPC-H-like tables re-read as the
insurance domain (claims, submission pages, model scores, factor values,
narratives, request events, query/case vectors).

Every view is a narrow projection of one scanned table (plus, for ``claims``,
one shuffle join to ``customer`` and a broadcast of the 25-row ``nation``),
so column pruning and filter pushdown reach the parquet scan.  The DuckDB
twins of these formulas are in ``plans/sql_views.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.core import pick

# Fixed synthetic vocab of the claims view (ours, not from the original data).
AUTO_MAKES = ["Toyota", "Honda", "Ford", "Dodge", "BMW"]
AUTO_MODELS = ["Camry", "Neon", "A5"]
INCIDENT_TYPES = list(vocab.INCIDENT_TO_PERILS)
PRIORITY_TO_SEVERITY = {
    "1-URGENT": "Total Loss",
    "2-HIGH": "Major Damage",
    "3-MEDIUM": "Minor Damage",
    "4-NOT SPECIFIED": "Trivial Damage",
    "5-LOW": "",
}
CSL_VALUES = ["100/300", "250/500", "500/1000"]
PROPERTY_DAMAGE_VALUES = ["YES", "NO", "?"]
AUTHORITY_VALUES = ["Police", "Fire", "Ambulance", "Other", "None"]

# Tables of bounded, fixed size (TPC-H dimension tables) that may be broadcast.
FIXED_SIZE_TABLES = {"region": 5, "nation": 25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, as the scan splits it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim row per order, every attribute a STRING as in the claim CSV."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(
        F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    s = lambda x: x.cast("string")
    multi = (k % 4) == 2
    return j.select(
        k.alias("case_id"),
        pick(INCIDENT_TYPES, k % 4).alias("incident_type"),
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in PRIORITY_TO_SEVERITY.items() for x in kv]),
            F.col("o_orderpriority"),
        ).alias("incident_severity"),
        F.col("n_name").alias("incident_state"),
        pick(PROPERTY_DAMAGE_VALUES, ck % 3).alias("property_damage"),
        F.format_string("PLY-%d-%05d", F.year("o_orderdate"), k).alias("policy_number"),
        pick(CSL_VALUES, ck % 3).alias("policy_csl"),
        s(F.lit(500) * (F.lit(1) + ck % 4)).alias("policy_deductable"),
        F.when(F.col("c_acctbal") < 0, F.lit("?"))
        .otherwise(F.format_string("%.2f", F.col("c_acctbal")))
        .alias("policy_annual_premium"),
        s(F.when(k % 5 == 0, F.lit(1000000) * (F.lit(1) + ck % 4)).otherwise(F.lit(0))).alias(
            "umbrella_limit"
        ),
        s(F.lit(1000) * (ck % 7)).alias("capital_gains"),
        pick(AUTO_MAKES, ck % 5).alias("auto_make"),
        pick(AUTO_MODELS, k % 3).alias("auto_model"),
        s(F.lit(1995) + k % 20).alias("auto_year"),
        s(k % 3).alias("bodily_injuries"),
        s(F.when(multi, F.lit(2) + ck % 3).otherwise(F.lit(1))).alias("number_of_vehicles_involved"),
        s(ck % 4).alias("witnesses"),
        pick(AUTHORITY_VALUES, k % 5).alias("authorities_contacted"),
        F.format_string("%.2f", F.col("o_totalprice")).alias("total_claim_amount"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Y")).otherwise(F.lit("N")).alias("fraud_reported"),
    )


def submission_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of submission text per line item; document = order.

    Pages carry gazetteer phrases picked by moduli, ``$`` amounts, a policy
    number, a claim status, runs of blanks/tabs and blank lines, and a few
    near-misses (capitalised ``Fire``, ``fireman``) that must not match.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    p, sp, ln, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_orderkey")
    cov = vocab.COVERAGE_TYPE_PHRASES
    per = vocab.PERIL_PHRASES
    text = F.concat(
        F.lit("Insured account "), p.cast("string"), F.lit("  submission "), k.cast("string"), F.lit("\n"),
        F.lit("Coverage requested:  "), pick(cov, p % len(cov)), F.lit(" with "),
        pick(cov, (p + sp) % len(cov)), F.lit(".\n\n\n\n"),
        F.lit("Loss history:\t\t"), pick(per, sp % len(per)), F.lit(" and "),
        pick(per, (p + ln) % len(per)),
        F.when(p % 5 == 0, F.lit(" (reported by a fireman on site)")).otherwise(F.lit("")),
        F.when(sp % 6 == 1, F.lit(". Fire department notified")).otherwise(F.lit("")),
        F.lit(".\n"),
        F.lit("Premium amount is $"), F.format_number(F.col("l_extendedprice"), 2),
        F.when(sp % 4 == 0, F.concat(F.lit(", limit $"), (p % 9 + 1).cast("string"), F.lit(" million")))
        .otherwise(F.lit("")),
        F.when(ln % 3 == 0, F.concat(F.lit(", deductible $"), (ln * 5).cast("string"), F.lit("k")))
        .otherwise(F.lit("")),
        F.lit(".\n"),
        F.format_string("Policy PLY-%d-%05d status: ", F.year("l_shipdate"), k),
        pick(vocab.CLAIM_STATUS_PHRASES, (p + sp + ln) % len(vocab.CLAIM_STATUS_PHRASES)),
        F.lit(".   \n"),
        F.lit("Property: "), pick(vocab.PROPERTY_TYPE_PHRASES, (sp + ln) % len(vocab.PROPERTY_TYPE_PHRASES)),
        F.lit(" at "), (p % 1000).cast("string"), F.lit(" Main St.\n\n"),
    )
    # Number the pages on the narrow key columns first; the page text is built
    # after the window so it is generated in the post-shuffle tasks and never
    # shuffled or sorted itself.
    numbered = li.withColumn("_page", (F.row_number().over(w) - 1).cast("int"))
    return numbered.select(k.alias("doc_id"), F.col("_page").alias("page_number"), text.alias("text"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in model output per order: a probability on a 1/100 grid (exact
    0.25/0.5/0.75 included) and a raw amount that may be negative."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("submission_id"),
        (((k * 37 + F.col("o_custkey")) % 100).cast("double") / 100.0).alias("raw_probability"),
        (F.col("o_totalprice") * ((k % 11) - 1).cast("double")).alias("raw_amount"),
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in PRIORITY_TO_SEVERITY.items() for x in kv]),
            F.col("o_orderpriority"),
        ).alias("incident_severity"),
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution values of each submission, 28 in feature order, some exactly
    0 and some below 1e-6."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission_id"))
    k = F.col("submission_id")

    def value(j):
        base = ((k * 31 + j * 17) % 41 - 20).cast("double") / 10.0
        return F.when((k + j) % 13 == 0, base * 1e-7).otherwise(base)

    return o.select("submission_id", F.transform(F.sequence(F.lit(0), F.lit(27)), value).alias("shap_values"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request events: service = event_type, client = user_id, latency = value."""
    return requests_from(table(spark, sf_dir, "events"))


def requests_from(events: DataFrame) -> DataFrame:
    """The request projection of an events table or stream."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    status = (
        F.when(F.col("event_type") == "error", F.lit(500))
        .when(F.col("event_id") % 23 == 0, F.lit(503))
        .otherwise(F.lit(200))
    )
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("service"),
        F.col("user_id").alias("client"),
        F.col("value").alias("latency"),
        status.alias("status"),
        (status >= 500).alias("is_error"),
        "props",
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a query."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"
    )


def case_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a case (a query finds itself first)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector"), "label"
    )


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in generated narratives per scored submission: markdown with
    ``##`` and ``**x:**`` headings, the tier (left out for every 7th), the
    probability as a percent, the amount (5 % off for every 3rd), fixed
    percents 10 and 72.7; every 17th empty, every 19th null, every 23rd blank."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    p = ((k * 37 + F.col("o_custkey")) % 100).cast("double") / 100.0
    tier = (
        F.when(p < 0.25, F.lit("LOW")).when(p < 0.5, F.lit("MODERATE"))
        .when(p < 0.75, F.lit("HIGH")).otherwise(F.lit("CRITICAL"))
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.greatest((k % 11) - 1, F.lit(0))
    cited_cents = F.when(k % 3 == 0, F.floor((cents * 105).cast("double") / 100.0)).otherwise(cents)
    cited = cited_cents.cast("double") / 100.0
    text = F.concat(
        F.lit("Preliminary review of submission "), k.cast("string"), F.lit(".\n\n"),
        F.lit("## Risk Summary\n"),
        F.when(k % 7 == 0, F.lit("The submission is assessed")).otherwise(
            F.concat(F.lit("The submission is assessed as "), tier, F.lit(" risk"))
        ),
        F.lit(" with a claim probability of "), F.format_string("%.1f", p * 100.0), F.lit("%.\n\n"),
        F.lit("**Financial Exposure:**\n"),
        F.lit("Expected claim cost is $"), F.format_number(cited, 2), F.lit(" based on similar cases.\n"),
        F.lit("## Key Factors\n"),
        F.lit("Coverage breadth accounts for 10% of the score"),
        F.when(k % 2 == 0, F.lit(" and peril diversity for 72.7% overall")).otherwise(F.lit("")),
        F.lit(".\n"),
    )
    narrative = (
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .when(k % 17 == 0, F.lit(""))
        .when(k % 23 == 0, F.lit("   \n  "))
        .otherwise(text)
    )
    return o.select(k.alias("submission_id"), narrative.alias("narrative"))


# Names that stand in for factor names a generator got wrong: one shortened
# (fuzzy-valid, exact-invalid) and one made up (invalid both ways).
SHORT_FACTOR_NAME = "Fire peril"
BAD_FACTOR_NAME = "Weather volatility index"


def neighbour_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in retrieval output: for order k the claim cases k+1..k+3 (when
    they exist; none for every 11th order) with a fixed similarity."""
    from ..operators.claims import claim_cases

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission_id"))
    cc = claim_cases(claims(spark, sf_dir)).select("case_id", "policy_id", "summary", "outcome")
    k = F.col("submission_id")
    pairs = o.where(k % 11 != 0).select(
        "submission_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j")
    ).withColumn("case_id", F.col("submission_id") + F.col("j"))
    return pairs.join(cc, "case_id").select(
        "submission_id", "j", "policy_id",
        (((k * 7 + F.col("j") * 13) % 50 + 50).cast("double") / 100.0).alias("similarity_score"),
        "summary", "outcome",
    )


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assessment record per order, built from the stand-in stages:
    prediction (``scored``), ranked factors (``factors``, a few names made
    wrong), neighbours, narrative and the claim's entity summary."""
    from ..operators.claims import claim_entities
    from ..operators.explain import factor_list, ranked_factors
    from ..operators.scoring import score

    s = score(scored(spark, sf_dir)).select(
        "submission_id", "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score",
        "incident_severity",
    )
    pos = lambda f: F.col("submission_id") + f["feature_index"]
    renamed = F.transform(ranked_factors(F.col("shap_values")), lambda f: f.withField(
        "name",
        F.when(pos(f) % 29 == 0, F.lit(SHORT_FACTOR_NAME)).when(pos(f) % 31 == 0, F.lit(BAD_FACTOR_NAME))
        .otherwise(f["name"]),
    ))
    fac = factors(spark, sf_dir).select("submission_id", factor_list(renamed).alias("key_risk_factors"))
    nb = neighbour_rows(spark, sf_dir).groupBy("submission_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("j", "policy_id", "similarity_score", "summary", "outcome"))),
            lambda c: F.struct(c["policy_id"].alias("policy_id"), c["similarity_score"].alias("similarity_score"),
                               c["summary"].alias("summary"), c["outcome"].alias("outcome")),
        ).alias("similar_cases")
    )
    ent = claim_entities(claims(spark, sf_dir), "train").select(
        F.col("case_id").alias("submission_id"), F.col("entity_summary").alias("entities"), "incident_type"
    )
    nar = narratives(spark, sf_dir).withColumnRenamed("narrative", "underwriter_narrative")
    empty_cases = F.array().cast(nb.schema["similar_cases"].dataType)
    empty_factors = F.array().cast(fac.schema["key_risk_factors"].dataType)
    return (
        s.join(fac, "submission_id", "left")
        .join(nb, "submission_id", "left")
        .join(nar, "submission_id", "left")
        .join(ent, "submission_id", "left")
        .withColumn("key_risk_factors", F.coalesce("key_risk_factors", empty_factors))
        .withColumn("similar_cases", F.coalesce("similar_cases", empty_cases))
    )
