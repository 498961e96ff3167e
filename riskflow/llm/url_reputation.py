"""URL filters: listed rules first, else an empirical-Bayes host reputation.

Pages whose document has a label are outcomes (bad or good) of their host.  A
host's bad rate has a beta prior whose mean is its registered domain's rate,
itself shrunk to its public suffix's rate, itself shrunk to the overall rate.
The strength of each prior comes from the level's own spread (moments of the
beta-binomial).  A host is blocked when the lower posterior bound of its bad
rate is above a limit, so a few bad pages alone block nobody.

Only DataFrame functions.  Pages are counted by (host, document) before any
join, so a host or a page with a third of all rows is one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the contract: verdict, host, path prefix.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Second-level public suffixes under which anyone can register.
SECOND_LEVEL = ["co.uk", "org.uk", "ac.uk", "com.au", "com.br", "com.mx", "co.jp", "co.nz", "co.za", "co.in"]

BAD_LIMIT = 0.25  # a host is blocked when its bad rate is above this ...
BOUND_Z = 1.645  # ... at this many posterior standard deviations below the mean
LEAST_RHO, MOST_RHO = 0.001, 0.999  # bounds of the correlation within a level


#: The whole number that a path segment starts with.
NUMBER = "/([0-9]+)(?:[^0-9A-Za-z]|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one
    without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return (
        F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")),
        F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit("")),
    )


def _rule(host: Column, path: Column, rules, value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(value(verdict, h, p))).otherwise(out)
    return out


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user and port.  A
    number address is its own domain with an empty suffix; a host of one label
    is both."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    number = bare.rlike(r"^[0-9.]+$")
    deep = F.substring_index(bare, ".", -2).isin(SECOND_LEVEL)
    suffix = F.when(number, "").when(deep, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(number, bare).when(deep, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return domain, suffix


def _strength(children: DataFrame) -> float:
    """The prior strength of a level from its children's (n, bad) and their
    parents' rate ``m``: one number."""
    v = F.col("m") * (1 - F.col("m"))
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)) - F.sum(v)
    rho = spread / F.nullif(F.sum(v * (F.col("n") - 1)), F.lit(0.0))
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce(rho, F.lit(0.5))))
    return children.where("n > 0").agg((1 / rho - 1).alias("k")).first().k


def _prior(parents: DataFrame, children: DataFrame, on: list[str], k: float) -> DataFrame:
    """``children`` with ``m``: the rate of their parent without the child's own
    pages, shrunk to the parent's prior by strength ``k``."""
    above = parents.select(*on, F.col("n").alias("p_n"), F.col("bad").alias("p_bad"), F.col("m").alias("p_m"))
    m = (F.col("p_bad") - F.col("bad") + k * F.col("p_m")) / (F.col("p_n") - F.col("n") + k)
    return children.join(above, on).select(*children.columns, m.alias("m"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, bad_limit: float = BAD_LIMIT, z: float = BOUND_Z) -> DataFrame:
    """(host, n, bad, blocked) of every host in ``pages`` (host, doc_no long).

    ``outcomes`` has one row per document: (doc_no, bad 0/1).  Hosts without an
    outcome are judged by their priors alone; without any outcome none is
    blocked."""
    seen = pages.groupBy("host", "doc_no").agg(F.count(F.lit(1)).alias("pages"))
    known = seen.where("doc_no is not null").join(outcomes, "doc_no")
    counts = known.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = staged(
        seen.select("host").distinct().join(counts, "host", "left")
        .select("host", domain.alias("domain"), suffix.alias("suffix"),
                F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")),
        "hosts",
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = hosts.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("m")).first().m
    level1 = suffixes.withColumn("m", F.lit(overall))
    level2 = _prior(level1, domains, ["suffix"], _strength(level1))
    level3 = _prior(level2, hosts, ["suffix", "domain"], _strength(level2))
    k = _strength(level3)
    size = F.col("n") + k
    rate = (F.col("bad") + k * F.col("m")) / size
    low = rate - z * F.sqrt(rate * (1 - rate) / (size + 1))
    return level3.select("host", "n", "bad", (F.round(low, 9) > bad_limit).alias("blocked"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES,
    bad_limit: float = BAD_LIMIT,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_labelled,
    host_bad (labelled pages of the host, and the bad ones among them).

    The document of a page is the first run of digits that starts a path segment
    and ends at its end or before a sign that is no letter or digit (none, if it
    does not fit a long); it is bad when any of its labels says quality 0 or toxic 1 (null
    labels say nothing).  A null url, or one without ``://``, has the empty
    host, which is judged like any host.  Repeated pages count each time and
    each keeps its row; empty tables give empty or unlabelled results."""
    host, path = host_and_path(F.col(url))
    at = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", NUMBER, 1)
    numbered = at.select("host", F.when(number != "", number).try_cast("long").alias("doc_no"))
    said = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(
        (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    )
    outcomes = (
        labels.select(F.col("doc_id").alias("doc_no"), said.cast("int").alias("bad"))
        .where("doc_no is not null and bad is not null").groupBy("doc_no").agg(F.max("bad").alias("bad"))
    )
    verdicts = host_reputation(numbered, outcomes, bad_limit).withColumnsRenamed({"n": "host_labelled", "bad": "host_bad"})
    h, p = F.col("host"), F.col("path")
    return at.join(verdicts, "host", "left").select(
        "page_id", "host", "path",
        _rule(h, p, rules, lambda v, a, b: a + b).alias("rule"),
        F.coalesce(
            _rule(h, p, rules, lambda v, a, b: v), F.when(F.col("blocked"), "block").otherwise("allow")
        ).alias("verdict"),
        "host_labelled", "host_bad",
    )


def _sql_rule(value) -> str:
    cases = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    return f"CASE {' '.join(cases)} END"


def _sql_strength(level: str) -> str:
    return f"""SELECT 1 / greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(
        (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.5))) - 1 AS k
      FROM {level} WHERE n > 0"""


_DEEP = "(" + ", ".join(f"'{x}'" for x in SECOND_LEVEL) + ")"
_TAIL = "array_to_string(list_slice(string_split(bare, '.'), -{0}, -1), '.')"

#: The same rows in DuckDB SQL.
ORACLE = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parsed AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM raw),
outcomes AS (SELECT doc_id AS doc_no, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
counts AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM parsed
  JOIN outcomes ON doc_no = try_cast(nullif(regexp_extract(path, '{NUMBER}', 1), '') AS BIGINT) GROUP BY 1),
bare AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM parsed),
hosts AS (SELECT host,
    CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare WHEN {_TAIL.format(2)} IN {_DEEP} THEN {_TAIL.format(3)} ELSE {_TAIL.format(2)} END AS domain,
    CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN '' WHEN {_TAIL.format(2)} IN {_DEEP} THEN {_TAIL.format(2)} ELSE {_TAIL.format(1)} END AS suffix,
    coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM bare LEFT JOIN counts USING (host)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
l1 AS (SELECT suffix, n, bad, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) FROM suffixes) AS m FROM suffixes),
k1 AS ({_sql_strength("l1")}),
l2 AS (SELECT d.suffix, domain, d.n, d.bad, (l1.bad - d.bad + k * m) / (l1.n - d.n + k) AS m FROM domains d JOIN l1 USING (suffix), k1),
k2 AS ({_sql_strength("l2")}),
l3 AS (SELECT host, h.n, h.bad, (l2.bad - h.bad + k * m) / (l2.n - h.n + k) AS m FROM hosts h JOIN l2 USING (suffix, domain), k2),
k3 AS ({_sql_strength("l3")}),
post AS (SELECT host, n, bad, (bad + k * m) / (n + k) AS p, n + k AS size FROM l3, k3)
SELECT page_id, host, path, {_sql_rule(lambda v, h, p: h + p)} AS rule,
  coalesce({_sql_rule(lambda v, h, p: v)},
    CASE WHEN round(p - {BOUND_Z} * sqrt(p * (1 - p) / (size + 1)), 9) > {BAD_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n AS BIGINT) AS host_labelled, CAST(bad AS BIGINT) AS host_bad
FROM parsed JOIN post USING (host)
"""
