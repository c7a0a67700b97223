"""URL filters: a rule list first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted by host, registered domain (last two names) and suffix
(last name). The suffix rate is shrunk towards the overall rate, the domain towards its suffix, the
host towards its domain, each by a beta-binomial prior whose strength is the method-of-moments
estimate of its level, but never more than the labels (and prior pages) that the mean itself rests on, so a mean known
from few labels is no certainty further down. The overall rate has a weak prior of its own, ``PRIOR_BAD`` of ``PRIOR_PAGES``
pages, so labels of one kind leave it between 0 and 1. A page that no rule decides is blocked when the lower posterior bound of its
host's bad rate, mean - z * deviation, is over a threshold.

Only DataFrame functions are used. Counting is by host with partial aggregation, so a host with a
third of all pages costs one row per task; the pages meet their host's verdict in an equi-join that
adaptive execution may split.

A null url and one without ``://`` have empty host and path. Repeated page rows are judged alike, and
each label counts once per labelled page row; a null label is none. With no labels nothing but rules blocks. Only named
columns are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the production rule list.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
Z = 1.645
MAX_BAD_RATE = 0.5
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0
#: What the overall rate starts from.
PRIOR_BAD, PRIOR_PAGES = 1.0, 2.0


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#``, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null where none does."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"),) * 2


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(counts: DataFrame, name: str) -> DataFrame:
    """One row: the prior strength of a level, from the spread of its groups' rates about the overall rate.

    By moments: with rates p_i over n_i pages and overall rate m, the between-group variance is
    v = sum(n_i (p_i - m)^2) - (k - 1) m (1 - m), over n - sum(n_i^2) / n, and the strength m (1 - m) / v - 1.
    """
    sums = counts.agg(
        F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum(F.round(F.col("bad") * F.col("bad") / F.col("n"), 9).cast("decimal(38,9)")).cast("double").alias("bb"),
    )
    m = F.col("bad") / F.col("n")
    spread = F.col("bb") - F.col("n") * m * m - (F.col("k") - 1) * m * (1 - m)
    v = F.try_divide(spread, F.col("n") - F.col("nn") / F.col("n"))  # null for a single group
    fitted = F.when((v > 0) & (m > 0) & (m < 1), F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.try_divide(m * (1 - m), v) - 1))).otherwise(F.lit(STRONGEST))
    return sums.select(F.coalesce(fitted, F.lit(STRONGEST)).alias(name))


def host_reputation(labelled: DataFrame, hosts: DataFrame, z: float = Z) -> DataFrame:
    """host, rate, bound for every row of hosts (column host); labelled has host and bad (0 or 1)."""
    by_host = saved(labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    by_domain = by_host.groupBy(domain_of(F.col("host")).alias("domain")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy(suffix_of(F.col("domain")).alias("suffix")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Sums and strengths are one row, whatever the input: the only thing broadcast.
    pages, bad = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))
    total = by_suffix.agg(((bad + PRIOR_BAD) / (pages + PRIOR_PAGES)).alias("m"), (pages + PRIOR_PAGES).alias("w"))
    overall = total.join(_strength(by_suffix, "s_suffix")).join(_strength(by_domain, "s_domain")).join(_strength(by_host, "s_host"))
    got = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    for counts, key, n, bad in ((by_host, "host", "n_h", "bad_h"), (by_domain, "domain", "n_d", "bad_d"), (by_suffix, "suffix", "n_s", "bad_s")):
        got = got.join(counts.select(key, F.col("n").alias(n), F.col("bad").alias(bad)), key, "left")
    got = got.join(F.broadcast(overall)).na.fill(0, ["n_h", "bad_h", "n_d", "bad_d", "n_s", "bad_s"])
    # Each level: its prior weighs its strength, but no more than all that the level above has seen.
    mean, seen = F.col("m"), F.col("w")
    for strength, n, bad in (("s_suffix", "n_s", "bad_s"), ("s_domain", "n_d", "bad_d"), ("s_host", "n_h", "bad_h")):
        got = got.withColumn("_mean", mean).withColumn("_prior", F.least(F.col(strength), seen))
        got = got.withColumn("rate", (F.col("_prior") * F.col("_mean") + F.col(bad)) / (F.col("_prior") + F.col(n))).withColumn("weight", F.col("_prior") + F.col(n))
        mean, seen = F.col("rate"), F.col("weight")
    return got.select("host", "rate", (F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))).alias("bound"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad_rate: float = MAX_BAD_RATE, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, bound. labels has doc_id (of the page) and toxic; bad = toxic is 1."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    bad = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).cast("long").alias("bad"))
    reputation = host_reputation(parsed.join(bad, "page_id").select("host", "bad"), parsed.select("host").distinct(), z)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.join(reputation, "host", "left")
    method = F.when(F.col("bound") > max_bad_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("bound", 6).alias("bound"))


def oracle_sql() -> str:
    levels = {"host": "host", "domain": "regexp_extract(host, '([^.]*\\.)?[^.]*$')", "suffix": "regexp_extract(host, '[^.]*$')"}
    group = ", ".join(f"by_{k} AS (SELECT {e} AS k, count(*) AS n, sum(bad)::BIGINT AS bad FROM labelled GROUP BY 1)" for k, e in levels.items())
    strength = ", ".join(
        f"s_{k} AS (SELECT coalesce(CASE WHEN v > 0 AND m > 0 AND m < 1 THEN least({STRONGEST}, greatest({WEAKEST}, m * (1 - m) / v - 1)) ELSE {STRONGEST} END, {STRONGEST}) AS s"
        f" FROM (SELECT m, (bb - n * m * m - (k - 1) * m * (1 - m)) / nullif(n - nn / n, 0) AS v FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE / sum(n)::DOUBLE AS m, count(*) AS k, sum(n * n)::DOUBLE AS nn, sum(round(bad * bad / n, 9)::DECIMAL(38, 9))::DOUBLE AS bb FROM by_{k})))"
        for k in levels
    )
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in order) + " END"
    return f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
labelled AS (SELECT host, (toxic = 1)::BIGINT AS bad FROM parsed JOIN labels ON page_id = doc_id WHERE toxic IS NOT NULL),
{group}, {strength},
overall AS (SELECT (coalesce(sum(bad), 0)::DOUBLE + {PRIOR_BAD}) / (coalesce(sum(n), 0) + {PRIOR_PAGES}) AS m, coalesce(sum(n), 0) + {PRIOR_PAGES} AS w FROM by_suffix),
names AS (SELECT DISTINCT host, {levels['domain']} AS domain, {levels['suffix']} AS suffix FROM parsed),
suffixes AS (SELECT a.*, least(x.s, w) + coalesce(c.n, 0) AS w, (least(x.s, w) * m + coalesce(c.bad, 0)) / (least(x.s, w) + coalesce(c.n, 0)) AS m FROM names a LEFT JOIN by_suffix c ON c.k = a.suffix, s_suffix x, overall),
domains AS (SELECT a.* REPLACE (least(x.s, w) + coalesce(c.n, 0) AS w, (least(x.s, w) * m + coalesce(c.bad, 0)) / (least(x.s, w) + coalesce(c.n, 0)) AS m) FROM suffixes a LEFT JOIN by_domain c ON c.k = a.domain, s_domain x),
hosts AS (SELECT a.* REPLACE (least(x.s, w) + coalesce(c.n, 0) AS w, (least(x.s, w) * m + coalesce(c.bad, 0)) / (least(x.s, w) + coalesce(c.n, 0)) AS m) FROM domains a LEFT JOIN by_host c ON c.k = a.host, s_host x),
bounds AS (SELECT host, m - {Z} * sqrt(m * (1 - m) / (w + 1)) AS bound FROM hosts)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
  coalesce({case(lambda v, h, p: v)}, CASE WHEN bound > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bound
FROM parsed LEFT JOIN bounds USING (host)"""
