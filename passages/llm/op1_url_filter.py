"""Operator 1, URL filter: explicit rules first, then the host's reputation.

Reputation is empirical Bayes. Labelled page outcomes (bad or not) are counted by host, registered
domain and suffix. The corpus mean is the prior mean of a suffix, a suffix's posterior mean that of its
domains, a domain's that of its hosts; how strongly each level pulls (the prior's pseudo-count) comes from
the spread between the labelled units of that level (moment estimate of the beta-binomial over-dispersion).
A host is blocked when a lower bound of its posterior bad rate exceeds max_bad. A host without labels has its
domain's posterior mean, else its suffix's, else the corpus mean, under the same bound.

Defined results: a null url or one without "://" has empty host and path, fits no rule and gets the
method's verdict for the empty host. Labels that are null or of unknown pages are left out; when a page
has several labels, it counts as bad if any is bad. Extra columns of the inputs are ignored; repeated
pages give repeated rows. An empty label table gives every host the neutral prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import spread_join, table, written

NAME = "op1_url_filter"

#: Rules of the query: (rule, action). A rule is a host, a slash and the start of a path.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Suffixes under which anyone can hold a name, of any number of labels, besides each last label; other tables of
#: suffixes (such as one with co.uk) are a parameter.
SUFFIXES = ("example.com", "example.net", "example.org")
MAX_BAD, Z, PRIOR_MEAN = 0.5, 1.645, 0.5
#: Bounds of a prior's pseudo-count.
LEAST, MOST = 1.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def last_labels(host: Column, n: Column | int) -> Column:
    """The last n labels of a host, or all of them."""
    labels = F.split(host, "\\.")
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def suffix_labels(host: Column, suffixes=SUFFIXES) -> Column:
    """Labels of the longest suffix of a host that is listed; 1 if none is."""
    by_size: dict[int, list[str]] = {}
    for own in suffixes:
        by_size.setdefault(own.count(".") + 1, []).append(own)
    found = F.lit(1)
    for n, own in sorted(by_size.items()):
        found = F.when(last_labels(host, n).isin(*own), n).otherwise(found)
    return found


def registered_domain(host: Column, suffixes=SUFFIXES) -> Column:
    """The suffix and one label more; the host itself when it is no longer than that."""
    return last_labels(host, suffix_labels(host, suffixes) + 1)


def suffix(host: Column, suffixes=SUFFIXES) -> Column:
    return last_labels(host, suffix_labels(host, suffixes))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, or null; rules are a policy of bounded size
    and become one literal expression, so no join is needed."""
    found: Column | None = None
    for rule, action in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        made = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, made) if found is None else found.when(fits, made)
    return found if found is not None else F.lit(None).cast("struct<rule:string,action:string>")


def strength(units: DataFrame) -> DataFrame:
    """One row (s): the pseudo-count of the prior over units (n, k), by moments.

    With m units, N = sum n, p = sum k / N, S = sum n (k/n - p)^2 and n0 = (N - sum n^2 / N) / (m - 1), the
    variance between units is v = (S / (m - 1) - p (1 - p)) / (n0 - 1), and s = p (1 - p) / v - 1."""
    sums = units.agg(
        F.count(F.lit(1)).cast("double").alias("m"),
        F.sum("n").cast("double").alias("t"),
        F.sum("k").cast("double").alias("b"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2"),
    )
    p = F.expr("b / nullif(t, 0)")
    spread = F.expr("(k2 - b * b / nullif(t, 0)) / nullif(m - 1, 0)")
    n0 = F.expr("(t - n2 / nullif(t, 0)) / nullif(m - 1, 0)")
    v = (spread - p * (1 - p)) / F.when(n0 > 1, n0 - 1)
    s = F.when(v > 0, p * (1 - p) / v - 1).otherwise(F.lit(MOST))
    return sums.select(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(s, F.lit(MOST)))).alias("s"))


def reputation(outcomes: DataFrame, suffixes=SUFFIXES, z: float = Z, others: DataFrame | None = None) -> DataFrame:
    """outcomes (host, bad 0/1) -> one row per host: host, n, bad_mean, bad_low (lower posterior bound).

    Hosts of others (host) that have no outcomes get a row with n = 0."""
    seen = outcomes.select("host", F.lit(1).alias("n"), F.col("bad").alias("k"))
    if others is not None:
        seen = seen.unionByName(others.select("host", F.lit(0).alias("n"), F.lit(0).alias("k")).distinct())
    labelled = F.col("n") > 0
    hosts = (
        seen.groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .withColumn("domain", registered_domain(F.col("host"), suffixes))
        .withColumn("suffix", suffix(F.col("host"), suffixes))
    )
    hosts = written(hosts, "url-hosts")  # read at every level
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = tops.agg(F.coalesce(F.expr("sum(k) / nullif(sum(n), 0)"), F.lit(PRIOR_MEAN)).alias("mean0"))
    one = lambda df: F.broadcast(df)  # noqa: E731  a global aggregate: one row
    tops = tops.crossJoin(one(whole)).crossJoin(one(strength(tops.where(labelled))))
    tops = tops.select("suffix", ((F.col("s") * F.col("mean0") + F.col("k")) / (F.col("s") + F.col("n"))).alias("mean1"))
    low = spread_join(domains, tops, ["suffix"]).crossJoin(one(strength(domains.where(labelled))))
    low = low.select("domain", ((F.col("s") * F.col("mean1") + F.col("k")) / (F.col("s") + F.col("n"))).alias("mean2"))
    last = spread_join(hosts, low, ["domain"]).crossJoin(one(strength(hosts.where(labelled))))
    a, b = F.col("s") * F.col("mean2") + F.col("k"), F.col("s") * (1 - F.col("mean2")) + F.col("n") - F.col("k")
    last = last.select("host", "n", (a / (a + b)).alias("bad_mean"), (a + b).alias("weight"))
    sd = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("weight") + 1))
    return last.select("host", "n", "bad_mean", (F.col("bad_mean") - z * sd).alias("bad_low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, suffixes=SUFFIXES, max_bad: float = MAX_BAD) -> DataFrame:
    """pages (page_id, url) and outcomes (page_id, bad) -> page_id, host, path, rule, verdict, n_labelled."""
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = (
        outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.max("bad").cast("long").alias("bad"))
        .join(parsed.select("page_id", "host"), "page_id")
        .select("host", "bad")
    )
    # a hot host's pages are dealt over several tasks where its reputation isn't broadcast
    ranked = spread_join(parsed, written(reputation(known, suffixes, others=parsed), "url-reputation"), ["host"], "left")
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return ranked.withColumn("_r", rule).select(
        "page_id",
        "host",
        "path",
        F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.action"), own).alias("verdict"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_labelled"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, with page quality labels (label of the document with the page's id) as outcomes."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)


ORACLE_SQL = """
WITH parsed AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
      ELSE translate(regexp_extract(substring(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
      ELSE regexp_extract(substring(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
known AS (
  SELECT p.host, l.bad FROM (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l
  JOIN parsed p ON p.page_id = l.doc_id),
hosts AS (
  SELECT host, count(*) AS n, sum(bad) AS k,
    CASE WHEN regexp_matches(host, '(^|\\.)example\\.(com|net|org)$') THEN regexp_extract(host, '([^.]*\\.)?[^.]*\\.[^.]*$')
      ELSE regexp_extract(host, '([^.]*\\.)?[^.]*$') END AS domain,
    CASE WHEN regexp_matches(host, '(^|\\.)example\\.(com|net|org)$') THEN regexp_extract(host, '[^.]*\\.[^.]*$')
      ELSE regexp_extract(host, '[^.]*$') END AS suffix
  FROM known GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
tops AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
whole AS (SELECT coalesce(sum(k)::DOUBLE / sum(n), 0.5) AS mean0 FROM tops),
units AS (SELECT 1 AS lev, n, k FROM tops UNION ALL SELECT 2, n, k FROM domains UNION ALL SELECT 3, n, k FROM hosts),
sums AS (SELECT lev, count(*)::DOUBLE AS m, sum(n)::DOUBLE AS t, sum(k)::DOUBLE AS b, sum(n * n)::DOUBLE AS n2, sum(k::DOUBLE * k / n) AS k2
  FROM units GROUP BY lev),
spread AS (SELECT lev, b / t AS p, ((k2 - b * b / t) / nullif(m - 1, 0) - b / t * (1 - b / t))
    / CASE WHEN (t - n2 / t) / nullif(m - 1, 0) > 1 THEN (t - n2 / t) / (m - 1) - 1 END AS v FROM sums),
s AS (SELECT lev, greatest(1.0, least(1000.0, CASE WHEN v > 0 THEN p * (1 - p) / v - 1 ELSE 1000.0 END)) AS s FROM spread),
t1 AS (SELECT suffix, (s * mean0 + k) / (s + n) AS mean1 FROM tops, whole, s WHERE lev = 1),
t2 AS (SELECT domain, (s * mean1 + k) / (s + n) AS mean2 FROM domains JOIN t1 USING (suffix), s WHERE lev = 2),
t3 AS (SELECT host, n, (s * mean2 + k) / (s + n) AS mean3, s + n AS w FROM hosts JOIN t2 USING (domain), s WHERE lev = 3),
rep AS (SELECT host, n, mean3 - 1.645 * sqrt(mean3 * (1 - mean3) / (w + 1)) AS low FROM t3),
rules(rule, action) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'),
  ('example.net/de/8', 'block'), ('org/es/', 'block')),
fits AS (
  SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.action, length(r.rule)) AS action
  FROM parsed p JOIN rules r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
    AND starts_with(p.path, substring(r.rule, strpos(r.rule, '/')))
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule AS rule,
  coalesce(f.action, CASE WHEN r.low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(r.n, 0)::BIGINT AS n_labelled
FROM parsed p LEFT JOIN fits f USING (page_id) LEFT JOIN rep r ON r.host = p.host
"""
