"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Outcomes of labelled pages are counted per host, registered domain and public
suffix. Each level's rate is shrunk towards its parent's by a beta prior whose
mean is the parent's posterior mean and whose strength, in pseudo-pages, is fitted
to how far the level's own rates scatter (moments of the beta-binomial, between 1
and 1000); the root prior is the rate over all labelled pages. A host is
blocked when the lower bound of its posterior bad rate exceeds a threshold.

Counts are pre-aggregated before every shuffle; a host with a third of the pages
costs one row per task there, and the join back is an equi-join that adaptive
execution splits when a host is hot.

Defined cases. Null url, or one without ``://``: empty host and path; such pages
share the reputation of the empty host. Null html: no outcome. A host without
labelled pages is judged by its domain's, suffix's and the root's rates. Of rules as
long as each other the later wins. Very long html is read whole, row by row. Empty
tables give empty results. Repeated rows each get their row and count as often. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, lower_ascii

# The rules of the query, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Second-level labels that form a suffix with a two-letter country label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The public suffix, and the registered domain (one label more)."""
    country = rf"(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}"
    suffix = F.regexp_extract(host, rf"((?:^|(?<=\.)){country}|[^.]*)$", 1)
    domain = F.regexp_extract(host, rf"([^.]*\.(?:{country})|[^.]*\.[^.]*|[^.]*)$", 1)
    return suffix, domain


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text (host + path) and verdict, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def junk_outcome(html: Column, threshold: float = 0.05) -> Column:
    """The label of a page: 1 if symbol runs fill much of its visible text."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    noise = F.length(text) - F.length(F.translate(text, "#*$%|", ""))
    return (noise > threshold * F.length(text)).cast("int")


def strength(groups: DataFrame, n: str, k: str, p: str, least: float = 1.0, most: float = 1000.0) -> Column:
    """The beta prior's pseudo-pages m by moments, over groups with k of n at a mean p.

    Beta-binomial outcomes vary by n p (1 - p) (1 + (n - 1) / (m + 1)); the excess over the
    binomial part gives m. No excess, or no group with two pages, gives the most.
    """
    n, k, p = F.col(n), F.col(k), F.col(p)
    seen, plain = (k - n * p) * (k - n * p), n * p * (1.0 - p)
    return groups.agg(F.coalesce(F.sum(seen - plain), F.lit(0.0)).alias("_over"), F.coalesce(F.sum(plain * (n - 1.0)), F.lit(0.0)).alias("_base")).select(
        F.when(F.col("_over") <= 0.0, most).when(F.col("_base") <= 0.0, most)
        .otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.col("_base") / F.col("_over") - 1.0))).alias("m")
    )


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, bad_rate, bad_low) for every host of outcomes (host, outcome 0/1/null)."""
    suffix, domain = suffix_and_domain(F.col("host"))
    n, k = F.count("outcome").cast("double"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("double")
    scratch = Scratch(outcomes.sparkSession, "reputation")
    hosts, _ = scratch.save(outcomes.groupBy("host").agg(n.alias("n"), k.alias("k")).withColumns({"suffix": suffix, "domain": domain}))
    domains, _ = scratch.save(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    root = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1.0)).alias("p"))

    def shrunk(level: DataFrame, parents: DataFrame, on: list[str], name: str) -> DataFrame:
        """level with p, its parent's mean, m, the level's strength, and its own posterior mean."""
        seen, _ = scratch.save(level.join(parents, on) if on else level.join(F.broadcast(parents)))
        found = seen.join(F.broadcast(strength(seen, "n", "k", "p")))
        return found.withColumn(name, (F.col("k") + F.col("m") * F.col("p")) / (F.col("n") + F.col("m")))

    s = shrunk(suffixes, root, [], "mean").select("suffix", F.col("mean").alias("p"))
    d = shrunk(domains, s, ["suffix"], "mean").select("domain", F.col("mean").alias("p"))
    t = shrunk(hosts, d, ["domain"], "mean")
    a, b = F.col("k") + F.col("m") * F.col("p"), F.col("n") - F.col("k") + F.col("m") * (1.0 - F.col("p"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))
    return t.select("host", F.col("mean").alias("bad_rate"), (a / (a + b) - z * sd).alias("bad_low"))


def judge(pages: DataFrame, rules=RULES, block_above: float = 0.5, outcome: Column | None = None, **priors) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_rate, bad_low."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), (junk_outcome(F.col("html")) if outcome is None else outcome).alias("outcome"))
    known = reputations(seen.select("host", "outcome"), **priors)
    rule, told = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_low") > block_above, "block").otherwise("allow")
    return (
        seen.drop("outcome").join(known, "host")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(told, method).alias("verdict"), "bad_rate", "bad_low")
    )


def report(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), x AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>(.|\n)*?</script>', ' ', 'g'), '<style[^>]*>(.|\n)*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS vis FROM u
), o AS (
  SELECT page_id, host, path, CASE WHEN vis IS NULL THEN NULL WHEN length(vis) - length(regexp_replace(vis, '[#*$%|]', '', 'g')) > 0.05::DOUBLE * length(vis) THEN 1 ELSE 0 END AS outcome,
         CASE WHEN regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|or|org)\.[a-z]{2}$') THEN regexp_extract(host, '([^.]*\.[a-z]{2})$', 1) ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix,
         CASE WHEN regexp_matches(host, '[^.]*\.(ac|co|com|edu|gov|net|or|org)\.[a-z]{2}$') THEN regexp_extract(host, '([^.]*\.[^.]*\.[^.]*)$', 1)
              WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]*\.[^.]*)$', 1) ELSE host END AS domain FROM x
), h AS (
  SELECT host, suffix, domain, count(outcome)::DOUBLE AS n, coalesce(sum(outcome), 0)::DOUBLE AS k FROM o GROUP BY ALL
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL
), s AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL
), r AS (
  SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS p FROM s
), s1 AS (SELECT s.*, p FROM s, r), sm AS (SELECT CASE WHEN over <= 0.0 OR base <= 0.0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, base / over - 1.0::DOUBLE)) END AS m FROM (SELECT coalesce(sum((k - n * p) * (k - n * p) - n * p * (1.0::DOUBLE - p)), 0.0::DOUBLE) AS over, coalesce(sum(n * p * (1.0::DOUBLE - p) * (n - 1.0::DOUBLE)), 0.0::DOUBLE) AS base FROM s1)), s2 AS (
  SELECT suffix, (k + m * p) / (n + m) AS p FROM s1, sm
), d1 AS (SELECT d.*, p FROM d JOIN s2 USING (suffix)), dm AS (SELECT CASE WHEN over <= 0.0 OR base <= 0.0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, base / over - 1.0::DOUBLE)) END AS m FROM (SELECT coalesce(sum((k - n * p) * (k - n * p) - n * p * (1.0::DOUBLE - p)), 0.0::DOUBLE) AS over, coalesce(sum(n * p * (1.0::DOUBLE - p) * (n - 1.0::DOUBLE)), 0.0::DOUBLE) AS base FROM d1)), d2 AS (
  SELECT domain, (k + m * p) / (n + m) AS p FROM d1, dm
), h1 AS (SELECT h.*, p FROM h JOIN d2 USING (domain)), hm AS (SELECT CASE WHEN over <= 0.0 OR base <= 0.0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, base / over - 1.0::DOUBLE)) END AS m FROM (SELECT coalesce(sum((k - n * p) * (k - n * p) - n * p * (1.0::DOUBLE - p)), 0.0::DOUBLE) AS over, coalesce(sum(n * p * (1.0::DOUBLE - p) * (n - 1.0::DOUBLE)), 0.0::DOUBLE) AS base FROM h1)), ab AS (
  SELECT host, k + m * p AS a, n - k + m * (1.0::DOUBLE - p) AS b FROM h1, hm
), lo AS (
  SELECT host, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0::DOUBLE))) AS bad_low FROM ab
), f AS (
  SELECT o.page_id, o.host, o.path, lo.bad_low,
    CASE WHEN (o.host = 'example.com' OR o.host LIKE '%.example.com') AND o.path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (o.host = 'example.net' OR o.host LIKE '%.example.net') AND o.path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (o.host = 'org' OR o.host LIKE '%.org') AND o.path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (o.host = 'net' OR o.host LIKE '%.net') AND o.path LIKE '/%' THEN 'net/' END AS rule
  FROM o JOIN lo USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
