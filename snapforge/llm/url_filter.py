"""Empirical-Bayes host reputation and host/path rules for URLs.

A page's outcome is known where ``labels`` has a row of its id: bad is low quality or toxic. The rate of bad pages is
estimated for each host by beta-binomial shrinkage in three steps: suffixes towards the overall rate, registered domains
towards their suffix, hosts towards their domain. Each step's prior strength comes from how much the rates of its
groups vary beyond binomial noise (method of moments). A host is blocked when the lower bound of its posterior
rate lies above a threshold. Rules go before the estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import join_hot, write_table

#: Host, path and verdict, as in the contract of the query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Rules in public-suffix format, where no table of them is given; a host that none fits has a suffix of one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: A host is blocked when its rate of bad pages exceeds this with the certainty of ``Z`` standard deviations.
THRESHOLD = 0.5
Z = 1.645
#: Limits of the correlation of pages within a group, so that the prior strength 1 / rho - 1 is finite.
RHO = (0.001, 0.5)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null; of equally long ones the first listed."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def read_suffixes(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """The rules of a file in public-suffix format: one a line, up to the first blank; ``//`` starts a comment.

    A table of rules is small (the public one has some 10,000); more than ``most`` is an error.
    """
    line = F.translate(F.regexp_extract(F.trim("value"), r"^(\S*)", 1), _UPPER, _LOWER)
    rules = spark.read.text(path).select(line.alias("rule")).filter("rule <> '' and rule not like '//%'").distinct().orderBy("rule").limit(most + 1).collect()
    if len(rules) > most:
        raise ValueError(f"there are more than {most} rules in {path}")
    return tuple(r["rule"] for r in rules)


def _tail(bare: Column, labels: int) -> Column:
    """The last ``labels`` labels, null where there are fewer."""
    return F.when(F.size(F.split(bare, r"\.")) >= labels, F.substring_index(bare, ".", -labels))


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^[\d.]+$") | bare.startswith("[")


def suffix_labels(bare: Column, suffixes: Sequence[str]) -> Column:
    """How many labels the public suffix of a host has by ``suffixes``: the longest rule that fits, one where none does.

    ``co.uk`` stands for itself, ``*.ck`` for any label before ck, and ``!www.ck`` takes www.ck out of it again.
    """
    plain, wild, but = ({r[cut:] for r in suffixes if kind(r)} for cut, kind in ((0, lambda r: r[0] not in "*!"), (2, lambda r: r.startswith("*.")), (1, lambda r: r.startswith("!"))))
    longest = max([1, *[r.count(".") + 1 for r in plain], *[r.count(".") + 2 for r in wild]])
    found = F.lit(1)
    for labels in range(2, longest + 1):
        fits = F.coalesce(_tail(bare, labels).isin(*sorted(plain)), F.lit(False)) if plain else F.lit(False)
        if wild:
            fits = fits | (_tail(bare, labels).isNotNull() & _tail(bare, labels - 1).isin(*sorted(wild)))
        found = F.when(fits, labels).otherwise(found)
    for rule in sorted(but):
        found = F.when((bare == rule) | bare.endswith(f".{rule}"), rule.count(".")).otherwise(found)
    return found


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix of a host without its port; an address is its own."""
    bare = F.regexp_replace(host, r":\d*$", "")
    return F.when(_is_address(bare), bare).otherwise(_last(bare, suffix_labels(bare, suffixes)))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and one label more; an address or a host that is a suffix is its own domain."""
    bare = F.regexp_replace(host, r":\d*$", "")
    return F.when(_is_address(bare), bare).otherwise(_last(bare, suffix_labels(bare, suffixes) + 1))


def _last(bare: Column, labels: Column) -> Column:
    parts = F.split(bare, r"\.")
    n = F.least(labels, F.size(parts))
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")


def prior_strength(groups: DataFrame) -> float:
    """Strength of the beta prior around ``p`` for groups with n outcomes, k of them bad."""
    n, k, p = F.col("n"), F.col("k"), F.col("p")
    noise = n * p * (1 - p)
    sums = groups.agg(F.sum((k - n * p) ** 2 - noise).alias("beyond"), F.sum(noise * (n - 1)).alias("room")).first()
    rho = sums["beyond"] / sums["room"] if sums["room"] else RHO[0]
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def host_reputation(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, pages (how many), rate, lower and verdict of every host of ``pages`` (page_id, host).

    Pages are counted by host within each task first, so a host with a third of all pages is a row per task.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("k"))
    outcomes = pages.join(known, "page_id").select("host", F.lit(1).alias("n"), "k", F.lit(0).alias("pages"))
    every = pages.select("host", F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(1).alias("pages")).unionByName(outcomes)
    counts = every.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"), F.sum("pages").alias("pages"))
    hosts = write_table(counts.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "k", "pages"), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1.0)

    def shrunk(groups: DataFrame, key: str) -> DataFrame:
        s = F.lit(prior_strength(groups))
        return groups.select(key, ((F.col("k") + s * F.col("p")) / (F.col("n") + s)).alias("p"))

    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("p", F.lit(overall))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(shrunk(suffixes, "suffix"), "suffix")
    domains = write_table(domains, "domains")
    groups = write_table(hosts.select("host", "domain", "n", "k", "pages").join(shrunk(domains, "domain"), "domain"), "host-groups")
    s = prior_strength(groups)
    rate = (F.col("k") + F.lit(s) * F.col("p")) / (F.col("n") + F.lit(s))
    lower = F.col("rate") - F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(s + 1)))
    found = groups.select("host", "pages", rate.alias("rate"), "n").withColumn("lower", lower)
    return found.select("host", "pages", "rate", "lower", F.when(F.col("lower") > threshold, "block").otherwise("allow").alias("verdict"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A null url, or one without ``://``, has an empty host and path, which have a reputation like any other. A null
    page_id has no outcome. Repeated pages or labels count as often as they come. Without labels every host
    has the even prior, whose lower bound is under the threshold, so only rules block. Other columns are ignored.
    """
    rows = pages.select("page_id", url_host().alias("host"), url_path().alias("path"))
    reputation = write_table(host_reputation(rows.select("page_id", "host"), labels, threshold, suffixes=suffixes).select("host", "pages", F.col("verdict").alias("by_host")), "reputation")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    judged = join_hot(rows.withColumn("rule", rule), reputation, "host", "pages")  # every host has a row
    verdict = F.col("by_host")
    for name, decision in rules:
        verdict = F.when(F.col("rule") == name, F.lit(decision)).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
_STRENGTH = f"1 / least(greatest(coalesce(sum((k - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * p * (1 - p) * (n - 1)), 0), {RHO[0]}), {RHO[0]}), {RHO[1]}) - 1"
ORACLE_SQL = rf"""
WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
counts AS (
  SELECT host, count(l.doc_id)::DOUBLE AS n, coalesce(sum(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) FILTER (l.doc_id IS NOT NULL), 0)::DOUBLE AS k
  FROM urls LEFT JOIN labels l ON l.doc_id = page_id GROUP BY host),
bare AS (SELECT *, regexp_replace(host, ':\d*$', '') AS b FROM counts),
hosts AS (
  SELECT host, n, k, CASE WHEN regexp_matches(b, '^([\d.]+$|\[)') THEN b WHEN regexp_extract(b, '([^.]*\.[^.]*)$', 1) IN ({_TWO}) THEN regexp_extract(b, '([^.]*\.[^.]*)$', 1) ELSE regexp_extract(b, '([^.]*)$', 1) END AS suffix,
         CASE WHEN regexp_matches(b, '^([\d.]+$|\[)') THEN b
              WHEN regexp_extract(b, '([^.]*\.[^.]*)$', 1) IN ({_TWO}) THEN regexp_extract(b, '(([^.]*\.)?[^.]*\.[^.]*)$', 1)
              ELSE regexp_extract(b, '(([^.]*\.)?[^.]*)$', 1) END AS domain FROM bare),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM hosts) AS p FROM hosts GROUP BY suffix),
s1 AS (SELECT suffix, (k + s * p) / (n + s) AS p FROM s0, (SELECT {_STRENGTH} AS s FROM s0)),
d0 AS (SELECT domain, suffix, n, k, p FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL) JOIN s1 USING (suffix)),
d1 AS (SELECT domain, (k + s * p) / (n + s) AS p FROM d0, (SELECT {_STRENGTH} AS s FROM d0)),
h0 AS (SELECT host, n, k, p FROM hosts JOIN d1 USING (domain)),
h1 AS (SELECT host, n, s, (k + s * p) / (n + s) AS rate FROM h0, (SELECT {_STRENGTH} AS s FROM h0)),
reputation AS (SELECT host, CASE WHEN rate - {Z} * sqrt(rate * (1 - rate) / (n + s + 1)) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS by_host FROM h1),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
fits AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule FROM (SELECT DISTINCT page_id, host, path FROM urls) u, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(r.verdict, by_host) AS verdict
FROM urls u JOIN reputation USING (host) LEFT JOIN fits f ON f.page_id = u.page_id AND f.host = u.host AND f.path = u.path LEFT JOIN rules r ON r.rule = f.rule
"""
