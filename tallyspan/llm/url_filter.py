"""URL filtering by rules and by empirical-Bayes host reputation.

Rules are (host, path) prefixes for a host and all its subdomains; the longest wins. Pages that no rule
judges are judged by the reputation of their host: outcomes of labelled pages are counted by host, and a
beta-binomial prior shrinks each host towards its registered domain, that towards its suffix, and that
towards all labelled pages. The strength of each level's prior comes from the spread of the level's rates
(method of moments). The posterior of a host's block rate is a beta distribution; a page is blocked where that
rate lies above `most_bad` with a probability of `sure` or more, that is, where the posterior's lower quantile at
1 - sure lies above most_bad. So a host needs evidence, of its own or of its domain, to be blocked.

Labelled outcomes may be any frame of page_id and bad. Where none is given, a page is bad by its content (where there is
a column html) or by its url, and every other page is good; the rules have no part in it. Content is bad where half of the
visible text or more consists of blocks that repeat earlier ones, or where words of `BAD_WORDS` occur three times or more
and make up a fiftieth of its words or more; a url, where its host or path has such a word. A clean host with one such
page stays, and a clean page goes with its host. Visible is what stands outside of tags, comments, scripts, styles, head,
nav and footer; whole pages are read, and each gives one outcome.

Edge cases: a null url or one without `://` has empty host and path, no rule, and is judged by the reputation of all
such pages. Null and empty html, and html without visible text, are no evidence. What is not closed reaches to the end. An empty table gives an empty result. Repeated pages count as often as they occur. Extra columns
pass through `judge` unless they carry the name of a result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, written

#: The rules of the contract, as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Second-level suffixes under which names are registered.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.ar", "co.kr"]

#: Words of a host or path that mark a page as bad where no labels are given.
BAD_WORDS = ["adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "loans", "lottery", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx"]
MOST_BAD, SURE = 0.8, 0.95
#: What is not visible text, for Java's and RE2's patterns alike.
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "head", "nav", "footer")) + r"|<[^>]*(?:>|\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text (host and path) and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        text, verdict = F.when(fits, at + prefix).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def levels(host: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    deep = two.isin(suffixes)
    return F.when(deep, three).otherwise(two), F.when(deep, two).otherwise(F.element_at(labels, -1))


def strength(counts: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior strength of a level by the method of moments over (n, bad) rows, kept within bounds: one row of sums."""
    rate = F.col("bad") / F.col("n")
    s = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * rate * rate).alias("sq"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not s.n or s.k < 2:
        return least
    mean = s.bad / s.n
    within, spread = mean * (1 - mean), s.sq - s.n * mean * mean
    scale = s.n - s.nn / s.n
    between = (spread - (s.k - 1) * within) / scale if scale > 0 else 0.0
    return float(min(most, max(least, within / between - 1))) if between > 0 else most if within > 0 else least


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(rate <= x) under Beta(a, b), by the continued fraction of the incomplete beta function."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / np.maximum(1 - (p + q) * y / (p + 1), tiny)
    out = d.copy()
    for m in range(1, 2000):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        step = np.ones_like(p)
        for term in (even, odd):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            out, step = out * d * c, d * c
        if np.abs(step - 1).max(initial=0) < 1e-13:
            break
    log_front = [math.lgamma(i + j) - math.lgamma(i) - math.lgamma(j) + i * math.log(z) + j * math.log1p(-z) for i, j, z in zip(p, q, y, strict=True)]
    found = np.exp(log_front) * out / p
    return np.where(swap, 1 - found, found)


def above(a: Column, b: Column, most_bad: float) -> Column:
    """P(rate > most_bad) under Beta(a, b), one row a host."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(1 - beta_cdf(most_bad, a.to_numpy(), b.to_numpy()))

    return tail(a, b)


def reputation(hosts: DataFrame, folder: str, most_bad: float = MOST_BAD) -> DataFrame:
    """hosts (host, domain, suffix, n, bad; one row a host) with block_rate (the posterior mean) and block_sure (P(rate > most_bad))."""
    hosts = written(hosts, folder, "hosts")
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(domains, folder, "domains")
    ends = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), folder, "suffixes")
    whole = ends.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    prior = (whole.bad + 1) / (whole.n + 2) if whole.n else 0.5
    ks, kd, kh = (strength(x.filter("n > 0")) for x in (ends, domains, hosts))
    ends = ends.select("suffix", ((F.col("bad") + ks * prior) / (F.col("n") + ks)).alias("suffix_rate"))
    domains = domains.join(ends, "suffix").select("domain", ((F.col("bad") + kd * F.col("suffix_rate")) / (F.col("n") + kd)).alias("domain_rate"))
    a, b = F.col("bad") + kh * F.col("domain_rate"), F.col("n") - F.col("bad") + kh * (1 - F.col("domain_rate"))
    return hosts.join(domains, "domain").select("host", (a / (a + b)).alias("block_rate"), above(a, b, most_bad).alias("block_sure"))


def bad_words(host: Column, path: Column, words: list[str] = BAD_WORDS) -> Column:
    """True where a word of host or path is listed."""
    return F.arrays_overlap(F.split(F.lower(F.concat(host, F.lit("/"), path)), r"[^a-z0-9]+"), F.array(*map(F.lit, words)))


def bad_content(html: Column, words: list[str] = BAD_WORDS) -> Column:
    """True where half of the visible text repeats, or listed words make up a fiftieth of it (three at least)."""
    total = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, x: n + F.length(x))
    blocks = F.filter(F.split(F.coalesce(html, F.lit("")), HIDDEN), lambda x: F.trim(x) != "")
    terms = lambda blocks: F.filter(F.split(F.translate(F.array_join(blocks, " "), UPPER, LOWER), r"[^a-z0-9]+"), lambda x: x != "")
    listed = lambda said: F.size(F.filter(said, lambda x: x.isin(words)))
    # Arrays of one element, so that what several tests need is computed once.
    stuffed = lambda said: F.exists(F.array(listed(said)), lambda n: (n >= 3) & (50 * n >= F.size(said)))
    bad = lambda x: (F.size(x) > 0) & ((2 * total(F.array_distinct(x)) <= total(x)) | F.exists(F.array(terms(x)), stuffed))
    return F.exists(F.array(blocks), bad)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, outcomes: DataFrame | None = None, most_bad: float = MOST_BAD, sure: float = SURE, suffixes: list[str] = SUFFIXES, broadcast_hosts: int = 200_000) -> DataFrame:
    """pages with host, path, rule, verdict, block_rate and block_sure. The hosts are broadcast where they are broadcast_hosts at most."""
    folder = shared_folder(pages.sparkSession)
    results = ("host", "path", "rule", "verdict", "block_rate", "block_sure")
    own = pages.select([c for c in pages.columns if c not in results]).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, said = rule_for(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": text, "__said": said})
    if outcomes is None:
        bad = bad_words(F.col("host"), F.col("path"))
        labelled = own.withColumn("__bad", (bad | bad_content(F.col("html")) if "html" in own.columns else bad).cast("int"))
    else:
        labelled = own.join(outcomes.select("page_id", F.col("bad").cast("int").alias("__bad")), "page_id", "left")
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = labelled.groupBy("host").agg(F.count("__bad").alias("n"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    known = written(reputation(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), folder, most_bad), folder, "reputation")
    # Beyond the bound both sides are exchanged, and Spark may split a host that has a third of the pages.
    joined = own.join(F.broadcast(known) if known.count() <= broadcast_hosts else known, "host")
    return joined.withColumn("verdict", F.coalesce("__said", F.when(F.col("block_sure") >= sure, "block").otherwise("allow"))).drop("__said")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and block_rate, the posterior mean of its host."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("block_rate", 6).alias("block_rate"))


def _strength_sql(level: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(n, 0) = 0 OR k < 2 THEN 1.0 WHEN between_ > 0 THEN least(1000.0, greatest(1.0, within_ / between_ - 1)) WHEN within_ > 0 THEN 1000.0 ELSE 1.0 END
  FROM (SELECT *, CASE WHEN n - nn / n > 0 THEN (sq - n * mean * mean - (k - 1) * within_) / (n - nn / n) ELSE 0 END AS between_
    FROM (SELECT *, bad / n AS mean, bad / n * (1 - bad / n) AS within_
      FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * (bad / n) * (bad / n)) AS sq, count(*) AS k, sum(n * n)::DOUBLE AS nn FROM {level} WHERE n > 0))))"""


def _rule_sql(column: int) -> str:
    tests = [f"WHEN (host = '{r[1]}' OR suffix(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{(r[1] + r[2], r[0])[column]}'" for r in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return "CASE " + " ".join(tests) + " END"


_LISTED = ", ".join(f"'{x}'" for x in BAD_WORDS)
_DEEP = ", ".join(f"'{x}'" for x in SUFFIXES)
#: The tail of the beta distribution is summed as a power series, of the smaller side.
OP10_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, list_filter(string_split_regex(coalesce(html, ''), '{HIDDEN}'), lambda x: trim(x) <> '') AS blocks FROM pages),
v AS (SELECT page_id, host, path, coalesce(list_sum(list_transform(blocks, lambda x: length(x))), 0) AS total, coalesce(list_sum(list_transform(list_distinct(blocks), lambda x: length(x))), 0) AS once,
  list_filter(string_split_regex(translate(array_to_string(blocks, ' '), '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM u),
w AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS said, (list_has_any(string_split_regex(lower(host || '/' || path), '[^a-z0-9]+'), [{_LISTED}]) OR total > 0 AND 2 * once <= total
  OR len(list_filter(terms, lambda x: x IN ({_LISTED}))) >= greatest(3, len(terms) / 50))::INTEGER AS bad, string_split(host, '.') AS labels FROM v),
l AS (SELECT host, any_value(array_to_string(labels[-2:], '.')) AS two, any_value(array_to_string(labels[-3:], '.')) AS three, any_value(labels[-1]) AS one, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM w GROUP BY 1),
hosts AS (SELECT host, n, bad, CASE WHEN two IN ({_DEEP}) THEN three ELSE two END AS domain, CASE WHEN two IN ({_DEEP}) THEN two ELSE one END AS suffix FROM l),
domains AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1),
ends AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
k AS (SELECT {_strength_sql("ends")} AS ks, {_strength_sql("domains")} AS kd, {_strength_sql("hosts")} AS kh, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM ends) AS prior),
er AS (SELECT suffix, (bad + ks * prior) / (n + ks) AS suffix_rate FROM ends, k),
dr AS (SELECT domain, (bad + kd * suffix_rate) / (n + kd) AS domain_rate FROM domains JOIN er USING (suffix), k),
ab AS (SELECT host, bad + kh * domain_rate AS a, n - bad + kh * (1 - domain_rate) AS b FROM hosts JOIN dr USING (domain), k),
sides AS (SELECT *, {MOST_BAD} > (a + 1) / (a + b + 2) AS swap FROM ab),
pq AS (SELECT host, a, b, swap, CASE WHEN swap THEN b ELSE a END AS p, CASE WHEN swap THEN a ELSE b END AS q, CASE WHEN swap THEN 1 - {MOST_BAD} ELSE {MOST_BAD} END AS x FROM sides),
tails AS (SELECT host, a, b, swap, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(x) + q * ln(1 - x)) / p
  * list_sum(list_transform(generate_series(0, 3000), lambda i: exp(lgamma(p + q + i) - lgamma(p + q) - lgamma(p + 1 + i) + lgamma(p + 1) + i * ln(x)))) AS below FROM pq),
rep AS (SELECT host, a / (a + b) AS block_rate, CASE WHEN swap THEN below ELSE 1 - below END AS block_sure FROM tails)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN block_sure >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict, round(block_rate, 6) AS block_rate FROM w JOIN rep USING (host)
"""
