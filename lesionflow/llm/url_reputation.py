"""URL filter: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix. A
beta-binomial prior passes down: the suffix shrinks to the overall rate, the registered domain to its
suffix, the host to its registered domain. The prior's weight at each level is a moment estimate from the
spread of the rates one level below. A host is blocked when the lower bound of its bad rate (posterior
mean less ``z`` standard deviations) exceeds ``limit``.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``,
``#`` or the end. Null urls and urls without ``://`` have an empty host and path; the empty host is a host
like others. A rule ``host/path`` fits its host and all subdomains if the url's path starts with the
rule's; the longest rule wins, of equally long ones the first in order. Hosts without labelled pages take
their domain's posterior as prior and hence its bound. Repeated pages count once each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stash
from .text import ascii_lower

#: Rules are part of the expression, so their number is bounded.
MOST_RULES = 500
#: Frequent public suffixes of two labels that the registered domain must not stop at; callers may give a whole list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.mx", "com.ar")
#: Prior weights stay within these pseudo-counts.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits. rules: (verdict, 'host/path')."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def weight(n: Column, bad: Column, parent_mean: Column) -> Column:
    """Moment estimate of the prior's pseudo-counts from the children (n, bad) of parents with known means."""
    p = bad / n
    within = F.sum(parent_mean * (1 - parent_mean))
    spread = F.sum(n * (p - parent_mean) * (p - parent_mean))
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) / (w + 1)), solved for w over all children
    excess = spread - within
    room = F.sum(parent_mean * (1 - parent_mean) * (n - 1))
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(F.when(excess > 0, room / excess - 1), F.lit(MOST_WEIGHT))))


def reputation(outcomes: DataFrame, z: float = 1.64, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Per host of outcomes (host, bad 0/1 or null where unlabelled): labelled, bad, mean, bad_lower. The counts of each level are
    kept, as the levels below and above both read them."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stash(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    domains = stash(hosts.groupBy("domain", "suffix").agg(F.sum("labelled").alias("n_d"), F.sum("bad").alias("b_d")))
    ends = stash(domains.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("b_d").alias("b_s")))
    top = ends.agg(((F.coalesce(F.sum("b_s"), F.lit(0)) + 1) / (F.coalesce(F.sum("n_s"), F.lit(0)) + 2)).alias("m_0"))

    def passed_down(children: DataFrame, n: str, bad: str, above: str, mean: str) -> DataFrame:
        seen = children.where(F.col(n) > 0)
        one = seen.agg(weight(F.col(n), F.col(bad), F.col(above)).alias("w"))  # a single row
        return children.crossJoin(F.broadcast(one)).withColumn(mean, (F.col(bad) + F.col("w") * F.col(above)) / (F.col(n) + F.col("w")))

    s = passed_down(ends.crossJoin(F.broadcast(top)), "n_s", "b_s", "m_0", "m_s").select("suffix", "m_s")
    d = stash(passed_down(domains.join(s, "suffix"), "n_d", "b_d", "m_s", "m_d").select("domain", "suffix", "m_d"))
    h = passed_down(hosts.join(d, ["domain", "suffix"]), "labelled", "bad", "m_d", "mean")
    size = F.col("labelled") + F.col("w")
    lower = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return h.select("host", "labelled", "bad", "mean", lower.alias("bad_lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, z: float = 1.64, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled, bad of pages (page_id, url); outcomes: (page_id, bad 0/1)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = reputation(rows.select("page_id", "host").join(known, "page_id", "left"), z, suffixes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad_lower") > limit, "block").otherwise("allow")
    return rows.join(hosts, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "labelled", "bad")
