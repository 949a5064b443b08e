"""URL filters: host rules, and empirical-Bayes reputation of hosts from labelled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import ascii_lower, small_side, written

#: The rules asked for, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which names are registered; any other suffix is the last label. A parameter, since no public list is at hand.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end. Both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the page's or above it and whose path the page's begins with; null without one."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return rule, verdict


def suffix_and_domain(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """The host's public suffix and its registered domain (one label more; the host itself if it has none)."""
    bare = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(list(suffixes))
    return F.when(long, two).otherwise(F.substring_index(bare, ".", -1)), F.when(long, F.substring_index(bare, ".", -3)).otherwise(two)


def _shrink(child: DataFrame, parent: DataFrame | None, key: str, up: str | None, overall: float) -> DataFrame:
    """child (key, up, n, bad) with mean and strength: the beta-binomial posterior mean under a prior at the parent's mean.

    The prior's strength is fitted by moments: the children's spread about their parents, beyond binomial noise, gives the intra-class
    correlation r, and a prior worth (1 - r) / r observations.
    """
    df = child.withColumn("prior", F.lit(overall)) if parent is None else child.join(parent.select(up, F.col("mean").alias("prior")), up)
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / (F.col("prior") * (1 - F.col("prior")))
    got = df.agg(F.sum(spread).alias("spread"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("more")).first()
    r = ((got["spread"] or 0.0) - (got["groups"] or 0)) / got["more"] if got["more"] else 0.0
    r = min(max(r, 0.001), 0.5)
    strength = (1 - r) / r
    return df.withColumn("strength", F.lit(strength)).withColumn("mean", (F.col("bad") + F.lit(strength) * F.col("prior")) / (F.col("n") + F.lit(strength)))


def beta_quantile(a: Column, b: Column, z: float) -> Column:
    """About the quantile of a beta law at the normal deviate z: the cube root of a gamma variable is nearly normal (Wilson and Hilferty), so that of a ratio of two solves a quadratic. Never under 0."""
    p, q, c, d = 1 - 1 / (9 * a), 1 - 1 / (9 * b), 1 / (9 * a), 1 / (9 * b)
    lead = F.greatest(q * q - z * z * d, F.lit(1e-9))
    root = F.sqrt(F.greatest(p * p * q * q - lead * (p * p - z * z * c), F.lit(0.0)))
    ratio = F.greatest((p * q + (root if z > 0 else -root)) / lead, F.lit(0.0))
    odds = a / b * F.pow(ratio, 3)
    return odds / (1 + odds)


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """hosts (host, suffix, domain) with bad_rate, lower and overall: the posterior mean of the share of bad pages, a bound that the posterior exceeds with the chance that z stands for (0.95), and the share of all labelled pages.

    outcomes: (host, suffix, domain, bad 0/1), one row per labelled page. Counts add up from host to domain to suffix with partial sums.
    Hosts without labelled pages take their domain's mean, domains without take their suffix's, suffixes without the overall rate.
    """
    by_host = written(outcomes.groupBy("host", "suffix", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "hosts")
    total = by_host.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    overall = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    by_domain = by_host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = written(_shrink(by_suffix, None, "suffix", None, overall), "suffix")
    domain = written(_shrink(by_domain, suffix, "domain", "suffix", overall), "domain")
    host = written(_shrink(by_host, domain.select("domain", "mean"), "host", "domain", overall), "host")
    strength = host.select("strength").first()
    m = strength["strength"] if strength else 1.0
    df = hosts.join(suffix.select("suffix", F.col("mean").alias("s_mean")), "suffix", "left").join(domain.select("domain", F.col("mean").alias("d_mean")), "domain", "left").join(host.select("host", "n", "bad"), "host", "left")
    prior = F.coalesce("d_mean", "s_mean", F.lit(overall))
    a, b = F.coalesce("bad", F.lit(0)) + m * prior, F.coalesce(F.col("n") - F.col("bad"), F.lit(0)) + m * (1 - prior)
    rate = a / (a + b)
    return df.select("host", rate.alias("bad_rate"), beta_quantile(a, b, -z).alias("lower"), F.lit(float(overall)).alias("overall"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, times: float = 1.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate). Pages no rule fits are blocked if even the lower posterior bound of their host's share of bad pages exceeds `times` that of all pages.

    labels: (doc_id, quality, toxic). A page's outcome is the label of the document whose number ends its path, a suffix or a slash aside (bad: toxic, or of quality 0);
    a document with several labels counts as bad if any says so. Null and empty urls have empty host and path and the overall rate; without labels every host has the overall rate
    and none is blocked. Null ids and repeated rows keep a row each; an empty table gives an empty result; other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    suffix, domain = suffix_and_domain(F.col("host"))
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"))
    number = F.regexp_extract("path", r"/(\d{1,18})(?:\.[a-z]+)?/?$", 1)
    named = urls.withColumn("doc_id", F.when(number != "", number.cast("long"))).where("doc_id IS NOT NULL")
    outcomes = named.join(known, "doc_id").select("host", suffix.alias("suffix"), domain.alias("domain"), "bad")
    hosts = written(urls.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "all_hosts")
    n = hosts.count()
    scored = written(reputation(hosts.select("host", suffix.alias("suffix"), domain.alias("domain")), outcomes), "reputation")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("lower") > times * F.col("overall"), "block").otherwise("allow")
    return urls.join(small_side(scored, n), "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))
