"""URL filtering by fixed rules and by host reputation.

Reputation. Every labelled page is a trial of its host: good or bad. A beta-binomial prior runs down the
name: the corpus rate is the prior mean of a suffix, a suffix's posterior mean that of its registered
domains, a domain's posterior mean that of its hosts. The prior's strength (as many trials as it counts)
is fitted at each level by moments. A host is blocked when even the upper end of its posterior interval of
the good rate is below ``min_good``; few trials leave the interval wide, so an unknown host is allowed
unless its domain or suffix speaks against it.

Cases. A null url, or one without ``://``, has an empty host and path; the empty host has no labelled
outcomes of its own and is allowed. Pages without a label count for nothing but are judged. Labels repeated
for one document count once, as the worst of them. Without any label every host is allowed. Repeated pages
give repeated rows. An empty table gives no rows. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import materialise

#: (verdict, host, path)
Rule = tuple[str, str, str]

# Suffixes of more than one label under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "com.mx", "com.tr", "com.cn", "co.in", "co.kr")


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, prior: str, weakest: float = 2.0, strongest: float = 1000.0) -> float:
    """Prior trials by moments: of groups with columns n, good and a prior mean.

    E[(k - n m)^2] = m (1 - m) n (1 + (n - 1) r), r = 1 / (s + 1). Sums over groups with two trials or
    more give r; no spread beyond the binomial gives the strongest prior, no such group the weakest.
    """
    m = F.col(prior)
    v = m * (1 - m)
    row = groups.where("n >= 2").agg(F.sum(F.pow(F.col("good") - F.col("n") * m, 2)).alias("seen"), F.sum(v * F.col("n")).alias("binomial"), F.sum(v * F.col("n") * (F.col("n") - 1)).alias("extra")).first()
    if not row["extra"]:
        return weakest
    r = (row["seen"] - row["binomial"]) / row["extra"]
    return strongest if r <= 1 / (strongest + 1) else max(weakest, 1 / min(r, 1.0) - 1)


def _level(groups: DataFrame, parents: DataFrame | None, key: str, prior: float | None) -> DataFrame:
    """Posterior mean and strength of each group, given its parent's mean."""
    if parents is None:
        groups = groups.withColumn("prior", F.lit(prior))
    else:
        groups = groups.join(parents, key).withColumnRenamed("mean", "prior")
    groups = materialise(groups, "level")
    s = _strength(groups, "prior")
    return groups.withColumn("alpha", F.lit(s) * F.col("prior") + F.col("good")).withColumn("beta", F.lit(s) * (1 - F.col("prior")) + F.col("n") - F.col("good")).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, good, mean, upper for every distinct host.

    ``hosts`` has a column host (repeats allowed), ``outcomes`` host and good (0 or 1). Counts are
    combined before each shuffle; the levels above hosts are ever smaller tables.
    """
    trials = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    base = hosts.select("host").distinct().join(trials, "host", "left").na.fill(0, ["n", "good"])
    base = base.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    base = materialise(base, "hosts")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = base.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = base.agg(*sums).first()
    rate = (total["good"] + 1) / (total["n"] + 1) if total["n"] else 1.0  # a prior success keeps a corpus without good pages off zero
    suffixes = _level(suffixes, None, "", min(rate, 1.0))
    domains = _level(domains, suffixes.select("suffix", "mean"), "suffix", None)
    judged = _level(base, domains.select("domain", "mean"), "domain", None)
    a, b = F.col("alpha"), F.col("beta")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return judged.select("host", "n", "good", "mean", F.least(F.lit(1.0), F.col("mean") + z * sd).alias("upper"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], *, min_good: float = 0.6, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior_mean, posterior_upper for every page.

    ``labels`` has doc_id, quality and toxic; the last number in a url's path is its page's document.
    """
    base = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = match_rules(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", ruled)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    number = F.expr(r"try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') as bigint)")
    outcomes = base.where("host <> ''").select("host", number.alias("doc_id")).join(known, "doc_id").select("host", "good")
    reputation = materialise(host_reputation(base, outcomes, z), "reputation")
    judged = base.join(reputation.select("host", F.col("mean").alias("posterior_mean"), F.col("upper").alias("posterior_upper")), "host", "left")
    method = F.when(F.col("posterior_upper") < min_good, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "posterior_mean", "posterior_upper")
