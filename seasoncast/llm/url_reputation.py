"""Empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix.
Each level shrinks its rate towards its parent through a beta-binomial prior
whose strength is estimated from the data (moments of the children around
their parents): all pages -> suffix -> domain -> host.  A page is allowed when
the lower posterior bound of its host's rate reaches ``min_rate``; explicit
rules on host and path come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasoncast.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br",
                      "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")

MIN_RHO, MAX_RHO = 1e-4, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``; both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2))


def domain_and_suffix(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; user and port are left out, an address is its own domain."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    address = name.rlike(r"^[0-9.]+$")
    suffix = F.when(address, F.lit("")).when(long, two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    three = F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    domain = F.when(address, name).when(long & (three != ""), three).when((two != "") & ~long, two).otherwise(name)
    return domain, suffix


def matching_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule ``host/path`` that fits, else null.  ``rules``: ``(rule, verdict)`` pairs."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _strength(children: DataFrame) -> float:
    """Prior strength k = 1/rho - 1, rho by moments of child counts (n, y) around the parent rate ``mu``."""
    noise = F.col("n") * F.col("mu") * (1 - F.col("mu"))
    row = children.where("n > 0").agg(F.sum(F.pow(F.col("y") - F.col("n") * F.col("mu"), 2) - noise).alias("over"),
                                      F.sum(noise * (F.col("n") - 1)).alias("room")).first()
    rho = row["over"] / row["room"] if row["room"] else MIN_RHO
    return 1.0 / min(max(rho, MIN_RHO), MAX_RHO) - 1.0


def host_reputation(judged: DataFrame) -> DataFrame:
    """``(host, domain, suffix, good)`` per page, good 0/1 or null -> one row per host.

    Columns: ``host, n, y, rate, spread`` - labelled pages, good ones, posterior
    mean and standard deviation.  Counts are pre-aggregated before every
    shuffle, so a host with a third of all pages is a row per task.  Only two
    sums per level reach the driver.  No labelled page at all: the prior is
    Beta(1, 1) and every host gets its mean.
    """
    counts = materialise(judged.groupBy("host", "domain", "suffix")
                         .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("y")), "hosts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    base = ((total["y"] or 0) + 1) / ((total["n"] or 0) + 2)

    def posterior(children, k):
        return children.withColumn("rate", (F.lit(k) * F.col("mu") + F.col("y")) / (F.lit(k) + F.col("n")))

    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("mu", F.lit(base))
    suffixes = posterior(suffixes, _strength(suffixes)).select("suffix", F.col("rate").alias("mu"))
    domains = domains.join(suffixes, "suffix")
    domains = posterior(domains, _strength(domains)).select("domain", "suffix", F.col("rate").alias("mu"))
    hosts = counts.join(domains, ["domain", "suffix"])
    k = _strength(hosts)
    a, b = F.lit(k) * F.col("mu") + F.col("y"), F.lit(k) * (1 - F.col("mu")) + F.col("n") - F.col("y")
    return (posterior(hosts, k)
            .select("host", "n", "y", "rate", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("spread")))


def page_outcomes(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One outcome per labelled page: 1 if of good quality and not toxic; the worst label of a page counts."""
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    return (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
            .groupBy(F.col(key).alias("page_id")).agg(F.min(good).alias("good")))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules=(), min_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, labelled, host_rate, host_bound``.

    ``pages`` needs ``page_id, url``, ``outcomes`` ``page_id, good``; other
    columns are ignored.  A null url has empty host and path and is judged as
    the host ``''``; a null page_id is kept and has no label; repeated rows are
    judged and returned each.  Empty ``pages``: no rows; empty ``outcomes``:
    all hosts get the prior.
    """
    host, path = split_url(F.col("url"))
    page = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = domain_and_suffix(F.col("host"))
    judged = page.withColumns({"domain": domain, "suffix": suffix}).join(outcomes.select("page_id", "good"), "page_id", "left")
    hosts = host_reputation(judged)
    bound = F.col("rate") - F.lit(z) * F.col("spread")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for text, verdict in rules:
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    return (page.join(hosts, "host").withColumn("rule", rule)
            .select("page_id", "host", "path", "rule",
                    F.coalesce(by_rule, F.when(bound >= F.lit(min_rate), F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
                    F.col("n").alias("host_labelled"), F.round("rate", 6).alias("host_rate"), F.round(bound, 6).alias("host_bound")))
