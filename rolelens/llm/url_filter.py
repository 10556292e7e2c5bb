"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted per host. A host's share of good pages is shrunk
towards its registered domain's, that towards its suffix's, that towards the share of all pages, each
by a beta-binomial prior: the parent's posterior mean, with a strength that is estimated per level from
how much the children's shares vary (method of moments). A host is blocked if even the upper posterior
bound of its good share is below a threshold; a host without outcomes takes its domain's posterior.

Outcomes are combined map-side per host before any shuffle, and everything above hosts works on those
counts. Pages meet their host's verdict in one join of a stored table, which adaptive execution splits
if one host holds a large part of the pages.

Defined results: a NULL url, or one without ``://``, has an empty host and path, which no rule fits; the
empty host has a reputation like any other. Outcomes that are NULL are left out. Without outcomes all
hosts have the prior share 0.5 and are allowed. Repeated pages are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolelens.llm.text import ascii_lower
from rolelens.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, a slash and the start of a path; it fits the host and its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: The given rules.
RULES = (
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
)

#: Second labels under which countries register names.
CATEGORIES = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")

#: A host is blocked if the upper bound (this many deviations) of its good share is below MIN_GOOD.
DEVIATIONS = 1.645
MIN_GOOD = 0.5
#: Bounds of the estimated correlation within a parent, so that priors stay proper.
MIN_CORRELATION, MAX_CORRELATION = 0.001, 0.5


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first(rules: tuple[Rule, ...], value) -> Column:
    """The value of the longest rule that fits host and path; of rules as long, the first."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        out = F.when(fits & F.startswith(F.col("path"), F.lit(rule.path)), F.lit(value(rule))).otherwise(out)
    return out


def _levels(host: str) -> list[Column]:
    """The registered domain and the suffix of a host, without port and last dot.

    The suffix is the last label, or the last two where those are a category under a country (``co.uk``); the
    domain has one label more. A numeric address (IPv4, or IPv6 in brackets) is a domain and a suffix of its own.
    """
    bare = F.regexp_replace(host, r"\.?(:[0-9]*)?\z", "")
    numeric = bare.rlike(r"^[0-9]+(\.[0-9]+){3}\z") | bare.startswith("[")
    category = bare.rlike(rf"(^|\.)({'|'.join(CATEGORIES)})\.[a-z][a-z]\z")

    def labels(n: int) -> Column:
        return F.when(numeric, bare).when(category, F.substring_index(bare, ".", -n - 1)).otherwise(F.substring_index(bare, ".", -n))

    return [labels(2).alias("domain"), labels(1).alias("suffix")]


def _shrunk(joined: DataFrame) -> DataFrame:
    """Rows with key columns, n, good and prior (the parent's mean): their posterior a, b instead of the prior."""
    m = F.col("prior")
    variance = m * (1 - m)
    # how far shares lie from the parent's, against what chance alone would give
    excess = F.sum(F.when(variance > 0, (F.col("good") - F.col("n") * m) ** 2 / (F.col("n") * variance) - 1))
    correlation = F.coalesce(F.try_divide(excess, F.sum(F.col("n") - 1)), F.lit(MIN_CORRELATION))
    bounded = F.least(F.greatest(correlation, F.lit(MIN_CORRELATION)), F.lit(MAX_CORRELATION))
    strength = F.lit(joined.agg((1 / bounded - 1).alias("strength")).first()["strength"])  # one number
    return joined.select(
        *[c for c in joined.columns if c != "prior"],
        (m * strength + F.col("good")).alias("a"),
        ((1 - m) * strength + F.col("n") - F.col("good")).alias("b"),
    )


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of the good share: level (host, domain, suffix or all), name, a, b.

    ``outcomes`` has host and good (boolean), one row per labelled page.
    """
    ensure_checkpoint_dir(outcomes.sparkSession)
    counted = (
        outcomes.where("host IS NOT NULL AND good IS NOT NULL")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
        .checkpoint()
    )
    n, good = F.sum("n").alias("n"), F.sum("good").alias("good")
    hosts = counted.select("host", *_levels("host"), "n", "good")
    domains = hosts.groupBy("domain", "suffix").agg(n, good)
    suffixes = domains.groupBy("suffix").agg(n, good)
    total = hosts.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    a, b = total["good"] + 1.0, total["n"] - total["good"] + 1.0  # two numbers
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")
    by_suffix = _shrunk(suffixes.withColumn("prior", F.lit(a / (a + b)))).checkpoint()
    by_domain = _shrunk(domains.join(by_suffix.select("suffix", mean), "suffix")).checkpoint()
    by_host = _shrunk(hosts.drop("suffix").join(by_domain.select("domain", mean), "domain"))
    out = hosts.sparkSession.createDataFrame([("all", "", a, b)], "level string, name string, a double, b double")
    for level, frame in (("suffix", by_suffix), ("domain", by_domain), ("host", by_host)):
        out = out.unionByName(frame.select(F.lit(level).alias("level"), F.col(level).alias("name"), "a", "b"))
    return out


def blocked_names(reputation: DataFrame) -> DataFrame:
    """The reputation with ``blocked``: the upper bound of the good share is below MIN_GOOD."""
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return reputation.withColumn("blocked", a / (a + b) + DEVIATIONS * deviation < MIN_GOOD)


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    ``pages`` has page_id and url; ``outcomes`` page_id and good.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = placed.select("page_id", "host").join(outcomes.select("page_id", "good"), "page_id")
    names = blocked_names(host_reputation(labelled)).select("level", "name", "blocked").checkpoint()
    hosts = placed.select("host").distinct().select("host", *_levels("host"))
    verdicts = hosts
    for level, key in (("host", "host"), ("domain", "domain"), ("suffix", "suffix")):
        own = names.where(F.col("level") == level).select(F.col("name").alias(key), F.col("blocked").alias(f"_{level}"))
        verdicts = verdicts.join(own, key, "left")
    every = F.lit(names.where("level = 'all'").first()["blocked"])
    verdicts = verdicts.select("host", F.coalesce(F.col("_host"), F.col("_domain"), F.col("_suffix"), every).alias("blocked")).checkpoint()
    by_rule = _first(rules, lambda r: r.verdict)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return placed.join(verdicts, "host").select(
        "page_id", "host", "path", _first(rules, lambda r: r.pattern).alias("rule"),
        F.coalesce(by_rule, method).alias("verdict"),
    )
