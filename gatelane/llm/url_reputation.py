"""Host reputation by empirical Bayes, and url rules that overrule it.

Labelled page outcomes (good or bad) are counted per host. The rate of a host is shrunk
towards its registered domain, that of a domain towards its suffix, and that of a suffix
towards the whole table: at each level the counts meet a beta prior whose mean is the
parent's posterior mean and whose strength is estimated by moments from how far the
children scatter around their parents. A host is blocked when the lower bound of its
posterior, mean minus ``z`` standard deviations, is below ``least``.

Built-in functions only. Counts are combined before they are shuffled; three strengths and
one mean (four numbers) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Suffixes of two labels below which names are registered. A parameter: pass a full list for the open web.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
STRENGTHS = (1.0, 10_000.0)


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path`` (which begins with a slash)."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(_raw_host(url), ascii_uppercase, ascii_lowercase)


def _rest(url: str | Column) -> Column:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _raw_host(url: str | Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*", 0)


def path_of(url: str | Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def suffix_of(host: str, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    address = F.col(host).rlike(r"^\d+(\.\d+){3}$")
    return F.when(address, F.lit("")).when(last_two.isin(*two_label), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: str, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label more; an address is its own domain."""
    address = F.col(host).rlike(r"^\d+(\.\d+){3}$")
    last_two = F.substring_index(host, ".", -2)
    return F.when(address, F.col(host)).when(last_two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(last_two)


def rule_for(host: str, path: str, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else null; of equally long ones the first by code point."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)) & F.col(path).startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


def _strength(groups: DataFrame, mean: Column) -> float:
    """Strength of the beta prior around ``mean`` by moments, from ``good`` of ``n`` per group."""
    labelled = groups.filter("n > 0").withColumn("_m", mean)
    spread = F.col("_m") * (1 - F.col("_m"))
    row = labelled.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("_m"), 2)).alias("seen"),
        F.sum(spread).alias("chance"), F.sum(F.col("n") * spread).alias("whole"),
    ).first()
    if row.seen is None or row.whole <= row.chance:
        return STRENGTHS[1]
    # E[seen] = chance + rho * (whole - chance) with rho = 1 / (strength + 1)
    rho = (row.seen - row.chance) / (row.whole - row.chance)
    return min(max(1 / rho - 1, STRENGTHS[0]), STRENGTHS[1]) if rho > 0 else STRENGTHS[1]


def _posterior(mean: Column, strength: float) -> Column:
    return (F.col("good") + F.lit(strength) * mean) / (F.col("n") + F.lit(strength))


def reputation(outcomes: DataFrame, z: float = 1.645, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``outcomes(host, good, n)`` with one row per host to ``host, good, n, mean, low``.

    Hosts without a labelled page (``n`` zero) get what their domain says. Without any
    outcome at all every mean is one half.
    """
    hosts = outcomes.withColumns({"domain": domain_of("host", two_label), "suffix": suffix_of("host", two_label)})
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    base = total.good / total.n if total.n else 0.5
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    suffixes = hosts.groupBy("suffix").agg(*sums)
    suffixes = suffixes.withColumn("suffix_mean", _posterior(F.lit(base), _strength(suffixes, F.lit(base))))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", "suffix_mean"), "suffix")
    domains = domains.withColumn("domain_mean", _posterior(F.col("suffix_mean"), _strength(domains, F.col("suffix_mean"))))
    hosts = hosts.join(domains.select("domain", "suffix", "domain_mean"), ["domain", "suffix"])
    strength = _strength(hosts, F.col("domain_mean"))
    weight = F.col("n") + F.lit(strength)
    mean = _posterior(F.col("domain_mean"), strength)
    return hosts.select("host", "good", "n", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("low"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[Rule], *, url: str = "url", ident: str = "page_id",
    label_ident: str = "doc_id", outcome: str = "quality", z: float = 1.645, least: float = 0.6,
    two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    Outcomes are the labels of the page's identifier: 1 good, 0 bad, anything else (null
    too) none. A null url and one without ``://`` have empty host and path, and share the
    reputation of the empty host. Repeated rows come back as often as they came. Only the
    named columns are read.
    """
    parts = pages.select(F.col(ident).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = labels.filter(F.col(outcome).isin(0, 1)).groupBy(F.col(label_ident).alias("page_id")).agg(
        F.sum(F.col(outcome).cast("long")).alias("good"), F.count("*").alias("n")
    )
    outcomes = parts.select("page_id", "host").join(marks, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    outcomes = written(outcomes, "host-outcomes")  # one row per host, read for each of the three strengths and the verdicts
    verdicts = {rule.text: rule.verdict for rule in rules}
    ruled = F.coalesce(*[F.when(F.col("rule") == t, F.lit(v)) for t, v in verdicts.items()], F.lit(None).cast("string"))
    known = reputation(outcomes, z, two_label).select("host", F.when(F.col("low") < least, "block").otherwise("allow").alias("own"))
    return (
        parts.withColumn("rule", rule_for("host", "path", rules))
        .join(known, "host")
        .select("page_id", "host", "path", "rule", F.coalesce(ruled, "own").alias("verdict"))
    )
