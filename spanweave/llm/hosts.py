"""URL filters with empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain
and suffix. Each level is a beta-binomial whose prior is what the level above
says *without* it: a host shrinks to the rest of its domain, that to the rest
of the suffix, that to all other suffixes. So no page is counted twice, and
a host that is alone takes the next level up. How strongly is learnt from the
data: the intra-class correlation ``rho`` of each level (how much more its
groups differ than chance allows, 0.5 at most) gives the prior's weight
``1 / rho - 1`` in pages, so a single page never outweighs a prior. A host is
blocked when even the lower bound of its posterior share of bad pages is
above the limit. The bound is the mean less some standard deviations of the
posterior beta, which is a little wide for shares close to 0.

Suffixes are the last label of a host, or one of ``PUBLIC_SUFFIXES`` (a
parameter); the registered domain has one label more. A port or user part
belongs to the host as it stands in the url; of an IP address the last two
numbers count as its domain.

Listed rules come first: the longest rule that fits a url decides it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm._store import stored

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, LETTERS, LETTERS.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: Public suffixes of two labels: fixed values.
PUBLIC_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "co.kr", "co.in", "co.za",
                   "com.br", "com.cn", "com.mx", "com.tr", "com.ar")


def _ends(suffixes: tuple[str, ...]) -> str:
    return "(?:" + "".join(x.replace(".", "\\.") + "|" for x in suffixes) + "[^.]*)"


def domain_of(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The suffix of a host and the label before it (the whole of a shorter host)."""
    return F.regexp_extract(host, rf"(?s)((?:[^.]*\.)?{_ends(suffixes)})$", 1)


def suffix_of(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    return F.regexp_extract(host, rf"(?s)(?:^|\.)({_ends(suffixes)})$", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``struct(verdict, rule)`` of the longest rule ``(verdict, host/path)`` that fits, else null.

    A rule fits its host and all subdomains where the path starts with the
    rule's; of rules of one length the first by name wins. Rules are a
    parameter: every page is held against each, so they are a short list.
    """
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        own = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        fits.append(F.when(own, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def _weight(groups: DataFrame, n: str, x: str, mu: str, least: float = 1e-3, most: float = 0.5) -> float:
    """Prior weight of a level from its groups' counts and the mean each shrinks to (groups without such a mean say nothing)."""
    v = F.col(mu) * (1 - F.col(mu))
    off = F.pow(F.col(x) / F.col(n) - F.col(mu), F.lit(2)) * F.col(n)
    rho = F.sum(off - v) / F.nullif(F.sum(v * (F.col(n) - 1)), F.lit(0.0))
    known = groups.where((F.col(n) > 0) & (F.col(mu) > 0) & (F.col(mu) < 1))
    return known.agg(1 / F.least(F.greatest(F.coalesce(rho, F.lit(least)), F.lit(least)), F.lit(most)) - 1).first()[0]


def _shrunk(x: Column, n: Column, mu: Column, weight: float) -> Column:
    """Posterior mean of ``x`` of ``n`` under a prior of ``weight`` pages; without a prior the share itself, null without pages."""
    return F.coalesce((x + F.lit(weight) * mu) / (n + F.lit(weight)), x / F.nullif(n, F.lit(0)))


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """``(host, n, bad, mean, sd)``: posterior share of bad pages of every host of ``pages (page_id, host)``.

    ``outcomes (page_id, bad)`` has 1 for a bad page and 0 for another; other
    values and null ids teach nothing. Where no other host has outcomes the
    prior's mean is 0. Sums over a hot host are made in part before they shuffle.
    """
    known = outcomes.where("bad in (0, 1)").select(F.col("page_id").alias("of"), "bad")
    seen = pages.where("page_id is not null").join(known, F.col("page_id") == F.col("of"), "left")
    own = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("x"))
    every = pages.select("host").distinct().withColumnRenamed("host", "h")
    hosts = stored(every.join(own, F.col("h") == F.col("host"), "left").select(
        F.col("h").alias("host"), domain_of(F.col("h"), suffixes).alias("domain"), suffix_of(F.col("h"), suffixes).alias("suffix"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("x", F.lit(0)).cast("bigint").alias("x")), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx")), "domains")
    sums = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dx").alias("sx"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("x"), F.lit(0))).first()
    elsewhere = (total[1] - F.col("sx")) / F.nullif(total[0] - F.col("sn"), F.lit(0))
    level = sums.select(F.col("suffix").alias("s"), "sn", "sx", elsewhere.alias("top"))
    prior = _shrunk(F.col("sx") - F.col("dx"), F.col("sn") - F.col("dn"), F.col("top"), _weight(level, "sn", "sx", "top"))
    domains = domains.join(level, F.col("suffix") == F.col("s")).select(F.col("domain").alias("d"), "dn", "dx", prior.alias("above"))
    prior = _shrunk(F.col("dx") - F.col("x"), F.col("dn") - F.col("n"), F.col("above"), _weight(domains, "dn", "dx", "above"))
    found = stored(hosts.join(domains, F.col("domain") == F.col("d")).select("host", "n", "x", prior.alias("mu")), "host-priors")
    weight = _weight(found, "n", "x", "mu")
    mean = (F.col("x") + F.lit(weight) * F.coalesce("mu", F.lit(0.0))) / (F.col("n") + F.lit(weight))
    return (found.withColumn("mean", mean)
            .select("host", "n", F.col("x").alias("bad"), "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(weight + 1))).alias("sd")))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               max_bad: float = 0.25, deviations: float = 1.645, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``bad_bound``.

    ``verdict`` is the rule's where one fits (see :func:`rule_of`), else
    ``block`` if ``bad_bound``, the posterior mean less ``deviations``
    standard deviations, is above ``max_bad``, else ``allow``. A null url or
    one without ``://`` has an empty host and path and is judged as the host
    named by the empty text. Rows with null ids are judged and teach nothing;
    repeated rows each count. Input columns of the added names are replaced.
    Empty tables give an empty table.
    """
    new = ("host", "path", "rule", "verdict", "bad_bound")
    url = F.col(f"`{url_col}`")
    cut = pages.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = reputations(cut.select("page_id", "host"), outcomes, suffixes).select(
        F.col("host").alias("h"), (F.col("mean") - deviations * F.col("sd")).alias("bad_bound"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = cut.withColumn("fit", rule).join(known, F.col("host") == F.col("h"), "left")
    other = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return judged.select(*(F.col("row").getField(c).alias(c) for c in pages.columns if c not in new), "host", "path",
                         F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), other).alias("verdict"), "bad_bound")
