"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (1 bad, 0 good) are counted per host, registered domain
and suffix.  Each level's bad rate is shrunk through a beta prior whose mean is
the shrunk rate of the level above (host -> registered domain -> suffix -> all)
and whose strength is estimated from the spread of the level's own rates.  A page
is blocked when its host's rate is above ``limit`` with confidence: the lower bound,
mean - z * standard deviation, exceeds it.  A host without outcomes is judged by the
distribution that the levels above predict for a new host: the mean of the nearest
level with outcomes, and as variance that level's own uncertainty and the spread of
every level below it.  Rules come first: a rule fits its host, all subdomains and
paths with its prefix, and the longest wins.

Counts are partial aggregates (a hot host is one row per task).  Every distinct host
is judged once, with its domain and suffix; a page meets its host's verdict in one
equi-join that adaptive execution splits when a host is hot.

For its reputation a host is taken without user and port; an address of numbers is
its own domain.  Edge cases: a null url or one without "://" has the empty host, which
has the empty domain and suffix; null outcomes count as unlabelled; repeated rows
count one by one; without any outcome every rate is that of ``prior``; very long urls
are ordinary; extra columns pass unchanged, whatever their names, and result columns
replace columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a label of two letters after one of these is a suffix of two labels (co.uk, com.cn); fixed values
SECOND_LABELS = ("ac", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gub", "idf", "k12", "ltd", "mil", "muni", "ne", "net", "nic",
                 "nom", "or", "org", "plc", "res", "sch", "school", "web")
#: suffixes of two labels that the rule does not give; fixed values, a parameter
WIDE_SUFFIXES = ("me.uk", "nhs.uk", "police.uk", "id.au", "asn.au", "ind.br", "art.br", "blog.br", "eco.br", "in.th", "kiwi.nz", "iwi.nz", "maori.nz",
                 "lg.jp", "ad.jp", "ed.jp", "gr.jp", "re.kr", "pe.kr", "info.tr", "gen.tr", "biz.tr", "law.za", "nom.za")


@dataclass(frozen=True)
class Prior:
    rate: float = 0.1     # bad rate before any outcome
    weight: float = 10.0  # outcomes that this is worth
    low: float = 1.0      # bounds of an estimated prior strength
    high: float = 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _numeric(site: Column) -> Column:
    return site.rlike(r"^([0-9.]+|\[.*\])$")


def _is_wide(two: Column, wide: Sequence[str]) -> Column:
    return two.rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z][a-z]$") | two.isin(list(wide))


def suffix_of(site: Column, wide: Sequence[str] = WIDE_SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_numeric(site), "").when(_is_wide(two, wide), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, wide: Sequence[str] = WIDE_SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_numeric(site), site).when(_is_wide(two, wide), F.substring_index(site, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, action) of the longest fitting (host, path, action) rule, else null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for h, p, action in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def _strength(level: DataFrame, prior: Prior) -> float:
    """Method of moments over a level's (n, k, mean above): how many outcomes the
    mean above is worth."""
    r = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("above"), 2)).alias("spread"),
        F.sum(F.col("n") * F.col("above") * (1 - F.col("above"))).alias("noise"),
        F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    if not r["n"] or not r["noise"]:
        return prior.high
    noise = r["noise"] / r["n"]
    between = r["spread"] / r["n"] - noise * r["rows"] / r["n"]
    return prior.high if between <= 0 else min(prior.high, max(prior.low, noise / between - 1))


def _shrunk(level: DataFrame, m: float) -> DataFrame:
    """Posterior mean and variance of each row of a level."""
    mean = (F.col("k") + m * F.col("above")) / (F.col("n") + m)
    return level.withColumn("mean", mean).withColumn("var", F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m + 1))


def _below(mean: Column, var: Column, m: float) -> Column:
    """Variance of a rate one level under one of this mean and variance."""
    return (mean * (1 - mean) - var) / (m + 1) + var


@dataclass(frozen=True)
class Reputation:
    """Posteriors: hosts (host, n, k, mean, var), domains and suffixes alike, the rate
    of all with its variance, and the strengths of the levels."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    base: float
    base_var: float
    m_host: float
    m_domain: float
    m_suffix: float


def host_posteriors(outcomes: DataFrame, prior: Prior = Prior(), wide: Sequence[str] = WIDE_SUFFIXES) -> Reputation:
    """Shrunk rates from ``outcomes`` (host, bad); a host is one without user and port."""
    hosts = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("k")) \
        .withColumns({"domain": domain_of(F.col("host"), wide), "suffix": suffix_of(F.col("host"), wide)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    seen = total["n"] + prior.weight
    base = (total["k"] + prior.weight * prior.rate) / seen
    suffixes = suffixes.withColumn("above", F.lit(base))
    m_suffix = _strength(suffixes, prior)
    suffixes = _shrunk(suffixes, m_suffix)
    domains = domains.join(suffixes.select("suffix", F.col("mean").alias("above")), "suffix")
    m_domain = _strength(domains, prior)
    domains = _shrunk(domains, m_domain)
    hosts = hosts.join(domains.select("domain", "suffix", F.col("mean").alias("above")), ["domain", "suffix"])
    m_host = _strength(hosts, prior)
    hosts = _shrunk(hosts, m_host)
    return Reputation(hosts.select("host", "n", "k", "mean", "var"), domains.select("domain", "suffix", "mean", "var"),
                      suffixes.select("suffix", "mean", "var"), base, base * (1 - base) / (seen + 1), m_host, m_domain, m_suffix)


def host_rates(sites: DataFrame, known: Reputation, z: float = 1.645, wide: Sequence[str] = WIDE_SUFFIXES) -> DataFrame:
    """(site, rate, lower) of every row of ``sites`` (site, distinct)."""
    at = sites.select("site", domain_of(F.col("site"), wide).alias("domain"), suffix_of(F.col("site"), wide).alias("suffix"))
    at = at.join(known.hosts.select(F.col("host").alias("site"), F.col("mean").alias("hm"), F.col("var").alias("hv")), "site", "left") \
        .join(known.domains.select("domain", "suffix", F.col("mean").alias("dm"), F.col("var").alias("dv")), ["domain", "suffix"], "left") \
        .join(known.suffixes.select("suffix", F.col("mean").alias("sm"), F.col("var").alias("sv")), "suffix", "left")
    # what a level without outcomes inherits
    sm, sv = F.coalesce("sm", F.lit(known.base)), F.coalesce(F.col("sv"), _below(F.lit(known.base), F.lit(known.base_var), known.m_suffix))
    dm, dv = F.coalesce(F.col("dm"), sm), F.coalesce(F.col("dv"), _below(sm, sv, known.m_domain))
    mean, var = F.coalesce(F.col("hm"), dm), F.coalesce(F.col("hv"), _below(dm, dv, known.m_host))
    return at.select("site", mean.alias("rate"), F.greatest(F.lit(0.0), mean - z * F.sqrt(var)).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), url: str = "url", limit: float = 0.25,
          z: float = 1.645, prior: Prior = Prior(), wide: Sequence[str] = WIDE_SUFFIXES) -> DataFrame:
    """``pages`` with host, path, rule, rate (posterior mean), lower (its bound)
    and verdict (allow or block).  ``outcomes``: (url, bad) rows."""
    known = host_posteriors(outcomes.select(site_of(url_parts(F.col("url"))[0]).alias("host"), F.col("bad")), prior, wide)
    h, p, r, s, rate, lower = fresh(pages, "_host", "_path", "_rule", "_site", "_rate", "_lower")
    host, path = url_parts(quoted(url))
    out = pages.withColumns({h: host, p: path})
    out = out.withColumns({r: rule_for(F.col(h), F.col(p), rules), s: site_of(F.col(h))})
    sites = out.select(F.col(s).alias("site")).distinct()
    rates = host_rates(sites, known, z, wide).select(F.col("site").alias(s), F.col("rate").alias(rate), F.col("lower").alias(lower))
    kept = [quoted(c) for c in pages.columns if c == url or c not in ("host", "path", "rule", "rate", "lower", "verdict")]
    verdict = F.coalesce(F.col(r)["action"], F.when(F.col(lower) > limit, "block").otherwise("allow"))
    return out.join(rates, s).select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), F.col(r)["rule"].alias("rule"),
                                     F.col(rate).alias("rate"), F.col(lower).alias("lower"), verdict.alias("verdict"))
