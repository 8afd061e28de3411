"""URL rules with empirical-Bayes host reputation for everything no rule covers.

Labelled page outcomes are counted per host. A host's rate of bad pages is shrunk
towards the rate of its registered domain, that towards its suffix, and that towards the
rate of all pages; every level is a beta-binomial model whose prior strength is found by
the method of moments from the groups of that level. A page is blocked when the lower
posterior bound of its host's bad rate reaches ``max_bad``.

Rules:

* Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
  Path: what follows up to ``?``, ``#`` or the end. A null URL or one without ``://`` has
  an empty host and path; it is judged like a host without labels of an unknown domain.
* The registered domain of a host is one label and its suffix: the longest of the suffixes
  of several labels that the caller names, or else the last label. A port is no part of
  either. An address is its own domain.
* A rule ``host/path`` fits its host and all subdomains when the URL's path starts with
  the rule's path; the longest rule wins.
* Repeated page rows are judged one by one; null outcomes count for nothing; without any
  label every bound is that of the uniform prior. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.sources.workspace import stage

LEVELS = ("suffix", "domain", "host")
#: Common suffixes of two labels. Callers with other hosts pass a fuller list.
SUFFIXES = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk com.au edu.au gov.au net.au org.au ac.nz co.nz govt.nz net.nz "
    "org.nz ac.jp co.jp go.jp ne.jp or.jp com.br net.br org.br com.cn edu.cn gov.cn net.cn org.cn com.mx org.mx com.tr "
    "org.tr co.in net.in org.in co.kr or.kr co.za org.za com.ar com.sg com.tw com.hk com.pl com.ua co.il org.il co.id"
).split()
_ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    target: str  # host and path, like ``example.com/en/``


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_target(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, or null. Rules are a short list known to the caller."""
    targets = [F.lit(None).cast("string")]
    for rule in sorted(rules, key=lambda r: (-len(r.target), r.target)):
        at = rule.target.index("/")
        name, prefix = rule.target[:at], rule.target[at:]
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        targets.insert(-1, F.when(fits, F.lit(rule.target)))
    return F.coalesce(*targets)


def _name_of(host: Column) -> Column:
    return F.regexp_replace(host, r":[0-9]*$", "")


def suffix_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The part below which names are registered; '' of an address."""
    name = _name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(F.rlike(name, F.lit(_ADDRESS)), F.lit("")).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The suffix and one label more."""
    name = _name_of(host)
    two = F.substring_index(name, ".", -2)
    return (
        F.when(F.rlike(name, F.lit(_ADDRESS)), name)
        .when(two.isin(*suffixes), F.substring_index(name, ".", -3))
        .otherwise(two)
    )


def _strength(groups: DataFrame) -> float:
    """Prior observations of a level, by moments of its groups' rates; between 1 and 10,000."""
    rate = F.sum("bad") / F.sum("seen")
    m = groups.where("seen > 0").agg(
        F.count(F.lit(1)).alias("groups"),
        rate.alias("rate"),
        F.sum("seen").alias("n"),
        F.sum(F.col("seen") * F.col("seen")).alias("n2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("seen")).alias("k2"),
    ).first()
    if not m.groups or m.groups < 2:
        return 1.0
    inside = m.rate * (1 - m.rate)
    # Weighted between-group variance, less what sampling alone would give.
    between = (m.k2 - m.n * m.rate * m.rate - (m.groups - 1) * inside) / (m.n - m.n2 / m.n)
    if between <= 0:
        return 10_000.0
    return float(min(10_000.0, max(1.0, inside / between - 1)))


def host_reputation(outcomes: DataFrame, z: float = 1.645, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Posterior per host from ``outcomes(host, bad)``; ``bad`` is 0, 1 or null (not labelled).

    Returns ``host, seen, bad, bad_rate, bad_at_least``. Only one small row of moments
    per level reaches the driver.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    host = F.col("host")
    # Read for every level and for the result, so counted once.
    hosts = stage(hosts.withColumns({"domain": domain_of(host, suffixes), "suffix": suffix_of(host, suffixes)}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).first()
    base = ((total.bad or 0) + 1) / ((total.seen or 0) + 2)
    weight = {name: _strength(level) for name, level in (("suffix", suffixes), ("domain", domains), ("host", hosts))}

    def shrunk(level: str, prior: Column) -> Column:
        return (F.col("bad") + weight[level] * prior) / (F.col("seen") + weight[level])

    suffixes = suffixes.select("suffix", shrunk("suffix", F.lit(base)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk("domain", F.col("suffix_rate")).alias("domain_rate"))
    rated = hosts.join(domains, "domain").withColumn("bad_rate", shrunk("host", F.col("domain_rate")))
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("seen") + weight["host"] + 1))
    return rated.select("host", "seen", "bad", "bad_rate", (F.col("bad_rate") - z * spread).alias("bad_at_least"))


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    page_id: str = "page_id",
    url: str = "url",
    max_bad: float = 0.5,
    z: float = 1.645,
    suffixes: list[str] = SUFFIXES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_at_least`` of every page.

    ``outcomes(host, bad)`` has a row per page, labelled or not.
    """
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in (rule.target, rule.verdict)]) if rules else None
    judged = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("rule", rule_target(F.col("host"), F.col("path"), rules))
    rated = judged.join(host_reputation(outcomes, z, suffixes), "host", "left")
    by_method = F.when(F.col("bad_at_least") >= max_bad, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(verdicts[F.col("rule")], by_method) if rules else by_method
    return rated.select(
        F.col("page_id").alias(page_id), "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "bad_at_least"
    )
