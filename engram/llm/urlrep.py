"""Empirical-Bayes host reputation: labelled page outcomes shrink from host to registered domain to suffix.

Everything is DataFrame expressions. Counts are aggregated by host before anything is joined, so a host with a third of
all pages is one row on the small side; the pages join the reputations by host, and AQE splits the hot host's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import hot_lookup
from engram.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: (verdict, rule), a rule being a host and a path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
STRENGTH_MIN, STRENGTH_MAX = 1.0, 1000.0
#: Labels under which a country's registry gives names, as in co.uk; a domain has a label more there.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "gov", "net", "or", "org")
REGISTRY = rf"\.(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}}$"
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = _rest(F.col(url_col))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return df.withColumns({"host": F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_columns(rules=RULES, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        domain, slash, prefix = text.partition("/")
        fits = ((F.col(host) == domain) | F.col(host).endswith("." + domain)) & F.col(path).startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_columns(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its user and port.

    The suffix is the last label, or the last two of a country's registry such as co.uk; the domain has one label more. A host
    that is a suffix itself, or a single label, is its own domain, and an address is both.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    address = name.rlike(ADDRESS)
    two = F.concat(F.lit("."), name).rlike(REGISTRY)
    domain = F.when(address, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(address, name).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def _level(counts: DataFrame, key: str, parent_mean: Column, parent_keys: list[str]) -> DataFrame:
    """Posterior of each ``key``: a beta prior around the parent's mean, its strength from the spread of the keys' rates.

    Moments: with m keys of n pages each and a variance v between their rates, v = mu (1 - mu) / (s + 1) plus the
    binomial part mu (1 - mu) / n; s is the strength. One strength holds for a level, clamped to a sensible range.
    """
    rate = F.col("good") / F.col("n")
    c = counts.withColumn("parent_mean", parent_mean)
    mu = F.col("parent_mean")
    moments = c.agg(F.sum(F.col("n") * (rate - mu) ** 2).alias("ss"), F.sum(mu * (1 - mu)).alias("binomial"), F.sum(F.col("n") * mu * (1 - mu)).alias("total"))
    between = F.greatest(F.col("ss") - F.col("binomial"), F.lit(0.0))  # over total: the share of the variance between keys
    strength = F.try_divide(F.col("total"), between) - 1  # null where the keys don't differ
    s = moments.select(F.coalesce(F.least(F.greatest(strength, F.lit(STRENGTH_MIN)), F.lit(STRENGTH_MAX)), F.lit(STRENGTH_MAX)).alias("strength"))
    c = c.crossJoin(F.broadcast(s))  # one row
    a, b = F.col("good") + F.col("strength") * mu, F.col("n") - F.col("good") + F.col("strength") * (1 - mu)
    return c.select(key, *parent_keys, "n", "good", a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


def host_reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """{host, domain, suffix, all}: alpha, beta and mean of each key, from rows (host, good 0/1); null outcomes count not."""
    domain, suffix = domain_columns(F.col("host"))
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    # a row for each host, which four levels read: written once, so that the pages and labels are joined once
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # a flat Beta(1, 1) stands above all
    top = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    top = top.select((F.col("good") + 1.0).alias("alpha"), (F.col("n") - F.col("good") + 1.0).alias("beta"), ((F.col("good") + 1.0) / (F.col("n") + 2.0)).alias("mean"))
    # each level is read by the one below and by the hosts to judge: written once, and small beside the pages
    top = materialize(top, "reputation_all")
    s = materialize(_level(suffixes.crossJoin(F.broadcast(top.select(F.col("mean").alias("up")))), "suffix", F.col("up"), []), "reputation_suffix")
    d = _level(domains.join(s.select("suffix", F.col("mean").alias("up")), "suffix"), "domain", F.col("up"), ["suffix"])
    d = materialize(d, "reputation_domain")
    h = _level(hosts.join(d.select("domain", F.col("mean").alias("up")), "domain"), "host", F.col("up"), ["domain", "suffix"])
    return {"host": materialize(h, "reputation_host"), "domain": d, "suffix": s, "all": top}


def posterior_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Lower bound of the good rate: posterior mean less z posterior deviations, not below 0."""
    n = alpha + beta
    return F.greatest(F.lit(0.0), alpha / n - z * F.sqrt(alpha * beta / (n * n * (n + 1))))


def judge_urls(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", rules=RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` with host, path, rule, bound and verdict.

    ``outcomes``: (host, good). A page takes the posterior of its host or, without labelled pages there, the prior of
    its domain, suffix or of all hosts, in this order; ``allow`` if the lower bound reaches ``threshold``. A rule that
    fits overrides this. Null urls and urls without :// have an empty host and path and the prior of all. Repeated rows
    keep their count; an empty table gives an empty one; with no outcomes all hosts have Beta(1, 1), so the bound blocks.
    A column of pages named host, path, rule, bound or verdict is replaced; other columns stay.
    """
    rep = host_reputation(outcomes)
    alone = lambda key: rep[key].select(F.col(key).alias(f"_{key}"), F.col("alpha").alias(f"_a_{key}"), F.col("beta").alias(f"_b_{key}"))
    p = split_url(pages.drop(*[c for c in ("rule", "bound", "verdict") if c != url_col]), url_col)
    domain, suffix = domain_columns(F.col("host"))
    # the priors of a host's domain and suffix join the distinct hosts, not the pages
    known = p.groupBy("host").agg(F.count("*").alias("_rows")).withColumns({"_domain": domain, "_suffix": suffix})
    known = known.join(alone("host"), F.col("host") == F.col("_host"), "left").join(alone("domain"), "_domain", "left").join(alone("suffix"), "_suffix", "left")
    known = known.crossJoin(F.broadcast(rep["all"].select(F.col("alpha").alias("_a_all"), F.col("beta").alias("_b_all"))))
    order = ("host", "domain", "suffix", "all")
    alpha, beta = (F.coalesce(*(F.col(f"_{x}_{k}") for k in order)) for x in "ab")
    known = materialize(known.select("host", posterior_bound(alpha, beta, z).alias("bound"), "_rows"), "hosts")
    rule, said = rule_columns(rules)
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return hot_lookup(p, known, "host", "_rows", "left").withColumns({"rule": rule, "verdict": F.coalesce(said, own)})


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good): the number in a page's url is the document that it shows; a document is good if its quality is 1
    and it isn't toxic. Unlabelled pages and pages without a number are left out, several labels of a document count as one,
    the worst; a page counts as often as it stands; null ids, urls and qualities match nothing; empty tables give no rows."""
    p = split_url(pages.select("url"))
    number = F.regexp_extract("path", r"/(\d{1,18})(?:\D|$)", 1)
    p = p.select("host", F.when(number != "", number.cast("bigint")).alias("doc_id")).filter("doc_id is not null")
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(good).alias("good"))
    return p.join(marks, "doc_id").select("host", "good")
