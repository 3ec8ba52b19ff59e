"""URL filter: rules first, then the empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, in lower case; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column, n: int, suffixes: tuple[str, ...]) -> Column:
    """The last n labels of a host, one more if its suffix has two; the whole host if it is a bare address of numbers."""
    last = F.substring_index(host, ".", -n)
    if suffixes:
        last = F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -n - 1)).otherwise(last)
    return F.when(host.rlike("^[0-9.]+$"), host).otherwise(last)


def domain_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The registered domain: the suffix and the label before it. suffixes: those of two labels, such as co.uk."""
    return _labels(host, 2, suffixes)


def suffix_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    return _labels(host, 1, suffixes)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule is a host with a path: it fits the host and
    its subdomains where the path starts with the rule's. The rules become one expression, so they should be few."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, rest = r.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, rules[r]).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, own: str, parent_mean: str) -> float:
    """How many outcomes a parent's mean is worth to a child: from how far the children's rates lie from it (method of
    moments for the beta-binomial), between 2 and 999."""
    gone = F.col(parent_mean) * (1 - F.col(parent_mean))
    r = children.filter(F.col(f"{own}_n") > 0).agg(
        F.sum(F.col(f"{own}_n") * (F.col(f"{own}_bad") / F.col(f"{own}_n") - F.col(parent_mean)) ** 2).alias("s"),
        F.sum(gone).alias("v"),
        F.sum(gone * (F.col(f"{own}_n") - 1)).alias("w"),
    ).first()
    rho = (r["s"] - r["v"]) / r["w"] if r["w"] else 0.001
    return 1 / min(1 / 3, max(0.001, rho)) - 1


def _shrunk(own: str, parent_mean: str, strength: float) -> Column:
    return (F.col(f"{own}_bad") + strength * F.col(parent_mean)) / (F.col(f"{own}_n") + strength)


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """For every host of pages (page_id, host): host, mean and bound, the posterior mean of its share of bad pages and
    the lower bound of it, z standard deviations below.

    outcomes: page_id and bad (0 or 1), for some pages; other values and null ids do not count, and of several
    outcomes of a page the worst counts. A suffix's rate is shrunk towards that of all pages, a registered domain's
    towards its suffix's, and a host's towards its domain's; each parent's mean is a beta prior whose strength is
    fitted to how its level's rates differ. A host without outcomes has its domain's mean. Without any outcome the
    bound is 0.

    Counts are added up before they are shuffled by host. Tables of hosts and domains are written to the checkpoint
    folder, so that Spark sees their sizes, and splits a parent that many children share.
    """
    known = outcomes.filter("page_id is not null and bad in (0, 1)").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("h_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("h_bad"))
    hosts = cut(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("h_n").alias("d_n"), F.sum("h_bad").alias("d_bad")))
    tops = cut(domains.groupBy("suffix").agg(F.sum("d_n").alias("s_n"), F.sum("d_bad").alias("s_bad")))
    total = tops.agg(F.sum("s_n").alias("n"), F.sum("s_bad").alias("bad")).first()
    if not total["n"]:
        return hosts.select("host", F.lit(0.0).alias("mean"), F.lit(0.0).alias("bound"))
    tops = tops.withColumn("all_mean", F.lit(total["bad"] / total["n"]))
    tops = tops.select("suffix", _shrunk("s", "all_mean", _strength(tops, "s", "all_mean")).alias("s_mean"))
    domains = cut(domains.join(tops, "suffix"))
    domains = domains.select("domain", _shrunk("d", "s_mean", _strength(domains, "d", "s_mean")).alias("d_mean"))
    hosts = cut(hosts.join(domains, "domain"))
    m = _strength(hosts, "h", "d_mean")
    a, n = F.col("h_bad") + m * F.col("d_mean"), F.col("h_n") + m
    mean = a / n
    return hosts.select("host", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (n + 1))).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], most_bad: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = (), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bound for each row of pages: the longest fitting rule's verdict; else block
    if the lower bound of the host's share of bad pages is over most_bad, else allow.

    A null url, or one without ://, has an empty host, which is judged like any other. A null page_id has no outcome.
    Repeated rows are repeated; other columns are left out; an empty table gives an empty one.
    """
    u = F.col(url).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    found = cut(reputation(rows.select("page_id", "host"), outcomes, z, suffixes))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    return rows.join(found, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("bound") > most_bad, "block").otherwise("allow")).alias("verdict"), "bound")
