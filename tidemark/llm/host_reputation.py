"""URL filtering by rules and by the reputation of hosts, shrunk by empirical Bayes.

Labelled pages are bad or not. A host's rate of bad pages has a beta prior around the rate of its registered domain, that
one around the rate of its suffix, and that one around the rate of all. How firmly each level holds to the one above is
estimated from the outcomes themselves: by the share of their variance that lies between groups (nested analysis of
variance, the moment estimator of the beta-binomial). A host is blocked if the lower bound of its posterior rate is too
high, so that few bad pages on a small host are not enough. Rules for hosts and paths come before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, lookup, scratch, written

#: A host is blocked where its rate of bad pages is above LIMIT, with Z standard deviations of the posterior to spare.
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's weight in pages, and the weight where the outcomes say nothing about it.
LEAST_WEIGHT, MOST_WEIGHT, PLAIN_WEIGHT = 1.0, 1000.0, 10.0
#: Bytes of the table of hosts up to which it may be broadcast.
BROADCAST_BYTES = 16 << 20

#: Labels that make a suffix together with a country's.
SECOND_LEVEL = "ac co com edu gov net org".split()

#: The rules of the contract as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user, port and last point."""
    return F.regexp_replace(F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", ""), r"\.$", "")


def suffix_of(host: Column) -> Column:
    """The last label, or two where the last is a country's and the one before it is no name."""
    name = name_of(host)
    labels = F.split(name, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = (F.length(last) == 2) & second.isin(SECOND_LEVEL)
    return F.when(last.rlike("^[0-9]*$"), name).when(two, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and a label more. Numeric addresses and bare suffixes are their own."""
    name, suffix = name_of(host), suffix_of(host)
    more = F.regexp_extract(F.left(name, F.length(name) - F.length(suffix) - 1), r"([^.]*)$", 1)
    return F.when(F.length(name) <= F.length(suffix), name).otherwise(F.concat_ws(".", more, suffix))


def weight(between: Column, within: Column, all_rows: Column, squares: Column, groups: Column, parents: Column) -> Column:
    """The weight in pages of a prior: how many pages of the level above a group's own rate is worth.

    `between` and `within` are the sums of squares of the groups' rates around their parents' and of the outcomes around
    the groups'; `squares` sums each group's rows squared over its parent's rows.
    """
    spread, noise = between / (groups - parents), within / (all_rows - groups)
    each = (all_rows - squares) / (groups - parents)
    shared = (spread - noise) / (spread + (each - 1) * noise)  # the share of variance that groups explain
    known = F.when(shared > 0, F.least(F.greatest(1 / shared - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))).otherwise(F.lit(MOST_WEIGHT))
    usable = (groups > parents) & (all_rows > groups) & (spread + (each - 1) * noise > 0)
    return F.when(usable, known).otherwise(F.lit(PLAIN_WEIGHT))


def weights(hosts: DataFrame) -> DataFrame:
    """One row: rows, bad, and the prior weights by_host, by_domain, by_suffix, from hosts (host, domain, suffix, n, bad)."""
    seen = hosts.where("n > 0")
    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("kk"), F.count("*").alias("hosts"))
    suffixes = domains.groupBy("suffix").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("kk"), F.count("*").alias("domains"),
        F.sum(F.col("nn") / F.col("n")).alias("host_nn"), F.sum("kk").alias("host_kk"), F.sum("hosts").alias("hosts"),
    )
    total = suffixes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("kk"), F.count("*").alias("suffixes"),
        F.sum(F.col("nn") / F.col("n")).alias("domain_nn"), F.sum("kk").alias("domain_kk"), F.sum("domains").alias("domains"),
        F.sum("host_nn").alias("host_nn"), F.sum("host_kk").alias("host_kk"), F.sum("hosts").alias("hosts"),
    )
    n, bad = F.col("n"), F.col("bad")
    return total.select(
        n.alias("rows"),
        bad.alias("all_bad"),
        F.when(n > 0, weight(F.col("host_kk") - F.col("domain_kk"), bad - F.col("host_kk"), n, F.col("host_nn"), F.col("hosts"), F.col("domains"))).otherwise(PLAIN_WEIGHT).alias("by_host"),
        F.when(n > 0, weight(F.col("domain_kk") - F.col("kk"), bad - F.col("domain_kk"), n, F.col("domain_nn"), F.col("domains"), F.col("suffixes"))).otherwise(PLAIN_WEIGHT).alias("by_domain"),
        F.when(n > 0, weight(F.col("kk") - bad * bad / n, bad - F.col("kk"), n, F.col("nn") / n, F.col("suffixes"), F.lit(1))).otherwise(PLAIN_WEIGHT).alias("by_suffix"),
    )


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, bad) with the posterior of each: bad_rate (its mean) and bad_bound (its lower bound).

    Without any outcome every rate is a half. The tables of domains and suffixes are joined by broadcast or salted keys.
    """
    hosts = written(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    w = weights(hosts).first()
    overall = (w["all_bad"] + 1) / (w["rows"] + 2)
    rate = lambda prior, by: (F.col("bad") + F.lit(by) * prior) / (F.col("n") + F.lit(by))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = written(suffixes.select("suffix", rate(F.lit(overall), w["by_suffix"]).alias("above")), "suffixes")
    domains = written(lookup(domains, suffixes, "suffix", F.col("domain")).select("domain", rate(F.col("above"), w["by_domain"]).alias("above")), "domains")
    a, b = F.col("bad") + F.lit(w["by_host"]) * F.col("above"), F.col("n") - F.col("bad") + F.lit(w["by_host"]) * (1 - F.col("above"))
    out = lookup(hosts, domains, "domain", F.col("host")).select("host", "n", "bad", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    return out.select("host", "n", "bad", mean.alias("bad_rate"), (mean - Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))).alias("bad_bound"))


def rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host) that rules fit, with `rules`: (length, host_length, verdict, rule, path) of each rule for it or a parent.

    A host's rules travel in one row, as many as the list has for it and its parents."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    listed = rules.select(
        F.translate("host", UPPER, LOWER).alias("parent"),
        F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), "verdict", F.concat("host", "path").alias("rule"), "path").alias("one"),
    )
    held = lookup(hosts.select("host", F.explode(parents).alias("parent")), listed, "parent", F.col("host"))
    return held.groupBy("host").agg(F.collect_set("one").alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Every row of pages (page_id, url, ...) with host, path, rule (null where none fits), verdict, and its host's outcomes.

    outcomes (page_id, bad) says which pages were bad; several for a page count each, for every row with its id; null ids
    and null outcomes count nowhere. rules (host, path, verdict) fit their host and its subdomains where the url's path
    begins with theirs; the longest wins, of equal ones that of the longer host, then block. A url without `://`, or none,
    has an empty host and path, and its rows share the reputation of that empty host. labelled, bad, bad_rate and bad_bound
    are the host's; rows alike give rows alike; an empty table of pages gives an empty result, other empty ones change
    nothing but what they would say; other columns are ignored.
    """
    spark = pages.sparkSession
    with scratch(spark):
        url = F.col("url").cast("string")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
        known = outcomes.where("page_id is not null and bad is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad"))
        sums = known.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        hosts = rows.join(sums, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        judged = written(reputations(hosts), "reputations")
        ruled = rules_of(judged.select("host"), rules.where("host is not null and path is not null"))
        table = written(judged.join(ruled, "host", "left"), "judged-hosts")
        size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("host") + 100 + F.coalesce(F.aggregate("rules", F.lit(0).cast("long"), lambda s, r: s + 60 + 2 * r["length"]), F.lit(0))), F.lit(0)).alias("bytes")).first()
        fits = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
        joined = lookup(rows, table, "host", F.coalesce("page_id", F.lit(0)), fits=fits)
        best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["path"])))
        verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
        out = joined.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("labelled"), "bad", "bad_rate", "bad_bound")
        return written(out, "url-verdicts", keep=True)


def kept(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The verdicts of the pages that stay."""
    return judge(pages, outcomes, rules, limit).where("verdict = 'allow'")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes from labels (doc_id, quality, toxic): a page is bad if it is of low quality or toxic; its id is its label's."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.where("quality is not null or toxic is not null").select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad"))
