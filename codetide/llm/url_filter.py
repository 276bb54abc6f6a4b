"""URL filter: host reputation by empirical Bayes, overruled by explicit rules.

Labelled page outcomes (1 bad, 0 good) are counted per host, registered domain and suffix. Each level's
rate has a beta prior around its parent's posterior mean; the prior's strength is found for the level by
the method of moments over its members. A host is blocked if the lower bound of its posterior, mean less
`z` standard deviations, exceeds `limit`.

Only counts per host are shuffled after map-side sums. Pages meet their host's verdict in a join by host and a
salt: a host with more than one of `PARTS` equal parts of all pages has as many salts as it has such parts, all
others have one. Hosts with several salts are fewer than `PARTS`, so their hashes are broadcast, and the copies of
hosts are fewer than twice `PARTS`. Rules are joined to the suffixes of distinct hosts.

Url without `://`, or null: host and path are empty, no rule fits, reputation is the overall rate.
A rule `host/path` fits its host and all subdomains if the url's path starts with its path; the longest
wins, of equally long ones the smaller text. Repeated labels of one page count once, the worse one;
null ids and null outcomes do not count. Repeated pages are judged alike, each row kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetide.llm.text import ascii_lower
from codetide.session import Stages

Z, LIMIT, MOST_STRENGTH, PARTS = 1.645, 0.5, 1000.0, 4096
# Public suffixes of two labels that the registered domain has to respect.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


def url_parts(pages: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    after = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, length(substring_index(`{url}`, '://', 1)) + 4)")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return pages.select(F.col(page).alias("page_id"), after.alias("a")).select(
        "page_id", ascii_lower(F.regexp_extract("a", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("a", r"^[^/?#]*(/[^?#]*)?", 1).alias("path"))


def levels(hosts: DataFrame) -> DataFrame:
    """host -> domain, suffix."""
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    width = F.when(two.isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return hosts.withColumn("suffix", F.when(width == 2, tail(2)).otherwise(tail(1))) \
        .withColumn("domain", F.when(width == 2, tail(3)).otherwise(tail(2)))


def shrunk(counts: DataFrame, key: str) -> DataFrame:
    """Posterior of each member of a level: key, n, bad, mean, strength.

    `counts` has key, n, bad and prior, the parent's posterior mean. With p = bad/n and prior m, the excess of
    the weighted spread over binomial noise gives the strength k: sum n(p-m)^2 = sum m(1-m)(1+(n-1)/(k+1)).
    """
    spread = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2.0) / F.col("n"))
    noise, slope = F.sum(F.col("prior") * (1 - F.col("prior"))), F.sum(F.col("prior") * (1 - F.col("prior")) * (F.col("n") - 1))
    fit = counts.where("n > 0").agg(spread.alias("s"), noise.alias("b"), slope.alias("c")).first()  # one row
    strength = MOST_STRENGTH
    if fit["s"] is not None and fit["c"] > 0 and fit["s"] > fit["b"]:
        strength = min(max(fit["c"] / (fit["s"] - fit["b"]) - 1.0, 1.0), MOST_STRENGTH)
    return counts.select(
        key, "n", "bad", F.lit(strength).alias("strength"),
        ((F.lit(strength) * F.col("prior") + F.col("bad")) / (F.lit(strength) + F.col("n"))).alias("mean"))


def reputation(parts: DataFrame, outcomes: DataFrame, *, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """host, n, bad, pages, mean, bound, verdict for every host of `parts` (page_id, host); outcomes: page_id, bad."""
    outcome = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    judged = parts.select("page_id", "host").join(outcome, "page_id", "left")
    hosts = Stages(parts.sparkSession).keep(levels(judged.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))), "hosts")
    total = lambda key, *more: hosts.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()  # one row
    overall = ((all_["bad"] or 0) + 1.0) / ((all_["n"] or 0) + 2.0)
    prior = lambda level, key: level.select(key, F.col("mean").alias("prior"))
    by_suffix = shrunk(total("suffix").withColumn("prior", F.lit(overall)), "suffix")
    by_domain = shrunk(total("domain", "suffix").join(prior(by_suffix, "suffix"), "suffix"), "domain")
    by_host = shrunk(hosts.join(prior(by_domain, "domain"), "domain"), "host")
    mean, mass = F.col("mean"), F.col("strength") + F.col("n")
    bound = mean - z * F.sqrt(mean * (1 - mean) / (mass + 1))
    return by_host.join(hosts.select("host", "pages"), "host").select("host", "n", "bad", "pages", "mean", bound.alias("bound")) \
        .withColumn("verdict", F.when(F.col("bound") > limit, "block").otherwise("allow"))


def salts(known: DataFrame, parts: int = PARTS) -> DataFrame:
    """name (hash of the host), salts: how many, of the hosts that need several; fewer than `parts` rows. known: host, pages."""
    total = known.agg(F.sum("pages")).first()[0] or 0  # one row
    named = known.groupBy(F.xxhash64("host").alias("name")).agg(F.sum("pages").alias("pages"))
    return named.where(F.col("pages") * parts > total).select("name", F.ceil(F.col("pages") * parts / F.lit(max(total, 1))).cast("int").alias("salts"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, *, page: str = "page_id", url: str = "url", hot_parts: int = PARTS, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate of every page. rules: host, path, action; outcomes: page_id, bad."""
    parts = url_parts(pages, page, url)
    known = Stages(pages.sparkSession).keep(reputation(parts, outcomes, **options), "known")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("end"), F.col("path").alias("start"), "action").distinct()
    fitting = known.where("host <> ''").select("host", F.explode(ends).alias("end")).join(r, "end").groupBy("host") \
        .agg(F.collect_set(F.struct(F.concat("end", "start").alias("rule"), "start", "action")).alias("rules"))
    per_host = known.select("host", F.col("verdict").alias("reputed"), F.col("mean").alias("bad_rate")).join(fitting, "host", "left")
    fits = F.filter(F.coalesce("rules", F.array().cast("array<struct<rule:string,start:string,action:string>>")),
                    lambda x: F.col("path").startswith(x["start"]))
    best = F.array_sort(fits, lambda a, b: F.when(F.length(a["rule"]) > F.length(b["rule"]), -1)
                        .when(F.length(a["rule"]) < F.length(b["rule"]), 1).when(a["rule"] < b["rule"], -1)
                        .when(a["rule"] > b["rule"], 1).when(a["action"] < b["action"], -1).when(a["action"] > b["action"], 1).otherwise(0))
    hot = F.broadcast(salts(known, hot_parts))
    count = F.coalesce("salts", F.lit(1))
    dealt = lambda rows: rows.withColumn("name", F.xxhash64("host")).join(hot, "name", "left").drop("name")
    spread = dealt(per_host).withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("salts")
    salted = dealt(parts).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), count).cast("int")).drop("salts")
    return salted.join(spread, ["host", "salt"]).withColumn("best", F.get(best, F.lit(0))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", "reputed").alias("verdict"),
        F.round("bad_rate", 6).alias("bad_rate"))
