"""URL filter by Empirical-Bayes host reputation.

Labelled page outcomes (1 bad, 0 good) are counted per host. Each level's bad rate is shrunk to its parent by a
beta-binomial prior: host -> registered domain -> suffix -> all pages. The strength of a level's prior is fitted from the
counts of that level by the method of moments, so a host with few labelled pages leans on its domain and one with many
stands on its own. A page is blocked if the lower bound of its host's posterior bad rate exceeds ``lift`` times the rate of
all labelled pages: what counts as bad differs between labels, and a fixed rate would block all or nothing where bad pages
are the rule or rare. With the default of 1.25 a host is blocked if it is, with a probability of 95 %, worse than the average
page by a quarter; where hosts don't differ, the fitted priors hold all of them at the average and none is. Hosts without
labelled pages take their domain's posterior, then the suffix's, then that of all pages. Explicit rules come first.

Defined cases: null urls and urls without ``://`` have empty host and path and are judged by the rate of all pages;
repeated rows stay; labelled outcomes that are null don't count; no labelled pages at all: nothing is blocked but by rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered, by default; others are the last label. Fixed values.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")
#: So many rules at most become one literal expression; more are joined as a table.
LITERAL_RULES = 200


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*two_label), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that decides a page, and its verdict; the longest that fits wins, of equals the first by text."""
    rule = verdict = F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def joined_rules(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` (host, path, …) with rule and verdict, for rules too many for an expression.

    Each distinct host is joined by itself and each domain above it to the rules of that name; of those, kept with the
    host, the longest whose path fits is chosen page by page.
    """
    spark = rows.sparkSession
    own = [(text.partition("/")[0], "".join(text.partition("/")[1:]), text, say) for say, text in rules]
    table = spark.createDataFrame(own, "name string, start string, rule string, verdict string")
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct().withColumn("name", F.explode(above))
    by_length = F.struct((-F.length("rule")).alias("length"), "rule", "start", "verdict")
    found = hosts.join(table, "name").groupBy("host").agg(F.sort_array(F.collect_set(by_length)).alias("rules"))
    fits = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    return rows.join(durable(found, "host-rules"), "host", "left").withColumn("fits", fits).withColumns({"rule": F.col("fits.rule"), "verdict": F.col("fits.verdict")}).drop("rules", "fits")


def _strength(level: DataFrame, least: float = 1.0, most: float = 1e4) -> float:
    """A level's prior strength by the method of moments, from its rows (n, bad, prior).

    E[(bad - n m)^2 / n] = m (1 - m) (1 + (n - 1) rho) with m the prior mean and rho = 1 / (1 + strength).
    """
    n, m, bad = F.col("n"), F.col("prior"), F.col("bad")
    dev, var, over = level.agg(F.sum((bad - n * m) * (bad - n * m) / n), F.sum(m * (1 - m)), F.sum((n - 1) * m * (1 - m))).first()
    if not over or dev <= var:
        return most
    return min(most, max(least, over / (dev - var) - 1))


def _posterior(level: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of each row (n, bad, prior) of a level."""
    k = _strength(level)
    return level.select(*keys, (k * F.col("prior") + F.col("bad")).alias("a"), (k * (1 - F.col("prior")) + F.col("n") - F.col("bad")).alias("b"))


def _mean(level: DataFrame, key: str) -> DataFrame:
    return level.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))


def reputation(outcomes: DataFrame, url: str = "url", bad: str = "bad", two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[dict[str, DataFrame], tuple[float, float]]:
    """Posteriors (a, b) per host, domain and suffix, and those of all pages.

    ``outcomes``: labelled pages. Counts are pre-aggregated per host and kept, so one host with a third of all pages costs
    no more than any other, and the fits read a table of hosts only.
    """
    seen = outcomes.where(F.col(bad).isNotNull()).select(host_of(url).alias("host"), F.col(bad).cast("double").alias("bad"))
    hosts = seen.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").alias("bad"))
    hosts = durable(hosts.withColumns({"domain": domain_of(F.col("host"), two_label), "suffix": suffix_of(F.col("host"), two_label)}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, x = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    a, b = x + 0.5, n - x + 0.5
    by_suffix = _posterior(suffixes.withColumn("prior", F.lit(a / (a + b))), ["suffix"])
    by_domain = _posterior(domains.join(_mean(by_suffix, "suffix"), "suffix"), ["domain"])
    by_host = _posterior(hosts.join(_mean(by_domain, "domain"), "domain"), ["host"])
    return {"host": by_host, "domain": by_domain, "suffix": by_suffix}, (a, b)


def bound(a: Column, b: Column, z: float) -> Column:
    """Lower bound of a beta posterior: mean less ``z`` standard deviations, 0 at least."""
    mean = a / (a + b)
    return F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), *, key: str = "page_id", url: str = "url", bad: str = "bad", lift: float = 1.25, z: float = 1.645,
    two_label: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, posterior (bad_a, bad_b), its bound, and the limit of that.

    Only the key and the url are read of ``pages``. Posteriors are kept per host that occurs, and joined by host; Spark
    broadcasts them only while they are small, else it sorts, and splits the hot host.
    """
    host, path = F.col("host"), F.col("path")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host_of("url").alias("host"), path_of("url").alias("path"))
    levels, (all_a, all_b) = reputation(outcomes, url, bad, two_label)
    known = rows.groupBy("host").agg(F.count("*").alias("pages")).select("host", domain_of(host, two_label).alias("domain"), suffix_of(host, two_label).alias("suffix"))
    for level, table in levels.items():
        known = known.join(table.select(level, F.col("a").alias(f"{level}_a"), F.col("b").alias(f"{level}_b")), level, "left")
    pick = lambda x, last: F.coalesce(*[F.col(f"{level}_{x}") for level in levels], F.lit(last))
    known = known.select("host", pick("a", all_a).alias("bad_a"), pick("b", all_b).alias("bad_b")).withColumn("bad_bound", bound(F.col("bad_a"), F.col("bad_b"), z))
    known = durable(known, "host-reputation")
    limit = F.lit(lift * all_a / (all_a + all_b))
    if len(rules) > LITERAL_RULES:
        rows = joined_rules(rows, rules)
    else:
        rule, verdict = matched_rule(host, path, rules)
        rows = rows.withColumns({"rule": rule, "verdict": verdict})
    said = F.coalesce("verdict", F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    out = rows.join(known, "host", "left").select("key", "host", "path", "rule", said.alias("verdict"), "bad_a", "bad_b", "bad_bound", limit.alias("bad_limit"))
    return out.withColumnRenamed("key", key)
