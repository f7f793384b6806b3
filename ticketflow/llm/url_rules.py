"""URL filtering by association rules over URL tokens, and by rules given for hosts and paths.

Tokens of host and path of labelled pages are the items of Spark's FP-growth, with the label
as one more item; rules from up to two tokens to the label that pass support, confidence and
lift are kept, less those that a shorter rule makes needless. Rules meet urls through an
inverted index from the rarest token of each rule. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: (action, host suffix, path prefix)
GIVEN = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

BAD = "\u0001bad"
#: Rules up to which their index is broadcast; more meet the urls by a join.
RULES = 2_000
#: A rule's urls, at least, however small the support makes it.
LEAST_URLS = 8
#: Tokens of this share of the labelled urls or more are no items.
UBIQUITOUS = 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; without ://, or null, empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; without ://, or null, empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct runs of letters and digits of host and path, marked by where they stand; numbers by length."""
    split = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    plain = lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t)
    hosts = F.transform(split(host), lambda t: F.concat(F.lit("h:"), plain(t)))
    paths = F.transform(split(path), lambda t: F.concat(F.lit("p:"), plain(t)))
    return F.array_distinct(F.concat(hosts, paths))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(items) of the pages with a label: their tokens, and BAD where the label is bad.

    A page is bad if any label calls its id of low quality or toxic; one without says nothing.
    """
    told = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("told"))
    known = pages.join(told.where("told is not null"), "page_id")
    return known.select(F.when(F.col("told") == 1, F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))


def mine(transactions: DataFrame, support: float = 0.002, confidence: float = 0.7, lift: float = 1.5) -> DataFrame:
    """(tokens, confidence, support) of the rules tokens => bad, of one or two tokens.

    A pair is dropped if one of its tokens alone is a rule.
    """
    spark = transactions.sparkSession
    n = transactions.count()
    if not n:
        return spark.sql("select array('') as tokens, 1d as confidence, 1d as support where false")
    # tokens of most urls tell nothing, and would double the itemsets that are counted
    often = transactions.select(F.explode("items").alias("t")).where(F.col("t") != BAD).groupBy("t").agg((F.count("*") / n).alias("share"))
    plain = [r["t"] for r in often.where(F.col("share") >= UBIQUITOUS).collect()]
    if plain:
        transactions = transactions.select(F.array_except("items", F.array(*map(F.lit, plain))).alias("items"))
    transactions = transactions.where(F.size("items") > 0)
    told = max(1, transactions.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support * n, LEAST_URLS) / told), minConfidence=confidence).fit(transactions)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).where(F.size("antecedent") <= 2).where(F.col("lift") >= lift)
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * told / n).alias("support")), drop=False)
    single = rules.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("t"))
    one, two = single.select(F.col("t").alias("t0")), single.select(F.col("t").alias("t1"))
    pairs = rules.where(F.size("tokens") == 2)
    pairs = pairs.join(one, F.col("tokens")[0] == F.col("t0"), "left_anti").join(two, F.col("tokens")[1] == F.col("t1"), "left_anti")
    return rules.where(F.size("tokens") == 1).union(pairs)


def given_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest given rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's path; longer
    host and path together win, and of equal ones the first in order.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, suffix, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = (host == suffix) | host.endswith("." + suffix)
        fits &= path.startswith(prefix)
        rule = F.when(fits, F.lit(suffix + prefix)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def judged(pages: DataFrame, labels: DataFrame, rules: Iterable[tuple[str, str, str]] = GIVEN, support: float = 0.002, confidence: float = 0.7) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched) of every row of pages.

    verdict is the action of the longest given rule that fits, else block if a mined rule's
    tokens all stand in the url, else allow; matched is the most confident mined rule, or
    null. Null or malformed urls have empty host and path, fit no rule and are allowed. Rows
    that repeat a page_id are judged each, and so are rows with a null one. Other columns
    are not read.
    """
    spark: SparkSession = pages.sparkSession
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    mined = cut(mine(labelled(pages, labels), support, confidence))
    index = mined.select(F.col("tokens")[0].alias("t"), F.struct((-F.col("confidence")).alias("c"), F.col("tokens").alias("need")).alias("e"))
    holds = lambda e: F.size(F.array_except(e["need"], F.col("tokens"))) == 0
    if index.limit(RULES + 1).count() <= RULES:
        # the index fits a broadcast, so urls are not exploded to a shuffle
        found = index.groupBy("t").agg(F.sort_array(F.collect_list("e")).alias("found"))
        lookup = found.agg(F.map_from_entries(F.collect_list(F.struct("t", "found"))).alias("posting"))
        entries = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(F.col("posting"), t), F.array().cast("array<struct<c:double,need:array<string>>>"))))
        hit = pages.crossJoin(F.broadcast(lookup)).withColumn("best", F.array_min(F.filter(entries, holds)))
    else:
        # what a url matches is a matter of its tokens, so equal lists are judged once
        asked = pages.select("tokens").distinct()
        met = asked.select("tokens", F.explode("tokens").alias("t")).join(index, "t").where(holds(F.col("e")))
        best = met.groupBy("tokens").agg(F.min("e").alias("best"))
        hit = pages.join(best, "tokens", "left")
    rule, action = given_rule(F.col("host"), F.col("path"), rules)
    return hit.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.array_join(F.col("best.need"), " ").alias("matched"))
