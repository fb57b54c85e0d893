"""URL filtering: listed rules first, else association rules mined from labelled URLs.

Spark's FP-growth mines token combinations of labelled URLs together with their label; a
combination becomes a blocking rule if enough URLs hold it, its confidence is high, and the
lower Wilson bound of that confidence is above ``least_bound`` (a few unlucky pages make no
rule).  Rules that contain a shorter rule are dropped.  Rules match by an inverted index: each
rule is listed under its rarest token, URLs are exploded to tokens, joined with the index, and
the listed rule's tokens are checked against the URL's.  A URL without a rule is allowed.

Labels: ``labels.quality`` of the document with the page's id; 0 is the class to block.

Defined results: a null URL or one without ``://`` has empty host and path and no tokens, so it
fits no rule and is allowed; no labelled rows mean no mined rules; repeated ids are judged row by
row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host, path) of the registered query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BAD = "label=bad"
#: Labelled URLs to mine; of more, a hash sample of about as many rows is taken.
MAX_LABELLED = 500_000
#: Rules are joined by broadcast up to this number, else by shuffle.
MAX_BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits (text) and its verdict, or nulls; the longest rule wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels and words of the host, path segments by place, query keys, scheme."""
    mark = lambda name, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(name + "="), x))
    labels, query = F.split(host, r"\."), F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    shape = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(i.cast("string"), F.lit(":"), shape(x)))
    tokens = F.concat(
        mark("host", labels),
        mark("word", F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))),
        mark("site", F.array(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), "."))),
        mark("path", segments),
        mark("key", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        mark("scheme", F.array(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]+)://", 1))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))


def mine_rules(
    labelled: DataFrame, least_share: float = 0.001, least_rows: int = 20, confidence: float = 0.6, least_bound: float = 0.5, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """``labelled`` (tokens, bad; row: what tells rows apart in a sample) to rules (items, rule_confidence, rule_support)."""
    spark = labelled.sparkSession
    kind = "items array<string>, rule_confidence double, rule_support bigint"
    labelled = written(labelled.filter(F.size("tokens") > 0))
    n = labelled.count()
    if n > max_labelled:
        # rows, not their contents: rows of equal tokens stay or go one by one
        labelled = labelled.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
        n = labelled.count()
    if not n:
        return spark.createDataFrame([], kind)
    support = max(least_share, min(1.0, least_rows / n))
    items = F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens"))
    found = written(FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(items.alias("items"))).freqItemsets)
    left = found.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("hits"))
    right = found.filter(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("items"), F.col("freq").alias("rows"))
    p, z2 = F.col("hits") / F.col("rows"), 1.96**2
    bound = (p + z2 / (2 * F.col("rows")) - 1.96 * F.sqrt(p * (1 - p) / F.col("rows") + z2 / (4 * F.col("rows") * F.col("rows")))) / (1 + z2 / F.col("rows"))
    rules = written(left.join(right, "items").filter((p >= confidence) & (bound >= least_bound)).select("items", p.alias("rule_confidence"), F.col("hits").alias("rule_support")))
    # a rule that holds a shorter rule decides nothing: join on single tokens, compare sets
    short = rules.select(F.col("items").alias("short"), F.element_at("items", 1).alias("token"))
    longer = rules.select("items", F.explode("items").alias("token")).join(short, "token").filter((F.size("short") < F.size("items")) & (F.size(F.array_except("short", "items")) == 0))
    return rules.join(longer.select("items").distinct(), "items", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (row, tokens) that any of ``rules`` fits: row, rule_items, rule_confidence."""
    tokens = rules.select(F.explode("items").alias("token")).groupBy("token").count()
    index = rules.select("*", F.explode("items").alias("token")).join(tokens, "token")
    index = index.groupBy("items", "rule_confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    index = written(index)
    size = index.count()
    if not size:
        return urls.sparkSession.createDataFrame([], f"row {dict(urls.dtypes)['row']}, rule_items array<string>, rule_confidence double")
    posted = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(index) if size <= MAX_BROADCAST_RULES else index, "token")
    hits = posted.filter(F.size(F.array_except("items", "tokens")) == 0)
    return hits.groupBy("row").agg(F.max(F.struct("rule_confidence", "items")).alias("best")).select("row", F.col("best.items").alias("rule_items"), F.col("best.rule_confidence").alias("rule_confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, mined_confidence for every row of ``pages``.

    Mined rules are matched once per distinct URL.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad")).filter("bad IS NOT NULL")
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = rows.join(bad, "page_id").select(F.struct("page_id", "url").alias("row"), tokens.alias("tokens"), "bad")
    urls = rows.select("url", "host", "path").distinct().select(F.col("url").alias("row"), tokens.alias("tokens"))
    hits = match_rules(urls, mine_rules(labelled)).withColumnRenamed("row", "u")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("rule_items").isNotNull(), "block").otherwise("allow")
    return rows.join(hits, rows["url"] == hits["u"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), F.col("rule_items").alias("mined_rule"), F.col("rule_confidence").alias("mined_confidence")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
