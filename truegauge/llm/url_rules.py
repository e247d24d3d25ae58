"""URL filters by explicit rules and by mined token combinations.

Explicit rules (host and path prefix, longest wins) decide first. For the other urls,
Spark's FP-growth mines combinations of url tokens that go with a verdict in labelled urls;
rules with enough support and confidence are kept, and of those a rule is dropped if a
part of its tokens already gives the verdict as surely. The kept rules match by an inverted
index: each is filed under its rarest token, and a url asks for the rules of its tokens. Tokens that come
with the very same labelled urls are mined as one and stand for one another.

Null urls and urls without ``://`` have no host, path or tokens and get the default verdict.
Verdicts depend on the url alone, so repeated rows agree. Labels must be ``allow`` or
``block``. Extra columns stay with the caller's rows, but those named host, path, rule,
verdict or mined_rule are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import ascii_lower, spare, written

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
#: Labelled rows that a rule needs, however few there are.
LEAST_ROWS = 3
DEFAULT = "allow"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The contract's rules.
RULES = (UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"),
         UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"),
         UrlRule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Name of the longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, rule.name).otherwise(out)
    return out


def explicit_verdict(rule: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, r.verdict).otherwise(out)
    return out


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: domain suffixes, host labels but the last, path segments (numbers as #)."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(
        F.lit("d:"), F.array_join(F.slice(labels, -F.least(i, F.size(labels)), F.size(labels)), ".")))
    parts = F.filter(F.split(ascii_lower(path), "/"), lambda x: x != "")
    shaped = F.transform(parts, lambda x: F.concat(F.lit("p:"), F.when(
        x.rlike(r"^[0-9]+$"), "#").otherwise(x)))
    return F.array_distinct(F.concat(
        F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))),
                    lambda x: F.concat(F.lit("h:"), x)), shaped))


def classes(rows: DataFrame, least: int) -> DataFrame:
    """(token, item, n): tokens of at least ``least`` rows; those of the very same rows share one item, the smallest.

    ``rows`` has rid and tokens. Rows are the same if their number and the sum of two hashes of them are.
    """
    total = lambda seed: F.sum(F.xxhash64("rid", F.lit(seed)).cast("decimal(38,0)"))
    tokens = rows.select("rid", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).where(F.col("n") >= least)
    firsts = tokens.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return tokens.join(firsts, ["n", "a", "b"]).select("token", "item", "n")


def mine(labelled: DataFrame, tokens: str, label: str, *options, **more) -> DataFrame:
    """The rules of ``mined`` alone."""
    return mined(labelled, tokens, label, *options, **more)[0]


def mined(labelled: DataFrame, tokens: str, label: str, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE, partitions: int | None = None, least_rows: int = LEAST_ROWS
          ) -> tuple[DataFrame, DataFrame]:
    """Returns (rules, classes): rule_id, items, verdict, support, confidence, anchor of the mined rules; and
    which token stands for which item.

    Tokens that always come together are one item, so that a long path is no power set of itself, and a
    rule needs ``least_rows`` labelled rows at least. A rule's number of items has no limit; their number follows
    from the least support, not from the number of urls.
    """
    spark = labelled.sparkSession
    rows = written(labelled.where(F.col(label).isNotNull() & (F.size(tokens) > 0)).select(
        F.monotonically_increasing_id().alias("rid"), F.col(tokens).alias("tokens"), F.col(label).alias("label")), "labelled")
    n = rows.count()
    least = max(least_rows, ceil(min_support * n))
    known = written(classes(rows, least), "classes")
    items = rows.select("rid", F.explode("tokens").alias("token")).join(known, "token").select(
        "rid", "item").distinct().groupBy("rid").agg(F.collect_list("item").alias("items"))
    marked = items.join(rows.select("rid", "label"), "rid").select(
        F.concat("items", F.array(F.concat(F.lit("verdict="), F.col("label")))).alias("items"))
    # The share of the rows that are left, a little less than least, so that rounding drops no set.
    share = (least - 0.5) / max(items.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=min(share, 1.0), minConfidence=1.0,
                     numPartitions=partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(marked)
    sets = written(model.freqItemsets, "itemsets")
    is_verdict = lambda x: F.startswith(x, F.lit("verdict="))
    whole = sets.where(F.exists("items", is_verdict) & (F.size("items") > 1)).select(
        F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("items"),
        F.substring(F.filter("items", is_verdict)[0], 9, 100).alias("verdict"),
        F.col("freq").alias("both"))
    parts = sets.where(~F.exists("items", is_verdict)).select(
        F.array_sort("items").alias("items"), F.col("freq").alias("alone"))
    sure = whole.join(parts, "items").withColumn("confidence", F.col("both") / F.col("alone")).where(
        F.col("confidence") >= min_confidence)
    counts = parts.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("alone").alias("n"))
    listed = sure.withColumn("rule_id", F.array_join("items", " ")).withColumn("item", F.explode("items")).join(
        counts, "item")
    filed = written(listed.groupBy("rule_id", "verdict").agg(
        F.array_sort(F.collect_list("item")).alias("items"), F.first("both").alias("support"),
        F.first("confidence").alias("confidence"), F.min(F.struct("n", "item"))["item"].alias("anchor")), "rules")
    # A shorter rule is part of a longer one only if its anchor is among the longer one's tokens.
    longer = filed.select("rule_id", "verdict", "items", "confidence", F.explode("items").alias("anchor"))
    shorter = filed.select(F.col("anchor"), F.col("verdict"), F.col("items").alias("less"),
                           F.col("confidence").alias("sure"))
    needless = longer.join(shorter, ["anchor", "verdict"]).where(
        (F.size("less") < F.size("items")) & (F.size(F.array_except("less", "items")) == 0)
        & (F.col("sure") >= F.col("confidence"))).select("rule_id", "verdict").distinct()
    return filed.join(needless, ["rule_id", "verdict"], "left_anti"), known


def matched(urls: DataFrame, url: str, tokens: str, rules: DataFrame, known: DataFrame) -> DataFrame:
    """(url, verdict, mined_rule) per distinct url: the surest fitting rule, block before allow.

    A rule fits if every item of it has one of its tokens in the url.
    """
    asked = urls.select(F.col(url).alias("u"), F.explode(tokens).alias("token")).join(
        known, "token").groupBy("u").agg(F.collect_set("item").alias("t")).withColumn("anchor", F.explode("t"))
    hits = asked.join(rules, "anchor").where(F.size(F.array_except("items", "t")) == 0)
    order = F.struct(-F.col("confidence"), F.when(F.col("verdict") == "block", 0).otherwise(1),
                     -F.col("support"), F.col("rule_id"), F.col("verdict"))
    best = hits.groupBy("u").agg(F.min(F.struct(order.alias("o"), F.col("verdict"), F.col("rule_id")))
                                 .alias("best"))
    return best.select(F.col("u").alias(url), F.col("best.verdict").alias("verdict"),
                       F.col("best.rule_id").alias("mined_rule"))


def judged(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES,
           labelled: DataFrame | None = None, min_support: float = MIN_SUPPORT,
           min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule, verdict and mined_rule.

    ``labelled`` has columns url and label; without it, the urls that explicit rules decide
    are the labelled ones, each distinct url once.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.drop("host", "path", "rule", "verdict", "mined_rule").withColumns({"host": host, "path": path})
    parsed = parsed.withColumn("rule", explicit_rule(F.col("host"), F.col("path"), rules))
    explicit, key, found = (spare(parsed, c) for c in ("explicit", "url_key", "found"))
    parsed = parsed.withColumn(explicit, explicit_verdict(F.col("rule"), rules))
    distinct = written(parsed.where(F.col(url).isNotNull()).select(
        F.col(url).alias("url"), tokens_of(F.col("host"), F.col("path")).alias("tokens"),
        F.col(explicit).alias("explicit"))
        .dropDuplicates(["url"]), "urls")
    if labelled is None:
        teach = distinct.select("tokens", F.col("explicit").alias("label"))
    else:
        teach = labelled.select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "label")
    filters, known = mined(teach, "tokens", "label", min_support, min_confidence)
    verdicts = matched(distinct.where("explicit is null"), "url", "tokens", filters, known).select(
        F.col("url").alias(key), F.col("verdict").alias(found), "mined_rule")
    out = parsed.join(verdicts, parsed[url] == verdicts[key], "left")
    return out.withColumn("verdict", F.coalesce(explicit, found, F.lit(default))).drop(explicit, key, found)
