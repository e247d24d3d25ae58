"""Benchmark decontamination: a broadcast hash set of benchmark windows meets text windows.

Words are the matches of ``WORD`` after A-Z are lower-cased. A window is ten consecutive words of
a benchmark item; an item of fewer words, but not none, is one window. Every window of
every whole text is looked up by hash and a hit is verified by its words. Native: SQL
functions and joins only.

* The set is broadcast when its windows and their item ids are at most ``BROADCAST_WINDOWS``
  each (counted first); a larger one is joined by a shuffle on the window's hash, which moves
  a window's own words, never the text, and deals places without a window by row.
* Null and empty texts have no words. Repeated rows each get their own row, repeated or
  null item ids count as they are: a null item id is shown as the empty string.
  An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import ascii_lower, let, spare, written

# Fixed value: the contract's words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_WINDOWS = 2_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(k, words, items): each distinct window of k words and the items that have it."""
    listed = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                          words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    at = listed.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("k"), F.explode(
        F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("i"))
    return at.select("k", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("k"))).alias("words"),
                     "item").groupBy("k", "words").agg(F.collect_set("item").alias("items"))


def _key(array: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(array, at + j) for j in range(k)])


def hits(docs: DataFrame, text: str, items: DataFrame, item: str = "item_id",
         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_words, hits and found_items, a row for a row.

    ``hits`` are the sorted, disjoint runs [start, stop) of words inside any occurrence
    of a window; ``found_items`` the sorted ids of the items whose windows occur.
    """
    windows = written(benchmark_windows(items, item, item_text, window), "windows")
    counted = windows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("items")).alias("ids"))
    sizes = {r["k"]: (r["n"], r["ids"]) for r in counted.collect()}  # ``window`` rows at most
    others = [c for c in docs.columns if c != text]
    worded = docs.select(
        F.struct(*[F.col(c) for c in others]).alias("row") if others else F.lit(None).alias("row"),
        F.monotonically_increasing_id().alias("rid"), words_of(F.col(text)).alias("w"))
    placed = worded.select("row", "rid", F.size("w").alias("n_words"), "w",
                           F.posexplode_outer("w").alias("at", "word"))
    lengths = sorted(sizes) or [window]

    def candidate(k: int) -> Column:
        return F.when(F.col("at") + k <= F.col("n_words"), _key(F.col("w"), F.col("at"), k))

    if len(lengths) == 1:
        keyed = placed.withColumn("k", F.lit(lengths[0])).withColumn("key", candidate(lengths[0]))
    else:
        keyed = placed.select("*", F.explode(F.array(*[F.struct(
            F.lit(k).alias("k"), candidate(k).alias("key")) for k in lengths])).alias("c")).select(
            "row", "rid", "n_words", "w", "at", "c.k", "c.key")
    def item_key(k: int) -> Column:
        return let(F.split("words", " "), lambda words: _key(words, F.lit(0), k))

    table = windows.select(
        F.col("k").alias("wk"), "words", "items",
        F.coalesce(*[F.when(F.col("k") == k, item_key(k)) for k in lengths]).alias("wkey"))
    shown = F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("k")))
    if all(sum(each) <= BROADCAST_WINDOWS for each in zip(*sizes.values())):
        table = F.broadcast(table)
    else:
        keyed = keyed.where(F.col("key").isNotNull() | F.coalesce(F.col("at"), F.lit(0)).eqNullSafe(0)).select(
            "row", "rid", "n_words", "at", "k", F.coalesce("key", F.xxhash64("rid")).alias("key"),
            F.when(F.col("key").isNotNull(), shown).alias("window"))
        shown = F.col("window")
    met = keyed.join(table, (F.col("key") == F.col("wkey")) & (F.col("k") == F.col("wk"))
                     & (F.col("words") == shown), "left")
    # One row a text stays for texts without a hit: that of the first word, or of none.
    kept = met.where(F.col("wk").isNotNull() | F.coalesce(F.col("at"), F.lit(0)).eqNullSafe(0))
    found = kept.groupBy("rid").agg(
        F.first("row").alias("row"), F.first("n_words").alias("n"),
        F.collect_list(F.when(F.col("wk").isNotNull(), F.struct(
            F.col("at").alias("start"), (F.col("at") + F.col("k")).alias("stop")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found_items"))
    nothing = F.struct(F.array().cast("array<struct<start:int,stop:int>>").alias("done"),
                       F.lit(-1).alias("start"), F.lit(-1).alias("stop"))

    def step(acc: Column, span: Column) -> Column:
        joins = span["start"] <= acc["stop"]
        closed = F.array(F.struct(acc["start"].alias("start"), acc["stop"].alias("stop")))
        return F.struct(
            F.when(joins | (acc["stop"] < 0), acc["done"]).otherwise(F.concat(acc["done"], closed))
            .alias("done"),
            F.when(joins, acc["start"]).otherwise(span["start"]).alias("start"),
            F.when(joins, F.greatest(acc["stop"], span["stop"])).otherwise(span["stop"])
            .alias("stop"))

    def finish(acc: Column) -> Column:
        closed = F.array(F.struct(acc["start"].alias("start"), acc["stop"].alias("stop")))
        return F.when(acc["stop"] < 0, acc["done"]).otherwise(F.concat(acc["done"], closed))

    return found.select(
        *[F.col("row")[c].alias(c) for c in others],
        F.greatest(F.col("n"), F.lit(0)).cast("bigint").alias("n_words"),
        F.aggregate(F.array_sort("spans"), nothing, step, finish).alias("hits"), "found_items")


def count_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])


def cut(value: Column, spans: Column) -> Column:
    """The text without the words of ``spans``; each run leaves a line break."""
    inside = lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"]))
    within = lambda i: F.exists(spans, lambda s: (s["start"] < i) & (i < s["stop"]))
    first = lambda i: F.exists(spans, lambda s: s["start"] == i)
    return let(F.regexp_extract_all(value, F.lit(WORD_ANY), F.lit(0)), lambda words: let(
        F.split(value, WORD_ANY, -1), lambda gaps: F.array_join(F.transform(
            F.sequence(F.lit(0), F.size(words)), lambda i: F.concat(
                F.when(within(i), "").otherwise(F.get(gaps, i)), F.when(first(i), "\n").otherwise(""),
                F.when(inside(i) | (i == F.size(words)), "").otherwise(F.get(words, i)))), "")))


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   most: float = 0.5, length: str | None = None) -> DataFrame:
    """``docs`` without contaminated spans, and without texts of which more than ``most`` is hit.

    Only hit counts and places travel beside the key and a hash of the text; they are
    joined back to the rows. ``length`` names a column that holds the number of characters
    and is kept right.
    """
    scan = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    k, h, n, spans = (spare(docs, c) for c in ("k", "h", "n", "spans"))
    found = hits(scan, "t", items, item, item_text, window).where(F.size("hits") > 0).select(
        F.col("k").alias(k), F.col("h").alias(h), F.col("n_words").alias(n),
        F.col("hits").alias(spans)).dropDuplicates([k, h])
    rows = docs.join(found, docs[key].eqNullSafe(found[k]) & (F.xxhash64(docs[text]) == found[h]), "left")
    kept = rows.where(F.col(n).isNull() | (count_hit(F.col(spans)) <= most * F.col(n)))
    out = kept.withColumn(text, F.when(F.col(n).isNull(), F.col(text)).otherwise(
        cut(F.col(text), F.col(spans))))
    if length is not None:
        out = out.withColumn(length, F.when(F.col(n).isNull(), F.col(length)).otherwise(
            F.length(text)).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
