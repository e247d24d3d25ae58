"""Secret scans with an incremental blob ledger.

A blob is a text by its SHA-256. The ledger has one row per scanned blob and rule version:
(blob, rule, version, found). Every version of every path names a blob, so that each distinct
text is scanned once per rule version, whenever and wherever it appears; findings are joined
back to all paths. Native SQL functions and joins only.

* Null texts are the empty blob. Repeated rows and null keys are allowed: every row gets
  its findings. Extra columns stay with the caller's rows.
* Spans are in code points, end exclusive; of one kind they are leftmost and don't overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import match_spans, written


@dataclass(frozen=True)
class SecretRule:
    """A pattern, what a match must meet, and a cheap test that a text may have a match."""

    name: str
    version: int
    pattern: str
    accepts: Callable[[Column], Column]
    may_have: Callable[[Column], Column]


def _long(n: int) -> Callable[[Column], Column]:
    return lambda found: F.length(found) >= n


def _any_of(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        out = F.lit(False)
        for part in parts:
            out = out | F.contains(text, F.lit(part))
        return out
    return test


# The three base patterns.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"

BASE = (
    SecretRule("assign", 1, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8,
               lambda t: _any_of("passw", "secret", "token", "apikey", "api_key")(F.lower(t))),
    SecretRule("access", 1, ACCESS, _long(16), _any_of("AKIA")),
    # Runs of hexadecimal digits are whole matches, so the least length may be in the pattern.
    SecretRule("hex", 1, HEX, _long(32), lambda t: t.rlike("[0-9a-f]{32}")),
)
EXTRA = (
    SecretRule("key_block", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:(?!-----END)[\s\S])*+"
               r"(?:-----END [A-Z ]{0,32}PRIVATE KEY-----)?", _long(1), _any_of("PRIVATE KEY-----")),
    SecretRule("web_token", 1, r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", _long(32),
               _any_of(".eyJ")),
    SecretRule("prefixed", 1, r"(?:gh[pousr]_|xox[abprs]-|glpat-|sk_live_)[A-Za-z0-9_-]+", _long(20),
               _any_of("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "glpat-", "sk_live_")),
)
RULES = BASE + EXTRA

LEDGER = "blob string, rule string, version int, found array<struct<start:int,stop:int>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(text: Column, rule: SecretRule) -> Column:
    kept = F.filter(match_spans(text, rule.pattern), lambda m: rule.accepts(m["text"]))
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop")))
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    return F.when(rule.may_have(text), spans).otherwise(nothing)


def scan_unseen(history: DataFrame, key: str, text: str, ledger: DataFrame | None = None,
                rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that ``ledger`` lacks.

    Texts are dealt by blob and key, so copies of one text spread over tasks; only the row
    with the blob's smallest key is scanned.
    """
    named = history.select(F.col(key).alias("key"), blob_of(F.col(text)).alias("blob"))
    first = named.groupBy("blob").agg(F.min("key").alias("first"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(
            F.concat_ws("@", "rule", "version")).alias("seen"))
        first = first.join(seen, "blob", "left").where(F.coalesce(F.size(F.array_except(
            F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules]), "seen")) > 0, F.lit(True)))
    else:
        first = first.withColumn("seen", F.lit(None).cast("array<string>"))
    texts = history.select(F.col(key).alias("key"), blob_of(F.col(text)).alias("b"),
                           F.coalesce(F.col(text), F.lit("")).alias("text"))
    due = texts.join(first.hint("shuffle_hash"), (texts["b"] == first["blob"])
                     & texts["key"].eqNullSafe(first["first"]))
    columns = []
    for rule in rules:
        new = ~F.coalesce(F.array_contains("seen", f"{rule.name}@{rule.version}"), F.lit(False))
        columns.append(F.when(new, F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"),
            _spans(F.col("text"), rule).alias("found"))))
    scanned = due.select("blob", F.array(*columns).alias("rows")).select(
        "blob", F.explode("rows").alias("r")).where("r is not null").select("blob", "r.*")
    # Repeated rows of one key and text are scanned alike; one stays.
    return scanned.dropDuplicates(["blob", "rule", "version"])


def updated(ledger: DataFrame | None, history: DataFrame, key: str, text: str,
            rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The ledger with what it lacked, written to the shared folder."""
    new = scan_unseen(history, key, text, ledger, rules)
    return written(new if ledger is None else ledger.unionByName(new), "ledger")


def findings(history: DataFrame, text: str, ledger: DataFrame,
             rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``history`` with column ``findings``: (kind, start, stop) by start, then by rule."""
    now = F.lit(False)
    for rule in rules:
        now = now | ((F.col("rule") == rule.name) & (F.col("version") == rule.version))
    place = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule")).cast("int")
    per_blob = ledger.where(now & (F.size("found") > 0)).select(
        F.col("blob").alias("__blob"), "rule", place.alias("place"), F.explode("found").alias("f")
    ).groupBy("__blob").agg(F.array_sort(F.collect_list(F.struct(
        F.col("f.start").alias("start"), "place", F.col("rule").alias("kind"),
        F.col("f.stop").alias("stop")))).alias("__found"))
    listed = history.withColumn("__key", blob_of(F.col(text)))
    nothing = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return listed.join(per_blob, listed["__key"] == per_blob["__blob"], "left").select(
        *[listed[c] for c in history.columns], F.coalesce(F.transform("__found", lambda f: F.struct(
            f["kind"].alias("kind"), f["start"].alias("start"), f["stop"].alias("stop"))), nothing)
        .alias("findings"))


def joined(found: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of the findings, comma-joined."""
    if kinds is not None:
        found = F.filter(found, lambda f: f["kind"].isin(kinds))
    return F.array_join(F.transform(found, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")
