"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a text. Cost and selectivity of each rule are measured on a
sample of rows, and the rules run in the order of rejections per cost, so that most bad
texts meet the cheap, telling rules first and dear ones see what is left. The
order decides only the work: a text is kept if no rule rejects it.

Native SQL functions only; no shuffle. Null and empty texts have no words. Columns of the
caller stay as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import SPACES, let, without

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that orders the rules; it has no influence on which texts are kept.
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column], Column]


def full(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(full(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points in words: white space is ASCII, so bytes tell how many were not."""
    return let(full(text), lambda t: F.length(t) - F.octet_length(t)
               + F.octet_length(without(t, SPACES))).cast("bigint")


def n_symbols(text: Column) -> Column:
    return let(full(text), lambda t: F.octet_length(t) - F.octet_length(without(t, SYMBOLS))
               ).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(full(text), "\n", -1), lambda line: line.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(text: Column, run: int = 5) -> Column:
    """Words in runs of ``run`` words that occur twice or more in the text, the first included.

    Runs are told apart by 64-bit hashes; sorting them with their places finds the repeated
    ones in n log n, however long the text is.
    """
    def covered(grams: Column) -> Column:
        placed = F.array_sort(F.transform(
            grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j)["g"] == e["g"], F.lit(False))
        starts = let(placed, lambda s: F.transform(F.filter(
            s, lambda e, j: same(s, e, j - 1) | same(s, e, j + 1)), lambda e: e["i"]))
        return let(F.sort_array(starts), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(run), F.coalesce(F.get(p, i + 1) - x, F.lit(run)))),
            F.lit(0), lambda a, b: a + b))

    def count(words: Column) -> Column:
        grams = F.slice(F.transform(words, lambda x, i: F.xxhash64(
            x, *[F.get(words, i + j) for j in range(1, run)])), F.lit(1),
            F.greatest(F.size(words) - (run - 1), F.lit(0)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0)
                   .otherwise(covered(g)))

    return let(words_of(text), count).cast("bigint")


def measures(text: Column) -> dict[str, Column]:
    return {"n_words": n_words(text), "word_chars": word_chars(text), "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(text)}


#: Fewer words than a text needs.
TOO_SHORT = Rule("too_short", lambda t: n_words(t) < 10)
#: More than a fifth of the words lie in repeated runs.
REPETITIVE = Rule("repetitive", lambda t: 100 * n_repeat_words(t) > 20 * n_words(t))
#: Half a symbol or more for each word.
SYMBOLIC = Rule("symbolic", lambda t: 2 * n_symbols(t) > n_words(t))
#: Over three tenths of the lines with words repeat an earlier one.
LINE_COPIES = Rule("line_copies", lambda t: 10 * n_dup_lines(t) > 3 * F.size(
    F.filter(F.split(full(t), "\n", -1), lambda line: line.rlike(WORD))))
#: Words that no language has on average.
WORD_LENGTH = Rule("word_length", lambda t: let(n_words(t), lambda n: let(
    word_chars(t), lambda c: (n > 0) & ((c < 2 * n) | (c > 20 * n)))))

BASE = (TOO_SHORT, REPETITIVE)
EXTRA = (SYMBOLIC, LINE_COPIES, WORD_LENGTH)


def ordered(docs: DataFrame, text: str, rules: tuple[Rule, ...] = BASE + EXTRA,
            sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on the first ``sample_rows`` rows, best first.

    Only one flag a row and rule comes to the driver. The first of two runs warms up.
    """
    def run(flag: Column) -> tuple[float, float]:
        best, hit = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            rows = docs.select(flag.alias("flag")).take(sample_rows)
            best = min(best, time.perf_counter() - began)
            hit = sum(bool(r["flag"]) for r in rows) / max(len(rows), 1)
        return best, hit

    reading, _ = run(F.octet_length(text) < 0)
    found = []
    for place, rule in enumerate(rules):
        seconds, rejected = run(rule.rejects(F.col(text)))
        cost = max(seconds - reading, 1e-4)
        found.append((-rejected / cost, cost, place, rule))
    return [rule for *_, rule in sorted(found, key=lambda x: x[:3])]


def rejected_by(text: Column, rules: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the text; later ones don't run."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(text), rule.name).otherwise(out)
    return out


def filtered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + EXTRA,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects."""
    return docs.where(rejected_by(F.col(text), ordered(docs, text, rules, sample_rows)).isNull())
