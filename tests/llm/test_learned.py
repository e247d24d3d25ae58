"""Severity and language models against plain Python and held-out rows; the pipeline end to end."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_TINY
from tests.llm.conftest import ROWS
from truegauge.llm import decontaminate, language_model, near_copies, pseudonyms, quality_rules, queries, severity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(low), "\0end"]


def check_scores(rows, docs):
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in docs}
    counts = Counter(w for k, t in docs if not held[k] for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((k, held[k], len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), n,
                    round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens_of(t)), 4)) for k, t in docs)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                    round(r["base_score"], 4)) for r in rows) == want
    return held


def test_language_model_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.read(spark, SF_TINY, "documents").collect()]
    rows = queries.op6_language_model(spark, SF_TINY).collect()
    held = check_scores(rows, docs)
    unseen = [r for r in rows if held[r["doc_id"]]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_language_model_on_edge_rows(edge, nothing):
    rows = language_model.scored(edge, language_model.held_out(), chunk_bytes=2000).collect()
    check_scores(rows, [(r[0], r[1]) for r in ROWS])
    assert language_model.scored(nothing, language_model.held_out()).count() == 0
    alone = language_model.scored(edge, F.lit(True)).collect()
    assert all(abs(r["score"]) < 1e-9 for r in alone)  # nothing learnt: the unknown token is certain


def part_of(counts, discounts=(0.6, 0.5, 0.4)):
    word = np.sort(np.array([c[0] for c in counts], np.uint64))
    rows = sorted(counts)
    words, first, context, _ = language_model.cells_of(word, np.array([c[1] for c in rows]))
    return language_model.Part(language_model.pack(words, first.astype(np.int64), context.astype(np.int64),
                                                   np.array([c[2] for c in rows], np.int64)), discounts, 3)


def test_seating_stays_consistent_and_sums_to_one():
    rng = np.random.default_rng(5)
    counts = [(w, c, int(rng.integers(1, 9))) for w in range(1, 40) for c in rng.choice(600, 6, replace=False)]
    part, base = part_of(counts), 1 / 40
    for _ in range(20):
        sums = part.sums()
        part.set_totals([(sums[2 * i], sums[2 * i + 1]) for i in range(3)])
        part.sweep(base)
        for level, seats in enumerate(part.levels):
            assert (seats.c >= seats.t).all() and ((seats.c > 0) == (seats.t > 0)).all()
        low, middle, root = part.levels
        assert (np.bincount(part.up, low.t, len(middle.c)) == middle.c).all()
        assert (np.bincount(part.top, middle.t, len(root.c)) == root.c).all()
    assert low.c.sum() == sum(c[2] for c in counts)
    sums = part.sums()
    part.set_totals([(sums[2 * i], sums[2 * i + 1]) for i in range(3)])
    for context in (counts[0][1], 40000):
        n = len(part.words)
        p, _ = part.asked(part.words, np.arange(n + 1), np.full(n, context), base)
        unknown, _ = part.asked(np.array([10 ** 9], np.uint64), np.array([0, 1]), np.array([context]), base)
        assert abs(p.sum() + unknown[0] - 1) < 1e-9


def test_cells_without_customers_change_nothing():
    """Cells that only held-out texts have lie among the others and get what an unseen cell is answered."""
    rng = np.random.default_rng(6)
    counts = [(w, c << 17 | c % 90, int(rng.integers(1, 9))) for w in range(1, 30)
              for c in rng.choice(200, 5, replace=False).tolist()]
    taken = {c[:2] for c in counts}
    extra = [(w, c << 17 | c % 90, 0) for w in range(20, 40) for c in range(150, 260, 7)]
    extra = [c for c in extra if c[:2] not in taken]
    alone, base, mixed, parts = part_of(counts), 1 / 30, sorted([*counts, *extra]), []
    both = part_of(mixed)
    for part in (alone, language_model.Part.restored(both.stored(), (0.6, 0.5, 0.4), 3)):
        for _ in range(3):
            sums = part.sums()
            part.set_totals([(sums[2 * i], sums[2 * i + 1]) for i in range(3)])
            part.sweep(base)
        sums = part.sums()
        part.set_totals([(sums[2 * i], sums[2 * i + 1]) for i in range(3)])
        parts.append(sums)
    assert all((a == b).all() for a, b in zip(parts[0][2:], parts[1][2:]))
    words, context = np.array([c[0] for c in mixed], np.uint64), np.array([c[1] for c in mixed])
    distinct, first, context, _ = language_model.cells_of(words, context)
    p, known = alone.asked(distinct, first, context, base)
    assert np.allclose(part.shares(base)[0], p, rtol=1e-12) and (part.totals == known).all()


def test_packed_numbers_take_little_room():
    rng = np.random.default_rng(1)
    rows, hashes = rng.integers(0, 600, 20_000, np.uint32), np.sort(rng.integers(0, 1 << 63, 20_000, np.int64))
    assert len(language_model.pack(rows)) < 1.4 * len(rows)
    assert len(language_model.pack(language_model.gaps(hashes))) < 6.6 * len(hashes)
    arrays = [rows, rows[:0], language_model.gaps(hashes), np.zeros(7, np.uint32), rng.random(50)]
    back = language_model.unpack(language_model.pack(*arrays), *(a.dtype for a in arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back))


def test_texts_and_cells_move_once(spark, tmp_path):
    """The answer neither reads a text again nor moves cells that lie in buckets, and no chunk size changes it."""
    docs = queries.read(spark, SF_TINY, "documents")
    found = language_model.scored(docs, language_model.held_out())
    found.write.parquet(str(tmp_path / "found"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Bucketed: true" in plan
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    rows = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "found")).collect()}
    for r in language_model.scored(docs, language_model.held_out(), chunk_bytes=5000).collect():
        assert abs(r["score"] - rows[r["doc_id"]]["score"]) < 1e-6 and r["n_known"] == rows[r["doc_id"]]["n_known"]


def table_chances(c, d, others, parent, most=800):
    """P(tables) of one cell by the recursion of the generalized Stirling numbers, in logarithms."""
    t = np.arange(1, min(c, most) + 1)
    ways = np.where(t == 1, 0.0, -np.inf)
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            stays = np.where(t <= n, ways + np.log(np.maximum(n - d * t, 1e-300)), -np.inf)
        ways = np.logaddexp(stays, np.concatenate(([-np.inf], ways[:-1])))
    rise = np.concatenate(([0.0], np.cumsum(np.log((1 + d * (others + t[:-1])) * parent))))
    chance = np.exp(ways + rise - (ways + rise).max())
    return t, chance / chance.sum()


@pytest.mark.parametrize("c", [2, 3, 10, 16, 17, 100, 1000, 20000])
@pytest.mark.parametrize("d, others, parent", [(0.5, 0, 0.2), (0.5, 30, 0.001), (0.2, 10, 0.9), (0.7, 5, 0.3),
                                               (0.6, 400, 0.05)])
def test_one_sweep_meets_the_exact_posterior(c, d, others, parent):
    """A single sweep from the start of one table a cell, as many equal cells, under a fixed parent."""
    n = 4000
    seats = language_model.Seats(np.zeros(n, np.int64), np.full(n, c), d,
                                 (np.zeros(1), np.full(1, others + 1.0)), np.random.default_rng(c))
    seats.resat(np.full(n, parent))
    t, chance = table_chances(c, d, others, parent)
    mean = (t * chance).sum()
    assert abs(seats.t.mean() - mean) < 0.04 * mean + 4 * seats.t.std() / n ** 0.5 + 0.12 * (mean - 1) * (c > 16)
    if c <= language_model.EXACT:
        found = np.bincount(seats.t, minlength=c + 1)[1:] / n
        assert abs(found - chance).max() < 0.035


def test_large_cells_hold_many_tables():
    """Cells of up to 10^12 customers are drawn too, and more customers never mean fewer tables on average."""
    means = []
    for c in (10, 100, 1000, 100_000, 10 ** 12):
        t = language_model.drawn_tables(np.full(3000, c), np.full(3000, 50), np.full(3000, 0.3), 0.4,
                                        np.random.default_rng(4))
        assert (t >= 1).all() and (t <= c).all()
        means.append(t.mean())
    assert means[0] > 3 and all(b > a for a, b in zip(means, means[1:]))


def test_severity_grades(spark):
    folder = "/root/testdata/sf0.1"
    docs = queries.read(spark, folder, "documents")
    labels = queries.read(spark, folder, "labels").where("quality is not null")
    graded = labels.select("doc_id", F.when(F.col("toxic") == 0, 0).otherwise(1 + F.col("quality")).alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = severity.fit(docs, graded.where(~held))
    assert model.thresholds[0] < model.thresholds[1]
    out = severity.scored(docs.join(graded.where(held), "doc_id").select("doc_id", "text", F.col("grade").alias("true")),
                          model).join(graded.withColumnRenamed("grade", "true"), "doc_id").collect()
    bad = [r for r in out if r["true"] > 0]
    assert np.mean([r["toxic"] for r in bad]) > 0.8
    assert np.mean([r["toxic"] for r in out if r["true"] == 0]) < 0.01
    mean = [np.mean([r["severity"] for r in out if r["true"] == g]) for g in range(3)]
    assert mean[0] < 0.1 < mean[1]


def test_thresholds_share_weights():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4)) < 0.4
    z = x @ np.array([2.0, -1.0, 0.0, 1.0]) + rng.logistic(size=3000)
    grades = (z > 0.5).astype(int) + (z > 2.0)
    rows, cols = np.nonzero(x)
    w, t = severity.fit_thresholds(rows, cols, grades, 4, 3, penalty=0.0, steps=1500)
    assert np.allclose(w, [2, -1, 0, 1], atol=0.3) and np.allclose(t, [0.5, 2.0], atol=0.3)


def test_severity_means_the_same_when_the_sample_is_capped(spark):
    """A word that makes toxic texts likelier, but not likely: a fit on equal numbers a grade would flag it."""
    rng = np.random.default_rng(4)
    grades = np.repeat([0, 1, 2], [3600, 100, 300])
    words = [["plain", *(["odd"] if rng.random() < (0.85 if g else 0.25) else []),
              *(["foul"] if g and rng.random() < 0.5 else [])] for g in grades]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grades)], "doc_id bigint, grade int")
    asked = spark.createDataFrame([(1, "plain"), (2, "plain odd"), (3, "plain odd foul")], docs.schema)
    whole, cut = ({r["doc_id"]: r for r in severity.scored(asked, severity.fit(docs, labels, sample=n)).collect()}
                  for n in (8000, 200))
    assert [whole[i]["toxic"] for i in (1, 2, 3)] == [cut[i]["toxic"] for i in (1, 2, 3)] == [False, False, True]
    assert all(abs(whole[i]["severity"] - cut[i]["severity"]) < 0.2 for i in (1, 2, 3))


def test_severity_of_edge_rows(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 2), (8, 1), (None, 1), (9, None), (99, 0)], "doc_id bigint, grade int")
    model = severity.fit(edge, labels)
    assert severity.scored(edge, model).count() == len(ROWS)
    assert severity.scored(nothing, severity.fit(nothing, labels)).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.read(spark, SF_TINY, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, SF_TINY).cache()
    return out


def test_pipeline_stages(spark, stages):
    docs = queries.read(spark, SF_TINY, "documents")
    kept = stages["quality rules"]
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rules = list(quality_rules.BASE + quality_rules.EXTRA)
    assert kept.where(quality_rules.rejected_by(F.col("text"), rules).isNotNull()).count() == 0
    single = stages["near duplicates"]
    assert single.columns == docs.columns
    rows, _ = near_copies.near_copy_classes(kept)
    assert {r["doc_id"] for r in single.collect()} == {r["class_id"] for r in rows.collect()}
    clean = stages["benchmark decontamination"]
    items = queries.read(spark, SF_TINY, "benchmark")
    assert clean.columns == docs.columns
    assert decontaminate.hits(clean, "text", items).where("size(hits) > 0").count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0
    private = stages["personal data"]
    assert private.columns == docs.columns and private.count() == clean.count()
    before = {r["doc_id"]: r for r in pseudonyms.with_pseudonyms(clean, found="f").collect()}
    assert all(before[r["doc_id"]]["text"] == r["text"] and len(r["text"]) == r["n_chars"] for r in private.collect())
    last = stages["byte pairs"].collect()
    assert len(last) == private.count() and all(len(r["ids"]) == 4 * r["n_tokens"] for r in last)


def test_pipeline_run(spark, stages):
    ran = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF_TINY).collect()}
    assert ran == {(r["doc_id"], r["ids_sha256"]) for r in stages["byte pairs"].collect()}


def test_contexts_are_whole_words():
    """The same word behind two words of one ending is two cells, which share a parent's cell."""
    row, word, context = language_model.text_tokens(pa.array(["nation x sun-on x NATION x", None]))
    assert row.tolist() == [0] * 7 + [1] and len(context) == len(word) == 8
    after = context[[1, 3, 5]]
    assert after[0] == after[2] != after[1]
    assert len(set(language_model.parent_context(after))) == 1
    assert context[0] == context[7] and context[0] not in after


def test_language_model_tells_words_of_one_ending_apart(spark):
    """What follows depends on the whole word before, which two bytes of it don't show; parts meet by exchange."""
    rows = [(i, " ".join(["nation red" if i % 2 else "potion blue"] * 20)) for i in range(300)]
    rows += [(1000, "nation red"), (1001, "nation blue")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in language_model.scored(
        docs, F.col("doc_id") >= 1000, chunk_bytes=3000, parts=5).collect()}
    assert found[1000] > found[1001] + 2


def test_restaurants_of_many_parts_are_added(spark):
    """Scores differ between numbers of parts by the sampling only, and each word's chances stay the same size."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r["doc_id"]: r for r in language_model.scored(
        docs, language_model.held_out(), chunk_bytes=size, parts=parts).collect()} for size, parts in ((1 << 20, 1), (700, 9)))
    for k in one:
        assert abs(one[k]["score"] / many[k]["score"] - 1) < 0.03
        assert abs(one[k]["base_score"] - many[k]["base_score"]) < 1e-6 and one[k]["n_known"] == many[k]["n_known"]
