"""Near copies by consistent weighted samples of TF-IDF shingles.

A text is the weighted set of its runs of five words (ASCII lower case; words are
digits, letters and all characters outside ASCII). A weight is the run's count in the
text times its inverse document frequency. Improved consistent weighted sampling
draws samples of which two texts share each with a probability equal to their
weighted Jaccard similarity; bands of samples give candidates, and every candidate pair
is verified with the similarity itself or ruled out by an exact upper bound of it.

* Document frequencies are counted over all documents, in ``BUCKETS`` hashed cells: a
  statistic of fixed size that resolves shares of about (runs per text / BUCKETS) at every
  corpus size. Only runs in over a third of the documents weigh less (see ``rarity``).
* Equal texts are one node; copies are not expanded. Within a band's bucket one leading
  node meets all others (no pairs among them). Where the verified links leave
  several components in a bucket, their nodes meet in blocks of bounded size, verify
  what the bound leaves in place, and only links leave the task. No pair of a bucket is
  given up by a cap or a chance: only the bands lose pairs.
* Null and empty texts, and texts without words, have no runs: they are near copies of
  exactly equal texts only (null equals empty). Repeated rows and null ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm import tokens
from truegauge.llm.common import spare, written
from truegauge.session import cut_lineage, ship_package

BUCKETS = 1 << 20
#: Samples a band; a pair at the similarity of 0.8 shares none of the bands once in 1,600.
ROWS, BANDS = 4, 14
WORDS = 5
SIMILARITY = 0.8
#: One group of copies may hold a third of all rows; runs more frequent than that weigh less.
COMMON = 3.0
#: Hashed cells of a text's weights that bound the similarity of two texts from above.
OUTLINE = 256
BLOCK = 512
_POOL_BITS = 16
_PIECE = 1 << 21
_ID_BITS = np.uint64(12)


class Sampler:
    """Random numbers of the consistent samples; fixed by its seed, a few MB."""

    def __init__(self, samples: int, seed: int = 7) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        size = (samples, 1 << _POOL_BITS)
        self.factor = draw.integers(0, 1 << 64, samples, dtype=np.uint64) | np.uint64(1)
        self.r = draw.gamma(2.0, 1.0, size).astype(np.float32)
        self.beta = draw.random(size).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, size)).astype(np.float32)


def features(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 52-bit run and count of each distinct run, by row and run. 4,096 rows at most."""
    hashes, _, _, first = tokens.word_hashes(*tokens.flat(column), tokens.ALNUM)
    rows, runs = tokens.shingles(hashes, first, words)
    keys = (rows.astype(np.uint64) << np.uint64(52)) | (runs >> _ID_BITS)
    keys.sort()
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else \
        np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> np.uint64(52)).astype(np.int64), keys & np.uint64((1 << 52) - 1), counts


def cell(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(32)).astype(np.int64)


def small_pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for at, piece in tokens.pieces(column, _PIECE):
        for more in range(0, len(piece), 4096):
            yield at + more, piece.slice(more, 4096)


def document_frequencies(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Documents per cell, over all rows, and the number of documents with a word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, documents = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for _, piece in small_pieces(batch.column(0)):
                rows, runs, _ = features(piece, words)
                cells += np.bincount(cell(runs), minlength=BUCKETS)
                documents += len(np.unique(rows))
        if documents:
            yield pa.RecordBatch.from_pydict({"cells": pa.array([packed(cells)], pa.binary()),
                                              "documents": [documents]})

    def packed(cells: np.ndarray) -> bytes:
        return pa.compress(cells.tobytes(), codec="zstd", asbytes=True)

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(bytes(data), BUCKETS * 8, codec="zstd"), np.int64)

    def add(a, b):
        if a is None or b is None:
            return a or b
        return packed(unpacked(a[0]) + unpacked(b[0])), a[1] + b[1]

    # Vectors of fixed size meet in a tree, not all on the driver.
    parts = texts.mapInArrow(count, "cells binary, documents bigint").rdd.map(tuple)
    cells, documents = parts.treeAggregate(None, add, add, depth=3) or (
        packed(np.zeros(BUCKETS, np.int64)), 0)
    return unpacked(cells), documents


def rarity(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Saturating inverse document frequency per cell: ln(1 + documents / frequency), 1 at most.

    Runs in up to a ``COMMON``-th of the documents all weigh 1. A steeper weight would let a
    large group of near copies fall apart: what its members share is frequent because of
    them, and what tells them apart is rare.
    """
    return np.minimum(np.log1p(documents / np.maximum(frequencies, 1)) / np.log1p(COMMON), 1.0).astype(np.float32)


def samples(rows: np.ndarray, runs: np.ndarray, weights: np.ndarray, sampler: Sampler
            ) -> tuple[np.ndarray, np.ndarray]:
    """One hashed sample per row with runs and per random draw; and those rows."""
    new = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    sizes = np.diff(np.append(new, len(rows)))
    which = np.repeat(np.arange(len(new)), sizes)
    logs = np.log(weights.astype(np.float64)).astype(np.float32)
    out = np.empty((len(new), len(sampler.factor)), dtype=np.uint64)
    for k, factor in enumerate(sampler.factor):
        at = ((runs * factor) >> np.uint64(64 - _POOL_BITS)).astype(np.int64)
        r = sampler.r[k][at]
        beta = sampler.beta[k][at]
        steps = np.floor(logs / r + beta)
        cost = sampler.log_c[k][at] - r * (steps - beta + np.float32(1))
        best = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, new), sizes))
        # Of equal costs that with the smallest run counts, as runs are in order.
        one = best[np.concatenate(([True], which[best][1:] != which[best][:-1]))]
        out[:, k] = tokens.mix(runs[one] + tokens.mix(steps[one].astype(np.int64).astype(np.uint64)))
    return out, rows[new]


def sign(texts: DataFrame, key: str, text: str, idf, words: int = WORDS,
         rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row: key, digest of the text, total weight and band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler(rows * bands), idf.value
        for batch in batches:
            for at, piece in small_pieces(batch.column(1)):
                digests = [hashlib.sha256(x.as_buffer() or b"").digest()
                           for x in piece.cast(pa.binary())]
                places, runs, counts = features(piece, words)
                keys: list = [None] * len(piece)
                total = np.zeros(len(piece))
                if len(runs):
                    weights = counts * table[cell(runs)]
                    total = np.bincount(places, weights, len(piece))
                    drawn, owners = samples(places, runs, weights, sampler)
                    band = drawn[:, 0::rows].copy()
                    for j in range(1, rows):
                        band = tokens.mix(band * np.uint64(_ODD) + drawn[:, j::rows])
                    for i, owner in enumerate(owners):
                        keys[owner] = band[i].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(piece)), pa.array(digests, pa.binary()),
                     pa.array(total), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "digest", "weight", "bands"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(
        run, f"id {kind}, digest binary, weight double, bands array<bigint>")


_ODD = 0xFF51AFD7ED558CCD


def weighed(column: pa.Array, table: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Runs and weights of each text."""
    out = []
    for _, piece in small_pieces(column):
        places, runs, counts = features(piece, words)
        bounds = np.searchsorted(places, np.arange(len(piece) + 1))
        weights = counts * table[cell(runs)].astype(np.float64)
        out += [(runs[i:j], weights[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    return out


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    (runs, weights), (others, theirs) = x, y
    if not len(runs) or not len(others):
        return 0.0
    place = np.searchsorted(others, runs)
    place[place == len(others)] = 0
    same = others[place] == runs
    low = np.minimum(weights[same], theirs[place[same]]).sum()
    return float(low / (weights.sum() + theirs.sum() - low))


def outlines(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weight of each text in ``OUTLINE`` hashed cells.

    Two texts share no more weight in a cell than the smaller of their weights there.
    """
    shift = np.uint64(65 - OUTLINE.bit_length())
    return np.array([np.bincount((tokens.mix(runs) >> shift).astype(np.int64), weights, OUTLINE)
                     for runs, weights in bags]).reshape(len(bags), OUTLINE)


def verified(pairs: DataFrame, texts: DataFrame, idf, words: int, least: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose weighted Jaccard similarity is ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in tokens.pieces(batch.column(3), _PIECE):
                left_ids = batch.column(0).slice(at, len(piece)).to_numpy()
                # The rows come by their first node: its text is weighed once a run of rows.
                new = np.flatnonzero(np.concatenate(([True], left_ids[1:] != left_ids[:-1])))
                left = weighed(batch.column(2).slice(at, len(piece)).take(pa.array(new)), idf.value, words)
                right = weighed(piece, idf.value, words)
                which = np.cumsum(np.isin(np.arange(len(piece)), new)) - 1
                found = np.array([weighted_jaccard(x, left[which[i]]) for i, x in enumerate(right)])
                keep = pa.array(found >= least - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(piece)).filter(keep),
                     batch.column(1).slice(at, len(piece)).filter(keep),
                     pa.array(found).filter(keep)], names=["a", "b", "similarity"])

    lefts = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rights = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(rights, "b").join(lefts, "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a bigint, b bigint, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the component's smallest node.

    Alternates the two star steps until nothing changes: each hangs nodes under
    smaller neighbours. Every round is written to the shared folder.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                        .where("lo < hi").distinct())
    state = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        edges = cut_lineage(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                            .union(small.select(F.col("m").alias("lo"), "hi"))
                            .where("lo < hi").distinct())
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast(
            "decimal(38,0)")), F.lit(0)), F.count_distinct("hi")).first()
        # Settled: unchanged, and every node hangs under one root.
        if now == state and now[0] == now[2]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        state = now


def mixed_links(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, idf, words: int,
                least: float, block: int) -> DataFrame:
    """Links (a, b) across components of one bucket that the leaders' links left apart.

    A bucket's nodes fall into hashed blocks of about ``block``; every two blocks meet
    in one group, so a group stays small however large the bucket is. Pairs that the bounds don't
    rule out are verified there; only links that join what is still apart leave the group.
    """
    rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")
    ).where("r0 < r1")
    rows = (rooted.join(sizes.select("band", "key", "n"), ["band", "key"])
            .join(nodes.select("node", "weight"), "node").join(texts, "node")
            .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    met = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
           .select("band", "key", "i", "j", "own", "node", "root", "weight", "text"))

    def meet(table: pa.Table) -> pa.Table:
        node, root = table["node"].to_numpy(), table["root"].to_numpy()
        own, weight = table["own"].to_numpy(), table["weight"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        bags = weighed(pa.concat_arrays(table["text"].chunks), idf.value, words)
        cells = outlines(bags)
        parts = {r: r for r in root}
        out = []

        def part(r):
            while parts[r] != r:
                r = parts[r]
            return r

        for x in np.flatnonzero(own == i):
            y = np.flatnonzero((own == j) & (root != root[x]) & ((node > node[x]) | (i != j)))
            # min / max of the totals bounds the similarity from above.
            y = y[np.minimum(weight[y], weight[x]) >= (least - 1e-9) * np.maximum(weight[y], weight[x])]
            both = np.minimum(cells[y], cells[x]).sum(axis=1)
            y = y[both >= (least - 1e-9) * (weight[y] + weight[x] - both)]
            for k in y:
                if part(root[x]) != part(root[k]) and weighted_jaccard(bags[x], bags[k]) >= least - 1e-9:
                    parts[part(root[x])] = part(root[k])
                    out.append((node[x], node[k]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("band", "key", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def near_copy_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", *,
                      words: int = WORDS, similarity: float = SIMILARITY, rows: int = ROWS,
                      bands: int = BANDS, block: int = BLOCK
                      ) -> tuple[DataFrame, DataFrame]:
    """Classes of near copies.

    Returns (rows, nodes). ``rows``: id, digest, class_id for every row of ``docs``; class_id
    is the smallest id in the class (null if all are null). ``nodes``: one row per distinct
    text with its smallest id, class and whether it is the class's first text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frequencies, documents = document_frequencies(plain.select("text"), words)
    idf = spark.sparkContext.broadcast(rarity(frequencies, documents))  # BUCKETS floats
    signed = written(sign(plain, "id", "text", idf, words, rows, bands), "signed")
    nodes = written(signed.groupBy("digest").agg(
        F.min("id").alias("id"), F.first("weight").alias("weight"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()),
        "nodes")
    members = nodes.where("bands is not null").select(
        "node", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(members.join(sizes, ["band", "key"]), "shared")
    # The text that meets most others leads its buckets: copies agree with what they were made
    # of more than with one another.
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = shared.select("band", "key", "node").join(met, "node").groupBy("band", "key").agg(
        F.max(F.struct("met", "node"))["node"].alias("leader"))
    buckets = written(shared.select("band", "key", "node").join(leaders, ["band", "key"]), "buckets")
    stars = buckets.where("leader <> node").select(
        F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    wanted = buckets.select("node").distinct().join(nodes, "node").select(
        "node", F.col("id").alias("wanted_id"), F.hex("digest").alias("wanted_digest"))
    found = plain.withColumn("wanted_digest", F.upper(F.sha2("text", 256)))
    texts = written(found.join(wanted, (found["id"].eqNullSafe(wanted["wanted_id"]))
                               & (found["wanted_digest"] == wanted["wanted_digest"]))
                    .select("node", "text").dropDuplicates(["node"]), "texts")
    links = written(verified(stars, texts, idf, words, similarity), "links")
    more = written(mixed_links(buckets, nodes, components(links), texts, idf, words, similarity, block),
                   "links")
    roots = components(links.select("a", "b").union(more.select("a", "b")))
    rooted = nodes.select("digest", "id", "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(
        F.min("id").alias("class_id"),
        F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node")))["node"].alias("kept"))
    classes = written(rooted.join(firsts, "root").select(
        "digest", "id", "class_id", (F.col("node") == F.col("kept")).alias("is_first")), "classes")
    out = signed.select("id", "digest").join(classes.select("digest", "class_id"), "digest")
    return out, classes


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class with all its columns: the one with the smallest id."""
    _, classes = near_copy_classes(docs, key, text, **options)
    first, digest, own = (spare(docs, c) for c in ("first", "digest", "own"))
    firsts = classes.where("is_first").select(
        F.col("id").alias(first), F.lower(F.hex("digest")).alias(digest))
    keyed = docs.withColumn(own, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    kept = keyed.join(firsts, (keyed[own] == firsts[digest]) & keyed[key].eqNullSafe(firsts[first]))
    return kept.dropDuplicates([digest, first]).select(*docs.columns)
