"""SimHash fingerprints linked by anchor-point covering.

A text's fingerprint has a bit set where over half of its shingle hashes have it; shingles are
runs of words (everything but ASCII white space, A-Z lower-cased), repeats included. Fingerprints
that differ in at most ``reach`` bits are linked, and links make components.

The anchors are the words of a covering code of length 64: two random linear codes of length 32
side by side, so that the nearest anchors follow from two short tables. A fingerprint x is at home
at its nearest anchor, r(x) bits away, and visits every anchor within r(x) + ``reach``. Of two
linked fingerprints take the one nearer to its home: that home is within the other's reach too
(triangle inequality), so the pair meets there, whatever the code; the code decides the work only.
r(x) is the point's own covering distance, never more than the covering radius of the code.

* The code grows with the counted fingerprints, so that an anchor is home to about ``HOMES_EACH``.
* Equal fingerprints are one node. Comparisons within an anchor are homes against visitors; a task
  returns links that join what is still apart there, a forest, never all pairs.
* An anchor with many visitors or homes is compared in blocks of bounded size, all of them.
* Null, empty and blank texts have fingerprint zero, linked like any other. Repeated rows and
  ids count as they are; a null id is never the smallest, and a component without any id has
  a null one. An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, repeat
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import written
from truegauge.llm.near_copies import components
from truegauge.session import ship_package

WORDS = 3
REACH = 3
SEED = 42
#: Fingerprints at home at an anchor, on average.
HOMES_EACH = 256
#: Half codes have 2^6 to 2^16 words.
LEAST_BITS, MOST_BITS = 6, 16
#: Homes and visitors of an anchor that meet in one task.
HOMES, VISITORS = 8192, 32768
_SEGMENT = 1 << 20
_TABLE = 1 << 21
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, a segment of the text at a time."""
    carried, at, some = [], 0, False
    while at < len(text):
        stop = at + _SEGMENT
        if stop < len(text):
            gap = _GAP.search(text, stop)
            stop = gap.start() if gap else len(text)
        found = carried + text[at:stop].lower().split()
        at, n = stop, len(found) - words + 1
        if n > 0:
            joined = b" ".join(found)
            ends = [end - 1 for end in accumulate(len(w) + 1 for w in found)]
            starts = [0, *(end + 1 for end in ends[:n - 1])]
            runs = (joined[a:b] for a, b in zip(starts, ends[words - 1:]))
            yield np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)
            some, found = True, found[n:]
        carried = found
    if carried and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The text's fingerprint as a signed 64-bit number."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words):
        total += len(hashes)
        for k in range(0, len(hashes), 1 << 16):
            part = hashes[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) for every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(b"" if x is None else memoryview(x).tobytes(), words)
                     for x in (v.as_buffer() for v in batch.column(1).cast(pa.large_binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, fp bigint")


class Anchors:
    """The words of the covering code; anchor (i, j) has the number ``i << bits | j``."""

    def __init__(self, bits: int, seed: int = 11) -> None:
        rows = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, MOST_BITS, dtype=np.uint32)
        self.bits, self.words = bits, np.zeros(1, np.uint32)
        for row in rows[:bits]:
            self.words = np.concatenate((self.words, self.words ^ row))

    @staticmethod
    def for_count(fingerprints: int) -> Anchors:
        half = ceil(log2(max(fingerprints, 1) / HOMES_EACH) / 2) if fingerprints > HOMES_EACH else 0
        return Anchors(min(max(half, LEAST_BITS), MOST_BITS))

    def around(self, fps: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of (row, anchor, nearest distance of the row, is home): all anchors within reach of the nearest."""
        step = max(1, _TABLE >> self.bits)
        for at in range(0, len(fps), step):
            part = fps[at:at + step]
            far = [np.bitwise_count(half.astype(np.uint32)[:, None] ^ self.words)
                   for half in (part >> np.uint64(32), part & np.uint64(0xFFFFFFFF))]
            least = [d.min(axis=1) for d in far]
            more = [d - m[:, None] for d, m in zip(far, least)]
            home = (far[0].argmin(axis=1) << self.bits) | far[1].argmin(axis=1)
            nearest = least[0].astype(np.int64) + least[1]
            for spent in range(reach + 1):
                rows, left = np.nonzero(more[0] == spent)
                others, right = np.nonzero(more[1] <= reach - spent)
                first = np.searchsorted(others, np.arange(len(part) + 1))
                counts = np.diff(first)[rows]
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                row = np.repeat(rows, counts)
                anchor = (np.repeat(left, counts) << self.bits) | right[first[row] + place]
                yield row + at, anchor, nearest[row], anchor == home[row]


def visits(nodes: DataFrame, anchors: Anchors, reach: int) -> DataFrame:
    """(anchor, fp, home) for every anchor that a fingerprint visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for row, anchor, _, home in anchors.around(fps, reach):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(fps[row].view(np.int64)), pa.array(home)],
                    names=["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def forest(homes: np.ndarray, visitors: np.ndarray, reach: int) -> list[tuple[np.uint64, np.uint64]]:
    """Links within reach between homes and visitors, only those that join parts still apart."""
    nodes, place = np.unique(np.concatenate((homes, visitors)), return_inverse=True)
    part, links = np.arange(len(nodes)), []
    visiting = place[len(homes):]
    step = max(1, _TABLE // max(1, len(visitors)))
    for at in range(0, len(homes), step):
        near = np.bitwise_count(homes[at:at + step, None] ^ visitors) <= reach
        row, column = np.nonzero(near)
        first = np.searchsorted(row, np.arange(len(near) + 1))
        for k in np.flatnonzero(np.diff(first) > 0):
            own = place[at + k]
            met = visiting[column[first[k]:first[k + 1]]]
            parts, example = np.unique(part[met], return_index=True)
            fresh = parts != part[own]
            if fresh.any():
                links += [(nodes[own], nodes[met[e]]) for e in example[fresh]]
                part[np.isin(part, parts[fresh])] = part[own]
    return links


def links(nodes: DataFrame, reach: int = REACH, homes: int = HOMES, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) that hold together what chains of links between the distinct ``fp`` of ``nodes`` connect."""
    ship_package(nodes.sparkSession)
    met = written(visits(nodes, Anchors.for_count(nodes.count()), reach), "visits")
    crowded = written(met.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h")).where(
        (F.col("n") > visitors) | (F.col("h") > homes)).select(
        "anchor", F.ceil(F.col("h") / homes).cast("int").alias("rows"),
        F.ceil(F.col("n") / visitors).cast("int").alias("columns")), "crowded")
    wide = met.join(crowded, "anchor", "left")
    i = F.pmod(F.xxhash64("fp", F.lit(1)), F.greatest("rows", F.lit(1)))
    j = F.pmod(F.xxhash64("fp", F.lit(2)), F.greatest("columns", F.lit(1)))

    def to(row, column, home, visit):
        return F.struct(row.cast("bigint").alias("i"), column.cast("bigint").alias("j"), home.alias("home"),
                        visit.alias("visit"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    # A visitor meets all rows of its column of blocks; at home it meets all columns of its row.
    as_visitor = F.transform(F.sequence(zero, F.greatest("rows", F.lit(1)) - 1),
                             lambda r: to(r, j, F.col("home") & (r == i), yes))
    as_home = F.transform(F.filter(F.sequence(zero, F.col("columns") - 1), lambda c: c != j),
                          lambda c: to(i, c, yes, no))
    roles = (F.when(F.col("columns").isNull(), F.array(to(zero, zero, F.col("home"), yes)))
             .when(F.col("home"), F.concat(as_visitor, as_home)).otherwise(as_visitor))
    dealt = wide.select("anchor", "fp", F.explode(roles).alias("at")).select(
        (F.shiftleft("anchor", 32) + F.shiftleft("at.i", 16) + F.col("at.j")).alias("place"),
        "fp", "at.home", "at.visit")

    def compare(table: pa.Table) -> pa.Table:
        fps = table["fp"].to_numpy().view(np.uint64)
        found = forest(fps[table["home"].to_numpy()], fps[table["visit"].to_numpy()], reach)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("place").applyInArrow(compare, "a bigint, b bigint")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS,
                reach: int = REACH, **sizes: int) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id that links reach."""
    signed = written(fingerprints(docs, key, text, words), "fingerprints")
    nodes = written(signed.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    joined = written(links(nodes, reach, **sizes), "links")
    roots = components(joined)
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return signed.join(classes, "fp").select("id", "fp", "component_id")
