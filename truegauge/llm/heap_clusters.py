"""Lloyd's clustering in exact integers with heap-ordered bounds.

A vector's gap is its distance to the second nearest centroid less that to its own. Moving
centroids shrink a gap by at most the own centroid's move plus the largest move of the others, so a
cluster keeps the sum of these (its drift) and a heap of its vectors by gap plus the drift at the
time of the scan. Only vectors whose entry the drift has reached are popped; they are scanned
exactly and pushed into the heap of their cluster. The others can't have changed sides.

Vectors lie in blocks of up to ``BLOCK`` in numbered rows; each block holds its part of every
cluster's heap. The vectors are dealt to their partitions once and cached; a round sends the heaps
there (12 bytes a vector), writes them back to the shared folder, and sums the blocks' changes of
the clusters' sums. A lost executor costs its blocks' packing, from the input, and one round. The driver
sees clusters x dimensions numbers a round.

Components are floor(scale * x); sums and distances are exact integers. Components beyond 2^26
raise, as a squared distance would not fit a long. Kept are vectors of the wanted length without
null or non-finite components; an empty rest gives an empty result, fewer vectors than clusters give as
many clusters. Rows count one by one: repeated rows and ids stay apart, null ids start no
cluster unless all others do. Ties go to the smaller cluster number. Columns other than key and
vector are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import written
from truegauge.session import ship_package

SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
#: Vectors of a block: about a megabyte at 64 dimensions.
BLOCK = 4096
LARGEST = 1 << 26
#: Gaps count as smaller by this much, so that rounding never keeps a vector that might move.
SAFETY = 1e-6
STATE = ("block bigint, place binary, gap binary, sizes array<int>, changed array<bigint>, counts array<bigint>, "
         "popped bigint")


def finite(vector: str, dimensions: int | None = None) -> Column:
    """Not null, of the wanted length, without null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(whole if dimensions is None else whole & (F.size(x) == dimensions), F.lit(False))


def starts(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The ``clusters`` vectors whose ids have the smallest hashes."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(draw.alias("draw"), "x").orderBy(
        F.col("draw").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        apart = vectors.astype(np.int64) - centroid
        out[:, k] = np.einsum("ij,ij->i", apart, apart)
    return out


def scanned(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and the gap to the second nearest."""
    apart = squared(vectors, centroids)
    own = apart.argmin(axis=1)
    if len(centroids) == 1:
        return own, np.full(len(own), np.inf)
    two = np.sqrt(np.partition(apart, 1, axis=1)[:, :2])
    return own, two[:, 1] - two[:, 0] - SAFETY


class Heaps:
    """One block's part of every cluster's heap of (gap + drift at the scan, place)."""

    def __init__(self, clusters: int) -> None:
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]

    @classmethod
    def unpacked(cls, place: bytes, gap: bytes, sizes: list[int]) -> Heaps:
        self, at = cls(len(sizes)), 0
        pairs = list(zip(np.frombuffer(gap, np.float64).tolist(), np.frombuffer(place, np.int32).tolist()))
        for k, size in enumerate(sizes):
            self.heaps[k] = pairs[at:at + size]  # stored in heap order
            at += size
        return self

    def packed(self) -> dict:
        pairs = [p for heap in self.heaps for p in heap]
        return {"gap": np.array([g for g, _ in pairs], np.float64).tobytes(),
                "place": np.array([p for _, p in pairs], np.int32).tobytes(),
                "sizes": [len(heap) for heap in self.heaps]}

    def expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and old clusters of the vectors whose gap the drift has reached."""
        places, old = [], []
        for k, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[k]:
                places.append(heapq.heappop(heap)[1])
                old.append(k)
        return np.array(places, np.int64), np.array(old, np.int64)

    def push(self, places: np.ndarray, own: np.ndarray, keys: np.ndarray) -> None:
        for place, k, key in zip(places.tolist(), own.tolist(), keys.tolist()):
            heapq.heappush(self.heaps[k], (key, place))


def sums(vectors: np.ndarray, own: np.ndarray, clusters: int) -> np.ndarray:
    out = np.zeros((clusters, vectors.shape[1]), np.int64)
    np.add.at(out, own, vectors)
    return out


def packed_blocks(kept: DataFrame, dimensions: int, block: int) -> DataFrame:
    """(block, ids, vectors): each partition's rows in numbered blocks, dealt by their number and cached."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                ids, x = batch.column(0).slice(at, block), batch.column(1).slice(at, block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids),
                     pa.array([x.flatten().to_numpy().astype(np.int32).tobytes()], pa.binary())],
                    names=["block", "ids", "vectors"])
                number += 1

    kind = kept.schema["id"].dataType.simpleString()
    made = written(kept.mapInArrow(pack, f"block bigint, ids array<{kind}>, vectors binary"), "blocks")
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made.repartition(parts, "block").persist()


def first_round(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    clusters, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, dimensions)
                own, gap = scanned(vectors, centroids)
                heaps = Heaps(clusters)
                heaps.push(np.arange(len(own)), own, gap)
                yield state(row["block"], heaps, sums(vectors, own, clusters),
                            np.bincount(own, minlength=clusters), len(own))

    return blocks.select("block", "vectors").mapInArrow(run, STATE)


def state(block: int, heaps: Heaps, changed: np.ndarray, counts: np.ndarray, popped: int) -> pa.RecordBatch:
    one = {"block": block, **heaps.packed(), "changed": changed.ravel().tolist(), "counts": counts.tolist(),
           "popped": popped}
    schema = pa.schema([("block", pa.int64()), ("place", pa.binary()), ("gap", pa.binary()),
                        ("sizes", pa.list_(pa.int32())), ("changed", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64())), ("popped", pa.int64())])
    return pa.RecordBatch.from_pylist([one], schema)


def next_round(blocks: DataFrame, before: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Pop what the drift has reached, scan it exactly, push it again."""
    clusters, dimensions = centroids.shape

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left["block"][0].as_py()
        vectors = np.frombuffer(left["vectors"][0].as_py(), np.int32).reshape(-1, dimensions)
        old = right.to_pylist()[0]
        heaps = Heaps.unpacked(old["place"], old["gap"], old["sizes"])
        places, was = heaps.expired(drift)
        own, gap = scanned(vectors[places], centroids)
        heaps.push(places, own, gap + drift[own])
        moved = own != was
        changed = sums(vectors[places[moved]], own[moved], clusters) - sums(vectors[places[moved]], was[moved], clusters)
        counts = np.bincount(own, minlength=clusters) - np.bincount(was, minlength=clusters)
        return pa.Table.from_batches([state(block, heaps, changed, counts, len(places))])

    return blocks.select("block", "vectors").groupBy("block").cogroup(
        before.select("block", "place", "gap", "sizes").groupBy("block")).applyInArrow(run, STATE)


def totals(states: DataFrame, clusters: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Changes of sums and counts over all blocks: clusters x dimensions numbers."""
    each = states.select(F.posexplode(F.concat("changed", "counts", F.array("popped"))).alias("at", "value"))
    found = dict(each.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect())
    values = [int(found[k]) for k in range(len(found))]
    return (np.array(values[:-1 - clusters], object).reshape(clusters, -1), np.array(values[-1 - clusters:-1], object),
            values[-1])


def members(blocks: DataFrame, states: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(id, cluster, distance) of every vector, and its cluster's numbers."""
    dimensions = centroids.shape[1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vectors = np.frombuffer(left["vectors"][0].as_py(), np.int32).reshape(-1, dimensions)
        row = right.to_pylist()[0]
        own = np.empty(len(vectors), np.int64)
        own[np.frombuffer(row["place"], np.int32)] = np.repeat(np.arange(len(row["sizes"])), row["sizes"])
        apart = vectors.astype(np.int64) - centroids[own]
        return pa.table({"id": left["ids"].combine_chunks().flatten(), "cluster": pa.array(own.astype(np.int32)),
                         "distance": np.einsum("ij,ij->i", apart, apart)})

    return blocks.groupBy("block").cogroup(states.select("block", "place", "sizes").groupBy("block")).applyInArrow(
        run, f"id {kind}, cluster int, distance bigint")


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, dimensions: int = DIMENSIONS,
              clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 3, block: int = BLOCK
              ) -> tuple[DataFrame, DataFrame]:
    """Returns (members, centroids).

    ``members``: id, cluster, distance (squared) of every kept vector. ``centroids``: cluster, centroid
    (integers), n, inertia, and ``scans`` per round in one array (how many vectors each round scanned).
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * scale))
    kept = vectors.where(finite(vector, dimensions)).select(F.col(key).alias("id"), x.alias("x"))
    too_large = F.exists("x", lambda v: F.abs(v) > LARGEST)
    kept = kept.withColumn("x", F.when(too_large, F.raise_error(F.lit(
        "components beyond 2^26 have no distance that fits a long"))).otherwise(F.col("x")))
    kind = vectors.schema[key].dataType.simpleString()
    centroids = starts(kept, clusters, seed)
    about = "cluster int, centroid array<bigint>, n bigint, inertia bigint, scans array<bigint>"
    if not len(centroids):
        return (spark.createDataFrame([], f"id {kind}, cluster int, distance bigint"),
                spark.createDataFrame([], about))
    blocks = packed_blocks(kept, dimensions, block)
    drift = np.zeros(len(centroids))
    states = written(first_round(blocks, centroids), "heaps")
    total, count, popped = totals(states, len(centroids))
    scans = [popped]
    for _ in range(rounds):
        moved = np.array([[int(s) // int(n) for s in sums_] if n else old.tolist()
                          for sums_, n, old in zip(total, count, centroids)], np.int64)
        step = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1))
        others = [np.delete(step, k).max(initial=0.0) for k in range(len(step))]
        drift, centroids = drift + (step + others) * (1 + 1e-12), moved
        states = written(next_round(blocks, states, centroids, drift), "heaps")
        more, fewer, popped = totals(states, len(centroids))
        total, count = total + more, count + fewer
        scans.append(popped)
    found = written(members(blocks, states, centroids, kind), "members")
    blocks.unpersist()
    inertia = {r["cluster"]: (r["n"], r["inertia"]) for r in found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia")).collect()}
    rows = [(k, c.tolist(), *inertia.get(k, (0, 0)), scans) for k, c in enumerate(centroids)]
    return found, spark.createDataFrame(rows, about)


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
