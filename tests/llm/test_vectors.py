"""SimHash, heap-ordered clustering and whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tests.conftest import SF_TINY
from tests.llm.conftest import ROWS
from truegauge.llm import heap_clusters, queries, simhash, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text: str | None, k: int = 3) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int], ids: list, reach: int = 3) -> list:
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= reach:
            root[find(i)] = find(j)
    least: dict = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [least.get(find(i)) for i in range(len(fps))]


def simhash_rows(texts: list[tuple]) -> list[tuple]:
    fps = [brute_fingerprint(text) for _, text in texts]
    found = brute_components(fps, [own for own, _ in texts])
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((own, f"{fp:016x}", c) for (own, _), fp, c in zip(texts, fps, found)), key=order)


def told(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_simhash_equals_brute_force(spark):
    docs = queries.read(spark, SF_TINY, "documents").collect()
    want = simhash_rows([(d["doc_id"], d["text"]) for d in docs])
    got = told(queries.op11_simhash(spark, SF_TINY))
    assert got == want
    assert len({c for _, _, c in want}) < len(want)


def test_simhash_edge_rows(spark, edge, nothing, monkeypatch):
    """Nulls, blanks and long texts (also across segments), repeated rows and ids, clashing columns, no rows."""
    monkeypatch.setattr(simhash, "_SEGMENT", 50)
    long = next(r[1] for r in ROWS if r[1] and len(r[1]) > 50_000)[:5000]
    for text in (long, long + " tail", "a b C\x0bd", "x" * 300, "One two", "  one  "):
        data = simhash.fingerprint(text.encode()) & (1 << 64) - 1
        assert data == brute_fingerprint(text), text[:20]
    clashing = edge.selectExpr("doc_id", "text", "lang AS fp", "source AS id", "n_chars AS component_id")
    got = simhash.near_copies(clashing).selectExpr("id", "lower(lpad(hex(fp), 16, '0'))", "component_id")
    assert told(got) == simhash_rows([(r[0], r[1]) for r in ROWS])
    assert simhash.near_copies(nothing).collect() == []
    only = simhash.near_copies(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id bigint, text string"))
    assert [r["component_id"] for r in only.collect()] == [None, None]


@pytest.mark.parametrize("sizes", [{}, {"homes": 7, "visitors": 50}])
def test_links_lose_no_pair(spark, sizes):
    """Chains and dense clusters of fingerprints, in one block an anchor and in many."""
    draw = np.random.default_rng(2)
    fps = [int(x) for x in draw.integers(0, 1 << 64, 300, dtype=np.uint64)]
    for start in fps[:20]:
        for _ in range(12):  # each three bits from the last one
            start ^= sum(1 << int(b) for b in draw.choice(64, 3, replace=False))
            fps.append(start)
    middle = fps[50]
    fps += [middle ^ sum(1 << int(b) for b in draw.choice(64, 5, replace=False)) for _ in range(400)]
    fps = sorted(set(fps))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    nodes = spark.createDataFrame(signed, "fp bigint").repartition(5)
    joined = simhash.links(nodes, **sizes).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3 for r in joined)
    mask = (1 << 64) - 1
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in joined:
        root[find(r["a"] & mask)] = find(r["b"] & mask)
    parts: dict = {}
    for x in fps:
        parts.setdefault(find(x), []).append(x)
    want: dict = {}
    for x, c in zip(fps, brute_components(fps, fps)):
        want.setdefault(c, []).append(x)
    assert sorted(parts.values()) == sorted(want.values())


@pytest.mark.parametrize("bits", [6, 9, 12])
def test_anchors_are_all_within_reach_of_the_nearest(bits):
    anchors = simhash.Anchors(bits)
    assert len(np.unique(anchors.words)) == 1 << bits
    fps = np.random.default_rng(bits).integers(0, 1 << 64, 5, dtype=np.uint64)
    found: dict = {}
    for row, anchor, nearest, home in anchors.around(fps, 3):
        for r, a, n, h in zip(row, anchor, nearest, home):
            found.setdefault(int(r), []).append((int(a), int(n), bool(h)))
    low = np.arange(1 << bits)
    for k, fp in enumerate(fps):
        apart = np.bitwise_count(anchors.words[low] ^ np.uint32(fp & np.uint64(0xFFFFFFFF)))[None, :].astype(int) + \
            np.bitwise_count(anchors.words[low] ^ np.uint32(fp >> np.uint64(32)))[:, None]
        flat = apart.ravel()
        assert sorted(a for a, _, _ in found[k]) == np.flatnonzero(flat <= flat.min() + 3).tolist()
        assert {n for _, n, _ in found[k]} == {flat.min()}
        assert [a for a, _, h in found[k] if h] == [int(flat.argmin())]


def brute_clusters(rows: list[tuple], dimensions: int, clusters: int = 8, rounds: int = 10):
    kept = [(own, [math.floor(1024 * x) for x in v]) for own, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=draw)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k)) for _, v in kept]
        if step < rounds:
            for k in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, own) if o == k]
                if mine:
                    centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, o, far(v, centroids[o])) for (i, v), o in zip(kept, own)], centroids


def vector_rows(n: int, dimensions: int, groups: int = 5) -> list[tuple]:
    draw = np.random.default_rng(n)
    middle = draw.normal(0, 1, (groups, dimensions))
    return [(i, (middle[i % groups] + draw.normal(0, 0.3, dimensions)).tolist()) for i in range(n)]


BAD = [(900, None), (901, [1.0]), (902, [math.nan] * 4), (903, [1.0, None, 2.0, 3.0]), (904, [math.inf, 0.0, 0.0, 0.0]),
       (905, [])]
VECTORS = "vec_id bigint, embedding array<double>"


def test_heap_clusters_equal_brute_force(spark):
    rows = vector_rows(500, 4) + BAD
    rows += [(None, [0.1, 0.2, 0.3, 0.4])] * 3 + [rows[7]] * 20 + [(i, [0.0] * 4) for i in range(1000, 1030)]
    frame = spark.createDataFrame(rows, VECTORS).withColumnRenamed("embedding", "x").selectExpr(
        "vec_id", "x AS embedding", "1 AS id", "2 AS block", "3 AS x").repartition(7)
    want, centroids = brute_clusters(rows, 4)
    for block in (4096, 16):
        members, about = heap_clusters.clustered(frame, dimensions=4, block=block)
        order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        assert sorted((tuple(r) for r in members.collect()), key=order) == sorted(want, key=order)
        found = about.orderBy("cluster").collect()
        assert [r["centroid"] for r in found] == centroids
        assert sum(r["inertia"] for r in found) == sum(r[2] for r in want)
        scans = found[0]["scans"]
        assert scans[0] == len(want) and scans[-1] < len(want) / 2  # the bounds do spare scans


def test_heap_clusters_of_few_or_no_rows(spark):
    none, about = heap_clusters.clustered(spark.createDataFrame(BAD, VECTORS), dimensions=4)
    assert none.count() == 0 and about.count() == 0
    rows = [(1, [0.5] * 4), (2, [-3.5] * 4), (2, [-3.5] * 4)]
    members, about = heap_clusters.clustered(spark.createDataFrame(rows, VECTORS), dimensions=4)
    assert sorted(map(tuple, members.collect())) == sorted(brute_clusters(rows, 4)[0])
    one, _ = heap_clusters.clustered(spark.createDataFrame(rows[:1], VECTORS), dimensions=4)
    assert list(map(tuple, one.collect())) == [(1, 0, 0)]
    with pytest.raises(Exception, match="fits a long"):
        heap_clusters.clustered(spark.createDataFrame([(1, [1e9] * 4)], VECTORS), dimensions=4)


def whitening_of(rows, dimensions):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], np.int64)
    middle = x.astype(np.longdouble).mean(axis=0)
    centred = (x - middle).astype(np.float64)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return kept, x, centred, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("dimensions, n", [(4, 60), (40, 700), (64, 200)])
def test_whitening_equals_library(spark, dimensions, n):
    rows = vector_rows(n, dimensions, 6) + [(i, v) for i, v in BAD if v is None or len(v) == 0]
    rows += [(None, rows[3][1]), rows[4]]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("vec_id", "embedding", "1 AS id", "2 AS x").repartition(5)
    model = whitening.fit(frame)
    kept, x, centred, values, vectors = whitening_of(rows, dimensions)
    m = min(32, dimensions)
    assert model.n == len(kept) and len(model.values) == m
    assert np.allclose(model.values, values[:m], rtol=1e-9)
    assert np.allclose(np.abs((model.vectors * vectors[:, :m]).sum(axis=0)), 1, atol=1e-7)
    assert model.identity_error < 1e-9
    got: dict = {}
    for r in whitening.whitened(frame, model).collect():
        got.setdefault((r["id"] is None, r["id"] or 0, r["deviation"]), {})[r["component"]] = r["whitened"]
    sums = x.sum(axis=0)
    for (i, _), row, c in zip(kept, x, centred):
        dev = sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
        found = got[(i is None, i or 0, dev)]
        want = c @ vectors[:, :m] / np.sqrt(values[:m])
        assert np.allclose(np.abs([found[k + 1] for k in range(m)]), np.abs(want), atol=1e-6)


def test_whitening_without_rows_or_spread(spark):
    assert whitening.fit(spark.createDataFrame([], VECTORS)) is None
    same = spark.createDataFrame([(1, [0.5] * 4)] * 3, VECTORS)
    assert whitening.whitened(same, whitening.fit(same)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i, float(i % 3)]) for i in range(30)], VECTORS)
    model = whitening.fit(flat)  # one constant and one dependent dimension
    assert len(model.values) == 2 and model.identity_error < 1e-9
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS))


@pytest.mark.parametrize("name", ["random", "diagonal", "equal", "clustered", "glued", "low rank", "tiny", "one"])
def test_eigenpairs(name):
    draw = np.random.default_rng(4)
    n = 40
    basis = np.linalg.qr(draw.normal(size=(n, n)))[0]
    spectra = {"random": np.sort(draw.uniform(0, 9, n)), "equal": np.repeat([1.0, 5.0, 7.0, 8.0], 10),
               "clustered": np.concatenate((1 + 1e-9 * np.arange(20), 2 + 1e-13 * np.arange(20))),
               "low rank": np.concatenate((np.zeros(35), [1.0, 1.0, 3.0, 3.0, 9.0])), "tiny": 1e-200 * np.arange(1, n + 1)}
    if name == "diagonal":
        matrix = np.diag(np.repeat([3.0, 1.0, 2.0, 3.0], 10))
    elif name == "glued":
        block = np.diag([10.0 - i for i in range(10)]) + np.diag(np.ones(9), 1) + np.diag(np.ones(9), -1)
        matrix = np.kron(np.eye(4), block)
    elif name == "one":
        matrix = np.array([[2.5]])
    else:
        matrix = basis * spectra[name] @ basis.T
        matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_components(matrix, 32)
    want = np.linalg.eigvalsh(matrix)[::-1][:len(values)]
    size = np.abs(want).max()
    assert np.allclose(values, want, atol=1e-13 * size, rtol=0)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * size * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
