"""Near copies against brute force; BPE against the library it must equal."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from math import log

import public_tokenizers
import pytest
import tiktoken

from tests.conftest import SF_TINY
from tests.llm.conftest import ROWS
from truegauge.llm import byte_pairs, near_copies, queries

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def brute_classes(texts: list[str]) -> list[int]:
    """Class of each text, as the place of its first member."""
    def runs(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1 if w else 0)))

    bags = [runs(t) for t in texts]
    df, n = Counter(g for b in bags for g in b), sum(map(bool, bags))
    weights = [{g: c * min(1.0, log(1 + n / df[g]) / log(4)) for g, c in b.items()} for b in bags]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first: dict = {}
    for i, t in enumerate(texts):
        if t in first:
            root[find(i)] = find(first[t])
        first.setdefault(t, i)
    for j in range(len(texts)):
        for i in range(j):
            if not (bags[i].keys() & bags[j].keys()):
                continue
            a, b = weights[i], weights[j]
            low = sum(min(a[g], b[g]) for g in a.keys() & b.keys())
            if low / (sum(a.values()) + sum(b.values()) - low) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_documents_equal_brute_force(spark):
    docs = queries.read(spark, SF_TINY, "documents").orderBy("doc_id").collect()
    want = brute_classes([d["text"] for d in docs])
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_near_copies(spark, SF_TINY).collect()}
    assert [got[d["doc_id"]] for d in docs] == [docs[i]["doc_id"] for i in want]
    assert len(set(want)) < len(docs)


def test_mixed_bucket_loses_no_link(spark):
    """A chain a ~ b ~ c whose ends are no pair, among texts that share most runs."""
    base = [f"w{i}" for i in range(400)]
    texts = []
    for step in range(12):
        words = list(base)
        for i in range(step * 18, step * 18 + 18):
            words[:i + 1] = [f"s{j}" if j <= i else w for j, w in enumerate(words[:i + 1])]
        texts.append(" ".join(words))
    texts += [" ".join(f"o{k}x{i}" for i in range(400)) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows, _ = near_copies.near_copy_classes(docs, block=8)
    got = {r["id"]: r["class_id"] for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_outlines_rule_out_no_pair(spark):
    """Chains whose links are just over the similarity, with so few samples that many links agree in few of them."""
    texts = []
    for chain in range(10):
        words = [f"w{chain}x{i}" for i in range(400)]
        for step in range(12):
            words[step * 30:step * 30 + 30] = [f"s{chain}x{step}x{i}" for i in range(30)]
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows, _ = near_copies.near_copy_classes(docs, rows=1, bands=8, block=8)
    got = {r["id"]: r["class_id"] for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_large_group_holds_together(spark):
    """Two thirds of the rows are near copies of one text and no near copies of each other."""
    base, texts = [f"w{i}" for i in range(300)], []
    for k in range(80):
        words = list(base)
        for j in range(4):
            words[(k * 37 + j * 71) % 300] = f"c{k}x{j}"
        texts.append(" ".join(words))
    texts = texts[:40] + [" ".join(base)] + texts[40:] + [" ".join(f"o{k}x{i}" for i in range(300)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows, _ = near_copies.near_copy_classes(docs)
    got = {r["id"]: r["class_id"] for r in rows.collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_edge_rows(edge, nothing):
    rows, classes = near_copies.near_copy_classes(edge)
    got = rows.collect()
    assert len(got) == len(ROWS)
    by = {r["id"]: r["class_id"] for r in got if r["id"] is not None}
    assert by[5] == by[6] == 5 and by[1] == by[2] == 1 and by[3] == 3 and by[4] == 4
    kept = near_copies.one_per_class(edge)
    assert kept.columns == edge.columns
    assert kept.count() == classes.where("is_first").count()
    assert near_copies.one_per_class(nothing).count() == 0


@pytest.fixture(scope="module")
def codec():
    made = byte_pairs.Codec(byte_pairs.load_ranks(public_tokenizers.path(queries.VOCABULARY)),
                            public_tokenizers.PATTERN)
    made.prepare()
    return made


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    whole = codec.whole
    assert whole.slots == len([t for t in codec.table if t])
    assert sorted(whole.values) == [i for i, t in enumerate(codec.table) if t]
    assert whole.get(codec.table[300]) == 300 and whole.get(b"\xff\xfe not there") is None


def digest(ids: list[int], data: bytes) -> tuple:
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(data).hexdigest()


def test_byte_pairs_equal_the_library(spark, library):
    docs = queries.read(spark, SF_TINY, "documents").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_byte_pairs(spark, SF_TINY).collect()}
    for d in docs:
        assert got[d["doc_id"]] == digest(library.encode_ordinary(d["text"]), d["text"].encode())


def test_byte_pairs_of_edge_rows(edge, nothing, library):
    path, pattern = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
    out = byte_pairs.round_trip(edge, "text", path, pattern)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    assert got == Counter((r[0], *digest(library.encode_ordinary(r[1] or ""), (r[1] or "").encode()))
                          for r in ROWS)
    assert byte_pairs.round_trip(nothing, "text", path, pattern).count() == 0
    back = byte_pairs.decode(byte_pairs.encode(edge, "text", path, pattern), "ids", path, pattern)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "\r\n   x\x1c\x85 ", "it's WE'LL", "日本語" * 300])
def test_heap_merges(codec, library, text):
    ids = codec.encode(text)
    assert [int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)] == library.encode_ordinary(text)
