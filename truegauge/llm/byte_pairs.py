"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is
itself a token. Tier two: a pre-token outside the vocabulary is merged with a heap of pair
ranks over linked bytes, in O(n log n) also for very long ones. The ids equal those of a
rank-file encoder without special tokens.

Null texts are empty: no ids, no bytes. Every text is encoded whole; vocabulary
and pattern are parameters.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm import tokens
from truegauge.session import ship_package

# Fixed value: the characters with the Unicode property White_Space.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-tokens a worker remembers: about 120 MB.
_MEMO = 1 << 19
_PIECE = 1 << 21


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token, rank per line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        table[int(rank)] = base64.b64decode(token)
    return table


def split_pattern(pattern: str) -> regex.Pattern:
    r"""The pre-token pattern with \s spelt out as White_Space, which engines define apart."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]")
                         .replace(r"\s", f"[{_WHITE}]"))


class PerfectHash:
    """Minimal perfect hash of byte strings by hashing and displacing.

    A key's first hash names its group, the group's displacement gives the slot; there are
    as many slots as keys. Large groups choose first. A slot keeps its key's value, and a look-up compares the key.
    """

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        self.slots = n = len(keys)
        self.groups = max(1, n // 4)
        members: list[list[int]] = [[] for _ in range(self.groups)]
        hashes = [xxhash.xxh3_64_intdigest(key) for key in keys]
        for i, h in enumerate(hashes):
            members[h % self.groups].append(i)
        self.shift = [0] * self.groups
        taken = bytearray(n)
        slot_of = [0] * n
        for group in sorted(range(self.groups), key=lambda g: -len(members[g])):
            if len(members[group]) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in members[group]]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[group] = d
            for i, s in zip(members[group], slots):
                taken[s] = 1
                slot_of[i] = s
        # Groups of one key take the slots left over, kept as negative displacements.
        free = (s for s in range(n) if not taken[s])
        for group, own in enumerate(members):
            if len(own) == 1:
                slot_of[own[0]] = s = next(free)
                self.shift[group] = -1 - s
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for i, s in enumerate(slot_of):
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 16) + d * ((h >> 40) | 1) + d * d) % self.slots

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.groups]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else None


def pair_table(table: list[bytes]) -> dict[int, int]:
    """Id of the token that two adjacent tokens make, by left id << 20 | right id."""
    rank = {token: i for i, token in enumerate(table) if token}
    pairs = {}
    for token, i in rank.items():
        for cut in range(1, len(token)):
            a, b = rank.get(token[:cut]), rank.get(token[cut:])
            if a is not None and b is not None:
                pairs[a << 20 | b] = i
    return pairs


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the ids of single bytes: the pair of least rank, leftmost first, until none is left.

    Bytes are a linked list; the heap holds rank * length + place of live and stale pairs.
    """
    n = len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    known = pairs.get
    pair = [known(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
    pair.append(-1)
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    while heap:
        r, i = divmod(heappop(heap), n)
        if pair[i] != r:
            continue
        j = after[i]
        ids[i] = r
        ids[j] = pair[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair[i] = x = known(r << 20 | ids[k], -1)
            if x >= 0:
                heappush(heap, x * n + i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            pair[h] = x = known(ids[h] << 20 | r, -1)
            if x >= 0:
                heappush(heap, x * n + h)
    return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder of one vocabulary; sent to the workers once."""

    def __init__(self, table: list[bytes], pattern: str) -> None:
        self.table, self.pattern = table, pattern
        known = [(token, i) for i, token in enumerate(table) if token]
        self.whole = PerfectHash([t for t, _ in known], [i for _, i in known])

    def prepare(self) -> None:
        """What is made anew in each worker."""
        self.pairs = pair_table(self.table)
        single = {token: i for i, token in enumerate(self.table) if len(token) == 1}
        self.bytes = [single[bytes([b])] for b in range(256)]
        self.find = split_pattern(self.pattern).findall
        self.memo: dict[str, bytes] = {}

    def _piece(self, word: str) -> bytes:
        data = word.encode()
        found = self.whole.get(data)
        if found is not None:
            return found.to_bytes(4, "little")
        ids = merge([self.bytes[b] for b in data], self.pairs)
        return array("I", ids).tobytes() if sys.byteorder == "little" else \
            np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words, memo = self.find(text), self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) > _MEMO:
                # The older half goes; what comes back often returns at once.
                memo = self.memo = dict(islice(memo.items(), _MEMO // 2, None))
                new = set(words).difference(memo)
            for word in new:
                memo[word] = self._piece(word)
        return b"".join([memo[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _share(df: DataFrame, path: str, pattern: str):
    ship_package(df.sparkSession)
    # As large as the vocabulary file, whatever the texts are; workers keep it between tasks.
    return df.sparkSession.sparkContext.broadcast(Codec(load_ranks(path), pattern))


def _added(df: DataFrame, source: str, shared, columns: dict[str, tuple[str, pa.DataType]],
           work: Callable[[Codec, pa.Array], tuple[list, ...]]) -> DataFrame:
    """Add columns that ``work`` makes of ``source``, in pieces of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        if not hasattr(codec, "memo"):
            codec.prepare()
        for batch in batches:
            # The source comes last: names may repeat among the caller's columns.
            for at, piece in tokens.pieces(batch.column(batch.num_columns - 1), _PIECE):
                made = [pa.array(x, kind) for x, (_, kind)
                        in zip(work(codec, piece), columns.values())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(piece)).columns[:-1], *made],
                    names=[f"c{i}" for i in range(batch.num_columns - 1 + len(made))])

    clash = set(columns) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])
    for name, (kind, _) in columns.items():
        schema = schema.add(f"c{len(schema)}", kind)
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    place = df.columns.index(source)
    return numbered.select("*", F.col(f"c{place}").alias("source")).mapInArrow(run, schema).toDF(
        *df.columns, *columns)


def encode(df: DataFrame, text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Add column ``out``: the ids of ``text`` as packed little-endian 32-bit integers."""
    return _added(df, text, _share(df, path, pattern), {out: ("binary", pa.binary())},
                  lambda codec, texts: ([codec.encode(x or "") for x in texts.to_pylist()],))


def decode(df: DataFrame, ids: str, path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Add column ``out``: the bytes that the packed ids stand for."""
    return _added(df, ids, _share(df, path, pattern), {out: ("binary", pa.binary())},
                  lambda codec, packed: ([codec.decode(x or b"") for x in packed.to_pylist()],))


def round_trip(df: DataFrame, text: str, path: str, pattern: str, ids: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded, in one pass.

    ``ids`` names a column for the packed ids themselves.
    """
    def work(codec: Codec, texts: pa.Array) -> tuple[list, ...]:
        n, ids_hex, data_hex, packed = [], [], [], []
        for value in texts.to_pylist():
            coded = codec.encode(value or "")
            n.append(len(coded) // 4)
            ids_hex.append(hashlib.sha256(coded).hexdigest())
            data_hex.append(hashlib.sha256(codec.decode(coded)).hexdigest())
            packed.append(coded if ids else None)
        return (n, ids_hex, data_hex, packed)[:4 if ids else 3]

    columns = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
               "decoded_sha256": ("string", pa.string())}
    if ids:
        columns[ids] = ("binary", pa.binary())
    return _added(df, text, _share(df, path, pattern), columns, work)
