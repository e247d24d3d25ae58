"""Deterministic sharded WARC archives.

Rows are range-sorted by key, payload digest and url digest; shards are cut at multiples of the running
bytes in that order, so one key or the null keys may fill many. Each shard is rolled into files by compressed
size, every record is its own gzip member with headers and digests made anew, and files
are written under temporary names and committed through a manifest. The same rows and
settings give the same files, byte for byte, however the input was partitioned.

Of rows with equal payloads of at least ``min_revisit`` bytes, the one with the smallest key
is a response and the others revisit it. Rows that repeat key and payload are all
responses. Null payloads are empty, null keys sort first (among them, the payload's digest
decides) and are archived as ``-``; null urls are ``urn:none``. An empty table gives an empty
manifest. Files go to a folder that all executors share, by pyarrow's file systems.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.llm.common import written
from truegauge.operators.ordered import running
from truegauge.session import ship_package

#: Bytes of a shard before compression; shards are what tasks write.
SHARD_BYTES = 16 << 20
#: Shards are made larger rather than more than this, so that their first codes (49 bytes each) can go to all tasks.
MOST_SHARDS = 100_000
#: What a record takes besides its payload.
HEAD_BYTES = 512
#: Compressed bytes after which a file is closed.
FILE_BYTES = 16 << 20
#: Tasks that read archives, each one or more files.
READ_TASKS = 20_000
#: Archives carry no clock time, so that they can be made again.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = ("name string, temporary string, records bigint, bytes bigint, sha256 string, "
            "first_key bigint, last_key bigint")


def _digest(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def digested(rows: DataFrame, payload: str) -> DataFrame:
    """``rows`` with the payload's SHA-1 and its bytes."""
    whole = F.coalesce(F.col(payload), F.lit(""))
    return rows.withColumn("__sha1", F.sha1(whole.cast("binary"))).withColumn(
        "__bytes", F.octet_length(whole).cast("bigint"))


def revisits(full: DataFrame, key: str, min_revisit: int = 0) -> DataFrame:
    """(key, sha1, code, refers) of the rows that revisit another; payloads don't travel.

    Nothing is grouped after the join, so that a payload of very many rows can be split.
    """
    narrow = full.where(F.col(key).isNotNull() & (F.col("__bytes") >= min_revisit)).select(
        F.col(key).alias("__key"), F.col("__sha1").alias("__digest"), "code")
    firsts = narrow.groupBy(F.col("__digest").alias("__d")).agg(F.min("__key").alias("__refers"))
    return narrow.join(firsts, narrow["__digest"] == firsts["__d"]).where(
        F.col("__key") != F.col("__refers")).drop("__d")


def order_code(key: str, url: str) -> Column:
    """49 bytes that sort as (key with nulls first, payload digest, digest of the url) do."""
    number = F.lpad(F.hex(F.col(key).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.coalesce(F.concat(F.lit("01"), number), F.lit("00" * 9)), "__sha1",
                            F.coalesce(F.sha1(F.col(url).cast("binary")), F.lit("00" * 20))))


def whole(number: Column, divisor: Column) -> Column:
    """Integer division, down."""
    return ((number - F.pmod(number, divisor)) / divisor).cast("bigint")


def planned(cells: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``cells(code, copies, size)`` with the bytes before each in order, and the bytes of a shard.

    Chunks of the order are Spark's ranges; a running sum joins them, so neither one key nor the
    nulls have to fit a task. Shards grow beyond ``shard_bytes`` only to be ``MOST_SHARDS`` at most.
    """
    ranged = written(cells.repartitionByRange("code").withColumn("chunk", F.spark_partition_id()), "cells")
    weight = F.col("copies") * F.col("size")
    total = ranged.agg(F.sum(weight.cast("decimal(38,0)"))).head()[0] or 0
    placed = running(ranged, [], ["code"], F.col("chunk"), {"before": ("sum", weight)}, inclusive=False)
    return placed.drop("chunk"), max(shard_bytes, -(-int(total) // MOST_SHARDS))


def _member(kind: str, key: str, url: str, sha1: str, size: int, refers: int | None,
            payload: bytes, page_date: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {page_date}",
            f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Payload-Digest: sha1:{sha1}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    # No name and no time in the member's header, or the same record would differ.
    return gzip.compress(record, 6, mtime=0)


class _Files:
    """Writes members into rolled files under temporary names."""

    def __init__(self, folder: str, file_bytes: int) -> None:
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.system.create_dir(self.temporary, recursive=True)
        self.file_bytes, self.shard, self.part, self.out = file_bytes, None, 0, None
        self.done: list[dict] = []

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.entry["sha256"] = self.hash.hexdigest()
            self.done.append(self.entry)
            self.out = None

    def add(self, shard: int, key: int | None, member: bytes) -> None:
        if shard != self.shard:
            self._close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.entry["bytes"] + len(member) > self.file_bytes:
            self._close()
            self.part += 1
        if self.out is None:
            name = f"part-{shard:06d}-{self.part:05d}.warc.gz"
            self.entry = {"name": name, "temporary": f"{self.temporary.removeprefix(self.root)}/{name}",
                          "records": 0, "bytes": 0, "first_key": key, "last_key": key}
            self.hash, self.out = hashlib.sha256(), self.system.open_output_stream(
                f"{self.temporary}/{name}", compression=None)
        self.out.write(member)
        self.hash.update(member)
        self.entry["records"] += 1
        self.entry["bytes"] += len(member)
        self.entry["last_key"] = key

    def finish(self) -> list[dict]:
        self._close()
        return self.done


def write_archive(rows: DataFrame, folder: str, key: str = "page_id", url: str = "url",
                  payload: str = "html", *, min_revisit: int = 0, shard_bytes: int = SHARD_BYTES,
                  file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write the archive below ``folder``; returns its manifest.

    A task's files count only if its manifest rows were committed, so a lost or repeated task
    leaves nothing but files under temporary names. Renaming them may be repeated.
    """
    spark = rows.sparkSession
    ship_package(spark)
    plain = rows.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"),
                        F.col(payload).alias("payload"))
    sized = digested(plain, "payload").withColumn("__size", F.col("__bytes") + HEAD_BYTES)
    ordered = sized.withColumn("code", order_code("key", "url"))
    cells, step = planned(ordered.groupBy("code").agg(
        F.count(F.lit(1)).alias("copies"), F.max("__size").alias("size")), shard_bytes)
    cells = written(cells, "cells")
    # Rows that repeat key, payload and url give one record; where they outweigh a shard, it is sent once and counted.
    heavy = written(cells.where((F.col("copies") > 1) & (F.col("copies") * F.col("size") > step)), "heavy")
    shard = whole(F.col("before"), F.lit(step))
    last = whole(F.col("before") + F.col("copies") * F.col("size") - 1, F.lit(step))
    begun = cells.groupBy(shard.alias("shard")).agg(F.min("code").alias("code")).select(
        "code", "shard", F.col("shard").alias("last"))
    begun = {bytes(r["code"]): (r["shard"], r["last"]) for r in begun.union(
        heavy.select("code", shard, last)).collect()}  # at most MOST_SHARDS of each
    shards = 1 + max((r[1] for r in begun.values()), default=0)
    codes = sorted(begun)
    starts = spark.sparkContext.broadcast((np.array(codes, "S49"), np.array(
        [begun[c] for c in codes], np.int32).reshape(-1, 2)))

    def place(side: int):
        @F.pandas_udf("int")
        def run(codes: pd.Series) -> pd.Series:
            first, number = starts.value
            found = np.searchsorted(first, np.array(codes.tolist(), "S49"), "right") - 1
            return pd.Series(number[np.maximum(found, 0), side])
        return run

    plain, some_heavy = ordered, not heavy.isEmpty()
    if some_heavy:
        plain = ordered.join(heavy.select("code"), "code", "left_anti")
        # Copy i begins at before + i * size: so many copies begin before a shard's end.
        upto = lambda n: F.least("copies", F.greatest(F.lit(0), whole(
            n * step - F.col("before") + F.col("size") - 1, F.col("size"))))
        counted = ordered.join(heavy.select("code"), "code", "left_semi").groupBy("code").agg(
            *[F.any_value(c).alias(c) for c in ordered.columns if c != "code"]).join(heavy, "code").withColumn(
            "shard", F.explode(F.sequence(shard, last))).withColumn(
            "copies", (upto(F.col("shard") + 1) - upto(F.col("shard"))).cast("bigint")).withColumn(
            "shard", F.col("shard").cast("int")).drop("before", "size")
    plain = plain.withColumns({"copies": F.lit(1).cast("bigint"), "shard": place(0)("code")})
    if some_heavy:
        plain = plain.unionByName(counted.where("copies > 0"))
    # Payloads are dealt once, by shard. A mark goes ahead of the rows that revisit another, to every shard that has some.
    start = F.expr("substring(code, 1, 29)")
    edge = lambda byte: F.concat(start, F.unhex(F.lit(byte * 20)))
    marks = revisits(ordered, "key", min_revisit).withColumn(
        "shard", F.explode(F.sequence(place(0)(edge("00")), place(1)(edge("FF"))))).select(
        F.col("__key").alias("key"), F.col("__digest").alias("__sha1"), "__refers", "shard",
        edge("00").alias("code"))
    dealt = plain.unionByName(marks, allowMissingColumns=True).repartitionById(shards, "shard").sortWithinPartitions(
        "shard", "code", F.col("__refers").asc_nulls_last())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, marked, target = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                k, link, text, sha1, size, refers, own, copies = (column[row].as_py() for column in batch.columns)
                if refers is not None:
                    marked, target = (k, sha1), refers
                    continue
                refers = target if marked == (k, sha1) else None
                files = files or _Files(folder, file_bytes)
                member = _member(
                    "response" if refers is None else "revisit", "-" if k is None else str(k),
                    "".join((link or "urn:none").split()), _digest(sha1), size, refers,
                    b"" if refers is not None else (text or "").encode(), date)
                for _ in range(copies):
                    files.add(own, k, member)
        if files is not None:
            found = files.finish()
            names = ["name", "temporary", "records", "bytes", "sha256", "first_key", "last_key"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[n] for x in found], t) for n, t in zip(names, kinds)], names=names)

    entries = written(dealt.select("key", "url", "payload", "__sha1", "__bytes", "__refers", "shard", "copies")
                      .mapInArrow(write, MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch["name"].to_pylist(), batch["temporary"].to_pylist()):
                if system.get_file_info(f"{root}{temporary}").type == fs.FileType.File:
                    system.move(f"{root}{temporary}", f"{root}/{name}")
            yield batch

    manifest = entries.mapInArrow(commit, MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").drop("temporary")


RECORDS = ("key bigint, record_type string, target string, payload_bytes bigint, payload_digest string, "
           "refers_to bigint, payload binary, intact boolean, file string")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after another, never the whole file at once."""
    machine, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 16)
        if not data:
            return
        parts.append(machine.decompress(data))
        data = b""
        if machine.eof:
            yield b"".join(parts)
            data, parts = machine.unused_data, []
            machine = zlib.decompressobj(31)


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    base32 = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    intact = (fields["WARC-Block-Digest"] == "sha1:" + base32(block) and rest[len(block):] == b"\r\n\r\n"
              and (fields["WARC-Type"] == "revisit" or digest == base32(payload)))
    number = lambda name: (None if name is None or name == "<urn:page:->"
                           else int(name.removeprefix("<urn:page:").rstrip(">")))
    return {"key": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
            "target": fields["WARC-Target-URI"], "payload_bytes": int(inner["Content-Length"]),
            "payload_digest": digest, "refers_to": number(fields.get("WARC-Refers-To")),
            "payload": payload if fields["WARC-Type"] == "response" else None, "intact": intact}


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the files that the manifest names; digests are checked (``intact``)."""
    ship_package(spark)
    named = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("name")
    # A given number keeps tasks apart whose names are small and whose files are not.
    files = named.repartition(max(1, min(named.count(), READ_TASKS)), "name")
    schema = pa.schema([("key", pa.int64()), ("record_type", pa.string()), ("target", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()),
                        ("file", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        rows.append(parse_record(record) | {"file": name})
                        if not with_payload:
                            rows[-1]["payload"] = None
                        held += len(record) if with_payload else 200
                        if held > 1 << 21:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(read, RECORDS)
