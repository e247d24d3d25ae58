"""What the operators share: written tables in the shared folder and native column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.session import shared_folder

#: The six ASCII white-space characters that part words.
SPACES = " \t\n\x0b\x0c\r"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs no rework."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where it is used in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; ``lower`` is enough where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, stop, text>>, in code points.

    Offsets follow from the lengths of the pieces between matches, so it stays native SQL.
    The pattern must not match the empty string.
    """
    def place(pieces: Column, matches: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<struct<start:int,stop:int,text:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            found = F.get(matches, i)
            begin = acc["at"] + F.length(F.get(pieces, i))
            end = begin + F.length(found)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                begin.alias("start"), end.alias("stop"), found.alias("text")))).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step)["out"]

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,stop:int,text:string>>")
    return let(matches, lambda m: F.when(F.size(m) == 0, empty).otherwise(
        let(F.split(text, pattern, -1), lambda p: place(p, m))))
