"""Folders that several writers may fill at once: each run writes its own, one of them counts.

A run is a subfolder ``run=<id>`` that Spark's committer completes with ``_SUCCESS``. Nobody appends
to a folder that another run writes, so writers can't disturb one another, and unfinished
runs are invisible. Readers decide which run counts, by the smallest id.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_run() -> str:
    return uuid.uuid4().hex


def run_folder(root: str, run: str) -> str:
    return f"{root}/run={run}"


def existing(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame | None:
    """The table at ``path``; None only if there is no such path."""
    reader = spark.read.format(form)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit(spark: SparkSession, root: str, run: str, record: Mapping[str, object]) -> None:
    """Make a run visible: its record is written last."""
    text = json.dumps(record, sort_keys=True, separators=(",", ":"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(run_folder(root, run))


def winner(spark: SparkSession, root: str) -> tuple[str, dict] | None:
    """Run and record of the committed run that counts."""
    found = existing(spark, root, "text", "value string, run string")
    first = None if found is None else found.agg(F.min(F.struct("run", "value")).alias("first")).head()["first"]
    return None if first is None else (first["run"], json.loads(first["value"]))


def digest(df: DataFrame, *columns: str) -> str:
    """An order-free digest of a table: the 32-bit words of the rows' digests are summed.

    Doubles are told apart by their shortest text. A null differs from an empty text.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]
    row = F.sha2(F.to_json(F.array(*cells)), 256)
    words = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
             for i in range(8)]
    return df.agg(F.sha2(F.concat_ws("|", *[F.coalesce(w, F.lit("0")) for w in words],
                                     F.count(F.lit(1)).cast("string")), 256).alias("digest")).head()["digest"]
