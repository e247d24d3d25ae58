"""Run artifacts: predictions and uncertainty as parquet, QC and model metadata as JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Fixed artifact names.
PARQUET = ("predictions", "uncertainty")
JSON = ("qc", "model_metadata")


def write_artifacts(artifacts: Mapping[str, DataFrame], root: str) -> None:
    unknown = set(artifacts) - {*PARQUET, *JSON}
    if unknown:
        raise ValueError(f"unknown artifacts {sorted(unknown)}")
    for name, df in artifacts.items():
        if name in PARQUET:
            df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
        else:
            df.write.mode("overwrite").json(f"{root}/{name}.json")


def read_artifact(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    if name in PARQUET:
        return spark.read.parquet(f"{root}/{name}.parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{root}/{name}.json")
