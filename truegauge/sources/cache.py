"""Content-addressed cache of per-session results."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge import PREPROC_VERSION
from truegauge.functions.hashing import hash_bucket
from truegauge.sources import runs

#: Partitions of a run's data by key; a hit lists and reads only those of its keys.
BUCKETS = 64
INDEX = "cache_key string, run string"


def config_hash(spark: SparkSession, config: Mapping[str, object]) -> str:
    """sha256 of the canonical JSON of a configuration."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return spark.range(1).select(F.sha2(F.lit(text), 256)).head()[0]


def cache_keys(sessions: DataFrame, config: Mapping[str, object],
               version: str = PREPROC_VERSION) -> DataFrame:
    """``cache_key`` per session over (eid, version, configuration)."""
    digest = config_hash(sessions.sparkSession, config)
    text = F.concat_ws("|", F.col("eid").cast("string"), F.lit(version), F.lit(digest))
    return sessions.select("eid", F.sha2(text, 256).alias("cache_key"))


def cached(sessions: DataFrame, compute: Callable[[DataFrame], DataFrame], root: str,
           config: Mapping[str, object], version: str = PREPROC_VERSION) -> DataFrame:
    """Results for all ``sessions(eid)``, computing only the ones not stored yet.

    ``compute`` gets the missing sessions. A run writes its data first and its index last, each
    in a folder of its own, so an interrupted run is repeated, not half trusted. Where runs
    at the same time stored one key, the run with the smallest id counts for it. Rows are
    read through run and session bucket, both partitions of the data.
    """
    spark = sessions.sparkSession
    wanted = cache_keys(sessions, config, version).withColumn(
        "session_bucket", hash_bucket(BUCKETS, "cache_key"))
    index = runs.existing(spark, f"{root}/index", schema=INDEX)
    missing = wanted if index is None else wanted.join(index, "cache_key", "left_anti")
    if not missing.isEmpty():
        run = runs.new_run()
        fresh = compute(missing.select("eid")).join(missing, "eid")
        fresh.write.partitionBy("session_bucket").parquet(runs.run_folder(f"{root}/data", run))
        missing.select("cache_key").write.parquet(runs.run_folder(f"{root}/index", run))
    return stored(spark, wanted, root)


def stored(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """Rows of the wanted keys (cache_key, session_bucket), each from the one run that counts."""
    index = spark.read.schema(INDEX).parquet(f"{root}/index")
    live = (index.join(wanted.select("cache_key", "session_bucket"), "cache_key")
            .groupBy("cache_key").agg(F.min("run").alias("run"), F.min("session_bucket").alias("session_bucket")))
    # BUCKETS values at most, so that the scan lists only their folders.
    buckets = sorted(r[0] for r in live.select("session_bucket").distinct().collect())
    data = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data").where(
        F.col("session_bucket").isin(buckets))
    return data.join(live.select("cache_key", "run"), ["cache_key", "run"], "left_semi").drop(
        "cache_key", "run", "session_bucket")
