"""Session tables on disk, the manifest, and loading one session of a backend."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truegauge.functions.hashing import hash_bucket
from truegauge.sources.schemas import SCHEMAS

BUCKETS = 1024


@dataclass(frozen=True)
class Session:
    """Lazy tables of one session; ``available`` says which of them hold rows."""

    eid: int | str
    spikes: DataFrame
    units: DataFrame
    trials: DataFrame
    behaviour: DataFrame
    available: DataFrame


def write_tables(tables: Mapping[str, DataFrame], root: str, backend: str,
                 buckets: int = BUCKETS) -> None:
    """Parquet per table, partitioned by a hash bucket of the session.

    Buckets keep the number of folders fixed however many sessions there are. The
    rebalance hint gathers a bucket for few files but lets Spark split one that a very
    long session makes too large; rows are sorted for row-group pruning by eid.
    """
    for name, df in tables.items():
        (df.withColumn("session_bucket", hash_bucket(buckets, "eid").cast("int"))
         .hint("rebalance", "session_bucket")
         .sortWithinPartitions("session_bucket", "eid")
         .write.mode("overwrite").partitionBy("session_bucket").parquet(f"{root}/{backend}/{name}"))


def read_table(spark: SparkSession, root: str, backend: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{backend}/{name}")


def load_session(spark: SparkSession, root: str, eid: int | str, backend: str,
                 buckets: int = BUCKETS) -> Session:
    """One session by partition pruning on its bucket and row-group pruning on eid."""
    bucket = spark.range(1).select(hash_bucket(buckets, F.lit(eid))).head()[0]
    found = {}
    for name in ("spikes", "units", "trials", "behaviour"):
        rows = read_table(spark, root, backend, name)
        found[name] = rows.where((F.col("session_bucket") == bucket)
                                 & (F.col("eid") == eid)).drop("session_bucket")
    return session_of(found, eid)


def session_of(tables: Mapping[str, DataFrame], eid: int | str) -> Session:
    """The same bundle from tables that are already loaded."""
    found = {n: df.where(F.col("eid") == eid) for n, df in tables.items()}
    return Session(eid, found["spikes"], found["units"], found["trials"], found["behaviour"],
                   capabilities(found))


def capabilities(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and whether the capability is present, with a reason if not."""
    parts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("capability"), *_present())
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _present() -> list[Column]:
    return [F.col("n_rows"), (F.col("n_rows") > 0).alias("present"), F.when(F.col("n_rows") == 0, "no rows").alias("reason")]


def session_capabilities(sessions: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``capabilities`` of every session: a row per session and table, from one grouped count per table."""
    counts = reduce(DataFrame.unionByName, [
        df.groupBy("eid").agg(F.count(F.lit(1)).alias("_n")).select("eid", F.lit(name).alias("capability"), "_n")
        for name, df in tables.items()])
    names = F.explode(F.array(*[F.lit(n) for n in tables])).alias("capability")
    every = sessions.select("eid").distinct().select("eid", names)
    return every.join(counts, ["eid", "capability"], "left").withColumn(
        "n_rows", F.coalesce("_n", F.lit(0).cast("bigint"))).select("eid", "capability", *_present())


def build_manifest(sessions: DataFrame, units: DataFrame, trials: DataFrame,
                   behaviour: DataFrame, insertions: DataFrame) -> DataFrame:
    """One row per session: counts, regions, modalities, probes.

    Each source is reduced to session rows before the joins; the sets are bounded by the
    vocabulary of regions, series and probes. Absent counts are 0, absent metadata null.
    """
    per_units = units.groupBy("eid").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if("passed").alias("n_units_qc"),
        F.sort_array(F.collect_set("region")).alias("regions"))
    per_trials = trials.groupBy("eid").agg(F.count(F.lit(1)).alias("n_trials"))
    per_series = behaviour.groupBy("eid").agg(
        F.sort_array(F.collect_set("series")).alias("modalities"))
    spots = F.struct("probe_name", "x", "y", "z")
    per_probe = insertions.groupBy("eid").agg(
        F.count_distinct("probe_name").alias("n_probes"),
        F.sort_array(F.collect_set(spots)).alias("insertions"))
    zero = F.lit(0).cast("bigint")
    return (sessions.join(per_units, "eid", "left").join(per_trials, "eid", "left")
            .join(per_series, "eid", "left").join(per_probe, "eid", "left")
            .withColumns({c: F.coalesce(F.col(c), zero)
                          for c in ("n_units", "n_units_qc", "n_trials", "n_probes")}))


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Rows a manifest must not have: no subject, no unit, more passing units than units."""
    reason = (F.when(F.col("subject").isNull(), "no subject")
              .when(F.col("n_units") <= 0, "no units")
              .when(F.col("n_units_qc") > F.col("n_units"), "more passing units than units"))
    return manifest.withColumn("reason", reason).where("reason IS NOT NULL").select("eid", "reason")


def select_sessions(manifest: DataFrame, n: int, min_subjects: int, min_labs: int) -> DataFrame:
    """``n`` sessions spread over the subjects: first every subject's first, then the second.

    Raises when the selection spans too few subjects or labs.
    """
    rank = F.row_number().over(W.partitionBy("subject").orderBy("eid"))
    chosen = manifest.withColumn("_rank", rank).orderBy("_rank", "subject").limit(n).drop("_rank")
    spread = chosen.agg(F.count_distinct("subject"), F.count_distinct("lab")).head()
    if spread[0] < min_subjects or spread[1] < min_labs:
        raise ValueError(f"selection spans {spread[0]} subjects and {spread[1]} labs")
    return chosen


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
