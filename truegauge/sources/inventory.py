"""File inventories: revisions, checksums, and what a file's content can be used for.

An inventory has one row per named object of a file: file, path (and dtype, shape).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.session import ship_package

READ_BYTES = 1 << 22

# Fixed patterns: what a path has to contain to count as the named content.
PROBE_RULES = {
    "units_table": r"(^|/)units(/|$)",
    "spike_times": r"(^|/)units/spike_times$",
    "electrodes": r"(^|/)electrodes(/|$)",
    "region_column": r"(location|region|acronym)$",
    "trials_interval": r"(^|/)trials(/|$)",
    "behaviour_series": r"(wheel|pose|pupil|lick|motion_energy)",
    "timestamps": r"/timestamps$",
    "rates": r"/(rate|starting_time)$",
}

# Fixed names: source columns and the canonical column each stands for, with the factor
# that brings it to canonical units.
KNOWN_COLUMNS = [
    ("one", "stimOn_times", "stim_on", 1.0),
    ("nwb", "gabor_stimulus_onset_time", "stim_on", 1.0),
    ("one", "choice", "choice", 1.0),
    ("nwb", "mouse_wheel_choice", "choice", 1.0),
    ("nwb", "probability_left", "probability_left", 1.0),
    ("nwb", "block_index", "block_index", 1.0),
    ("nwb", "feedback_time", "feedback_time", 1.0),
]


def with_revision(files: DataFrame, path: str = "path") -> DataFrame:
    """``revision`` date from a '#yyyy-mm-dd#' folder of the path, null without one."""
    text = F.regexp_extract(path, r"#(\d{4}-\d{2}-\d{2})#", 1)
    return files.withColumn("revision", F.to_date(F.when(text != "", text)))


def revision_drift(files: DataFrame, pin_date: str) -> DataFrame:
    """Per dataset: number of files, newest revision, and how many are newer than the pin."""
    dated = with_revision(files)
    newer = F.col("revision") > F.lit(pin_date).cast("date")
    return dated.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_files"), F.max("revision").cast("string").alias("newest"),
        F.max_by("file", F.when(F.col("revision").isNotNull(), F.struct("revision", "file")))
        .alias("newest_file"), F.count_if(newer).alias("n_newer"),
        F.count_if(F.col("revision").isNull()).alias("n_undated"))


def landed_checksums(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """(file, n_bytes, checksum) of every landed file, sha256 over a stream of ``READ_BYTES``.

    Spark lists the files and deals them to tasks; no row holds a file's content, so a file may
    be larger than a task's memory.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.col("path").alias("file"), F.col("length").alias("n_bytes"))
    ship_package(spark)
    dealt = listed.repartition(tasks, "file") if tasks else listed.repartition("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                digest = hashlib.sha256()
                scheme, _, plain = batch["file"][row].as_py().partition(":")
                system, path = fs.FileSystem.from_uri(f"{scheme}:{quote(plain)}")
                with system.open_input_stream(path, compression=None) as stream:
                    while data := stream.read(READ_BYTES):
                        digest.update(data)
                yield pa.RecordBatch.from_arrays(
                    [batch["file"].slice(row, 1), batch["n_bytes"].slice(row, 1), pa.array([digest.hexdigest()])],
                    names=["file", "n_bytes", "checksum"])

    return dealt.mapInArrow(run, "file string, n_bytes bigint, checksum string")


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """ok / mismatch / unexpected / missing per file, both sides keyed by file."""
    a = files.select("file", F.col("checksum").alias("_have"))
    b = expected.select("file", F.col("checksum").alias("_want"))
    status = (F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected")
              .when(F.col("_have") == F.col("_want"), "ok").otherwise("mismatch"))
    return a.join(b, "file", "full").select("file", status.alias("status"))


def schema_probe(inventory: DataFrame, rules: Mapping[str, str] = PROBE_RULES) -> DataFrame:
    """One row per file with a flag per rule; any inventory is classified, none fails."""
    flags = [F.coalesce(F.max(F.col("path").rlike(pattern)), F.lit(False)).alias(name)
             for name, pattern in rules.items()]
    return inventory.groupBy("file").agg(F.count(F.lit(1)).alias("n_paths"), *flags)


def capability_report(probe: DataFrame, needs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per file and capability: whether everything it needs was found, else what is missing.

    The requirements are configuration, so they are folded into one projection.
    """
    cells = []
    for capability, fields in needs.items():
        missing = F.array_compact(F.array(*[F.when(~F.col(f), F.lit(f)) for f in fields]))
        cells.append(F.struct(F.lit(capability).alias("capability"), missing.alias("missing")))
    rows = probe.select("file", F.explode(F.array(*cells)).alias("_c"))
    return rows.select("file", "_c.capability", (F.size("_c.missing") == 0).alias("present"),
                       F.concat_ws(", ", "_c.missing").alias("missing"))


def column_mapping(spark: SparkSession, rows: Sequence[tuple] = KNOWN_COLUMNS) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "source string, source_name string, canonical string, factor double")


def map_inventory(inventory: DataFrame, mapping: DataFrame, source: str | None = None) -> DataFrame:
    """Canonical name of each path by the last part of the path; null where unknown.

    ``source`` restricts the mapping; without it a name that sources map apart is an error.
    """
    if source is not None:
        mapping = mapping.where(F.col("source") == source)
    names = mapping.select("source_name", "canonical").distinct()
    apart = [r[0] for r in names.groupBy("source_name").count().where("count > 1").collect()]
    if apart:
        raise ValueError(f"names with several canonical ones, give the source: {sorted(apart)}")
    named = inventory.withColumn("source_name", F.element_at(F.split("path", "/"), -1))
    return named.join(names, "source_name", "left").select("file", "path", "canonical")


def apply_mapping(df: DataFrame, mapping: DataFrame, source: str) -> DataFrame:
    """Rename the columns of one source to canonical names and units.

    Unknown columns keep their name; only numbers are scaled. The mapping of one source
    is a short configuration table and is read.
    """
    known = {r["source_name"]: (r["canonical"], r["factor"]) for r in
             mapping.where(F.col("source") == source).collect()}
    cols = []
    for name in df.columns:
        canonical, factor = known.get(name, (name, 1.0))
        cols.append((F.col(name) * F.lit(factor) if factor != 1.0 else F.col(name)).alias(canonical))
    return df.select(*cols)


def not_interpreted(inventory: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names no mapping knows, with the number of files they occur in."""
    named = inventory.withColumn("source_name", F.element_at(F.split("path", "/"), -1))
    unknown = named.join(mapping.select("source_name"), "source_name", "left_anti")
    return (unknown.select("file", "source_name").distinct().groupBy("source_name")
            .agg(F.count(F.lit(1)).alias("n_files")))
