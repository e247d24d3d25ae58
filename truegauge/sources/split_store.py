"""Split files: content-addressed, checked on load, with the statistics that belong to them.

``<root>/<hash>`` holds the blocks as JSON lines, a header with the definition, the digest of the
blocks and the versions they were made for, and the normalization statistics fit on the split's train
part. The hash covers the header and so the blocks. Loading recomputes both and compares the recorded
versions with the manifest at hand and with the running code; it raises on any difference, so a guard never has to take a
caller's word for a version.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge import PREPROC_VERSION
from truegauge.operators import binning
from truegauge.operators.guards import SplitViolation
from truegauge.operators.splits import BLOCK_COLUMNS, Split
from truegauge.sources import runs

NORM_COLUMNS = ("eid", "unit_id", "mean", "std", "n")
#: What the header records of the definition, besides digest and versions.
DEFINITION = ("kind", "context_bins", "min_gap_bins", "required_parts", "bin_width_us", "target")


def manifest_version(manifest: DataFrame) -> str:
    """Content hash of a session table: any changed, added or missing session gives another version."""
    return runs.digest(manifest, *sorted(manifest.columns))


def split_file_hash(header: dict) -> str:
    text = json.dumps(header, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def save_split(split: Split, root: str, manifest: DataFrame) -> str:
    """Write the split file and return its hash; equal splits share one file."""
    spark = split.blocks.sparkSession
    apart = split.blocks.where(~F.col("kind").eqNullSafe(split.kind)).select("kind").head()
    if apart is not None:
        raise SplitViolation(f"a split of kind {split.kind} has blocks of kind {apart['kind']}")
    header = {name: getattr(split, name) for name in DEFINITION}
    header |= {"required_parts": list(split.required_parts), "blocks": runs.digest(split.blocks, *BLOCK_COLUMNS),
               "manifest_version": manifest_version(manifest), "preproc_version": split.preproc_version,
               "schema": [f"{c} {split.blocks.schema[c].dataType.simpleString()}" for c in BLOCK_COLUMNS]}
    name = split_file_hash(header)
    folder = f"{root}/{name}"
    if runs.winner(spark, f"{folder}/header") is None:
        run = runs.new_run()
        split.blocks.select(*BLOCK_COLUMNS).write.json(runs.run_folder(f"{folder}/blocks", run))
        if split.trials is not None:
            split.trials.write.parquet(runs.run_folder(f"{folder}/trials", run))
        runs.commit(spark, f"{folder}/header", run, header)
    return name


@dataclass(frozen=True)
class StoredSplit(Split):
    """A split read from its file; ``file_hash`` names the file and keys what was fit under it."""

    root: str = ""
    file_hash: str = ""

    def norm(self) -> DataFrame | None:
        """The statistics stored with the split, verified; None before ``fit_norm``."""
        spark = self.blocks.sparkSession
        folder = f"{self.root}/{self.file_hash}/norm"
        found = runs.winner(spark, f"{folder}/header")
        if found is None:
            return None
        stats = spark.read.parquet(runs.run_folder(f"{folder}/stats", found[0]))
        if runs.digest(stats, *NORM_COLUMNS) != found[1]["stats"]:
            raise SplitViolation(f"the statistics of split {self.file_hash} were changed")
        return stats.withColumn("split_hash", F.lit(self.file_hash))

    def fit_norm(self, bins: DataFrame, units: DataFrame) -> DataFrame:
        """Statistics of the train part, fit once and stored with the split."""
        spark = self.blocks.sparkSession
        if self.norm() is None:
            folder, run = f"{self.root}/{self.file_hash}/norm", runs.new_run()
            binning.fit_norm(bins, units, self).select(*NORM_COLUMNS).write.parquet(
                runs.run_folder(f"{folder}/stats", run))
            fresh = spark.read.parquet(runs.run_folder(f"{folder}/stats", run))
            runs.commit(spark, f"{folder}/header", run, {"stats": runs.digest(fresh, *NORM_COLUMNS)})
        return self.norm()

    def normalized(self, rows: DataFrame, stats: DataFrame) -> DataFrame:
        """z-scores with statistics of this very split; those of another one raise."""
        other = stats.where(~F.col("split_hash").eqNullSafe(self.file_hash)).select("split_hash").head()
        if other is not None:
            raise SplitViolation(f"statistics of split {other[0]} used under split {self.file_hash}")
        return binning.apply_norm(rows, stats)


def recorded_versions(spark: SparkSession, root: str) -> DataFrame:
    """(split_id, manifest_version, preproc_version) as every committed split file of ``root`` records them."""
    found = runs.existing(spark, f"{root}/*/header/run=*", "text", "value string")
    if found is None:
        return spark.createDataFrame([], "split_id string, manifest_version string, preproc_version string")
    header = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return found.select(header("kind").alias("split_id"), header("manifest_version"),
                        header("preproc_version")).distinct()


def load_split(spark: SparkSession, root: str, name: str, manifest: DataFrame) -> StoredSplit:
    """Read, verify and guard a split; ``manifest`` is the session table in use now."""
    folder = f"{root}/{name}"
    found = runs.winner(spark, f"{folder}/header")
    if found is None:
        raise SplitViolation(f"there is no split file {name}")
    run, header = found
    if split_file_hash(header) != name:
        raise SplitViolation(f"the header of split file {name} was changed")
    blocks = spark.read.schema(", ".join(header["schema"])).json(runs.run_folder(f"{folder}/blocks", run))
    if runs.digest(blocks, *BLOCK_COLUMNS) != header["blocks"]:
        raise SplitViolation(f"the blocks of split file {name} were changed")
    now = manifest_version(manifest)
    if header["manifest_version"] != now or header["preproc_version"] != PREPROC_VERSION:
        raise SplitViolation(f"split file {name} was made for manifest {header['manifest_version']} and preprocessing "
                             f"{header['preproc_version']}, not {now} and {PREPROC_VERSION}")
    trials = runs.existing(spark, runs.run_folder(f"{folder}/trials", run))
    definition = {key: header[key] for key in DEFINITION} | {"required_parts": tuple(header["required_parts"])}
    return StoredSplit(blocks=blocks, manifest_version=header["manifest_version"],
                       preproc_version=header["preproc_version"], current_manifest_version=now, trials=trials,
                       root=root, file_hash=name, **definition)
