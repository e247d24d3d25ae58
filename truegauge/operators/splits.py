"""Split registry. Every split is a table of blocks; nothing downstream takes a session list.

Blocks: split_id, kind, part, eid, subject, lab, start_bin, end_bin (inclusive),
with part in train / calib / test / gap / dropped. The input ``sessions`` has
eid, subject, lab and n_bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truegauge import PREPROC_VERSION
from truegauge.functions.hashing import hash_bucket, hash_order
from truegauge.operators.intervals import join_points
from truegauge.session import cut_lineage

BLOCK_COLUMNS = ["split_id", "kind", "part", "eid", "subject", "lab", "start_bin", "end_bin"]

SESSION_KINDS = ("held_out_session", "held_out_region", "held_out_config")
ANIMAL_KINDS = ("held_out_animal", "held_out_lab", "three_way")


@dataclass(frozen=True)
class Split:
    """A checked split: the constructor freezes the blocks, runs every guard and raises.

    The blocks are written out once (a split is an artifact): the guards and every
    later use read that small table instead of deriving it from the events again.
    With ``bin_width_us`` the gap has to last 2 s at least, besides the context and
    ``min_gap_bins``.
    """

    kind: str
    blocks: DataFrame
    context_bins: int
    min_gap_bins: int = 0
    manifest_version: str = "1"
    preproc_version: str = PREPROC_VERSION
    current_manifest_version: str = "1"
    trials: DataFrame | None = None
    required_parts: tuple[str, ...] = ("train", "test")
    bin_width_us: int | None = None
    chunk_bins: int = field(default=4096, repr=False)
    #: What is predicted: a value per "bin", or per "trial", which then needs ``trials``.
    target: str = "bin"

    def __post_init__(self) -> None:
        from truegauge.operators.guards import assert_split_valid
        object.__setattr__(self, "blocks", cut_lineage(self.blocks))
        assert_split_valid(self, self.context_bins)

    def rows(self, df: DataFrame, *parts: str, at: str = "bin") -> DataFrame:
        """Rows of ``df(eid, <at>, ...)`` inside the given parts, tagged with ``part``.

        ``pos`` counts the bins from the start of the block, ``n_pos`` is its length.
        """
        wanted = self.blocks.where(F.col("part").isin(*parts)).select(
            "eid", "part", "start_bin", (F.col("end_bin") + 1).alias("_stop"))
        found = join_points(df, wanted, ["eid"], at, "start_bin", "_stop", self.chunk_bins)
        return (found.withColumn("pos", F.col(at) - F.col("start_bin"))
                .withColumn("n_pos", F.col("_stop") - F.col("start_bin"))
                .drop("start_bin", "_stop"))

    def trial_rows(self, df: DataFrame, *parts: str, width_us: int) -> DataFrame:
        """Trials of ``df(eid, start_us, end_us, ...)`` wholly inside a block of the given parts.

        Only a split that declares trial targets, and so was guarded on its trials, gives them.
        """
        if self.target != "trial":
            raise ValueError("this split was not made for trial targets")
        return assign_trials(df, self.blocks, width_us).where(F.col("part").isin(*parts))

    def bin_spans(self, *parts: str) -> DataFrame:
        """The blocks of the given parts as (eid, part, start_bin, end_bin)."""
        return self.blocks.where(F.col("part").isin(*parts)).select(
            "eid", "part", "start_bin", "end_bin")

    def part_sizes(self, part: str) -> DataFrame:
        return (self.blocks.where(F.col("part") == part).groupBy("eid")
                .agg(F.sum(F.col("end_bin") - F.col("start_bin") + 1).alias("n_bins")))

    def spans(self, part: str, width_us: int) -> DataFrame:
        return self.blocks.where(F.col("part") == part).select(
            "eid", (F.col("start_bin") * width_us).alias("start_us"),
            ((F.col("end_bin") + 1) * width_us).alias("end_us"))


def whole_sessions(sessions: DataFrame, kind: str, split_id: str | Column,
                   part: Column) -> DataFrame:
    """Blocks that give every session as a whole to one part."""
    name = F.lit(split_id) if isinstance(split_id, str) else split_id
    return sessions.select(name.alias("split_id"), F.lit(kind).alias("kind"),
                           part.alias("part"), "eid", "subject", "lab",
                           F.lit(0).cast("bigint").alias("start_bin"),
                           (F.col("n_bins") - 1).alias("end_bin"))


def split_within(sessions: DataFrame, train_fraction: float, gap_bins: int) -> DataFrame:
    """Early contiguous block trains, late block tests, a gap in between.

    A session too short to hold all three blocks is dropped as a whole.
    """
    n_train = F.floor(F.col("n_bins") * train_fraction)
    first_test = n_train + gap_bins
    fits = (n_train > 0) & (first_test < F.col("n_bins"))
    block = lambda part, lo, hi: F.struct(
        F.lit(part).alias("part"), lo.cast("bigint").alias("start_bin"),
        hi.cast("bigint").alias("end_bin"))
    pieces = F.when(fits, F.array(block("train", F.lit(0), n_train - 1),
                                  block("gap", n_train, first_test - 1),
                                  block("test", first_test, F.col("n_bins") - 1))
                    ).otherwise(F.array(block("dropped", F.lit(0), F.col("n_bins") - 1)))
    return (sessions.withColumn("_b", F.explode(pieces))
            .select(F.lit("within_session").alias("split_id"),
                    F.lit("within_session").alias("kind"), "_b.part", "eid", "subject", "lab",
                    "_b.start_bin", "_b.end_bin")
            .where(F.col("start_bin") <= F.col("end_bin")))


def split_session(sessions: DataFrame, eid: int) -> DataFrame:
    """The other sessions of the same animal train, session ``eid`` tests."""
    owner = sessions.where(F.col("eid") == eid).select("subject")
    mine = sessions.join(owner, "subject", "left_semi")
    return whole_sessions(mine, "held_out_session", f"held_out_session={eid}",
                          F.when(F.col("eid") == eid, "test").otherwise("train"))


def split_animal(sessions: DataFrame, subject: int | str) -> DataFrame:
    return whole_sessions(sessions, "held_out_animal", f"held_out_animal={subject}",
                          F.when(F.col("subject") == subject, "test").otherwise("train"))


def split_lab(sessions: DataFrame, lab: int | str) -> DataFrame:
    return whole_sessions(sessions, "held_out_lab", f"held_out_lab={lab}",
                          F.when(F.col("lab") == lab, "test").otherwise("train"))


def region_part(units: DataFrame, region: str, min_share: float = 0.2) -> DataFrame:
    """Part of each session for a held-out region, from units(eid, region, passed).

    Test: at least ``min_share`` of the QC-passing units lie in the region.
    Train: no unit at all, passing or not, lies in it. Everything else is dropped.
    """
    inside = F.col("region") == region
    per = units.groupBy("eid").agg(
        F.count_if(inside).alias("n_in_region"),
        F.count_if(F.col("passed")).alias("n_pass"),
        F.count_if(inside & F.col("passed")).alias("n_pass_in_region"))
    share = F.try_divide("n_pass_in_region", "n_pass")
    return per.withColumn("part", F.when(F.col("n_in_region") == 0, "train")
                          .when(share >= min_share, "test").otherwise("dropped"))


def split_region(sessions: DataFrame, units: DataFrame, region: str,
                 min_share: float = 0.2) -> DataFrame:
    parts = region_part(units, region, min_share).select("eid", "part")
    return whole_sessions(sessions.join(parts, "eid"), "held_out_region",
                          f"held_out_region={region}", F.col("part"))


def split_config(sessions: DataFrame, config: str) -> DataFrame:
    """Sessions with the most frequent value of ``config`` train, the others test.

    Equally frequent values resolve to the smallest, so the standard is stable.
    """
    counts = sessions.groupBy(config).agg(F.count(F.lit(1)).alias("_n"))
    standard = counts.orderBy(F.desc("_n"), config).select(config).head()
    if standard is None:
        raise ValueError("no sessions")
    return whole_sessions(sessions, "held_out_config", f"held_out_config={config}",
                          F.when(F.col(config) == F.lit(standard[0]), "train").otherwise("test"))


def split_three_way(sessions: DataFrame, train: int, calib: int, seed: str,
                    by: str = "subject", kind: str = "three_way") -> DataFrame:
    """Groups of ``by`` to train / calib / test by a stable hash, in percent."""
    bucket = hash_bucket(100, F.col(by), F.lit(seed))
    return whole_sessions(sessions, kind, f"{kind}={seed}",
                          F.when(bucket < train, "train")
                          .when(bucket < train + calib, "calib").otherwise("test"))


def assign_trials(trials: DataFrame, blocks: DataFrame, width_us: int) -> DataFrame:
    """Trials wholly inside one block; a trial crossing a border is ``dropped``.

    The block of the first and of the last microsecond are looked up; they have to
    be the same block.
    """
    spans = blocks.select("eid", "part", (F.col("start_bin") * width_us).alias("_from"),
                          ((F.col("end_bin") + 1) * width_us).alias("_to"))
    closed = trials.where(F.col("end_us").isNotNull())
    hit = join_points(closed, spans, ["eid"], "start_us", "_from", "_to", 4096 * width_us)
    return hit.withColumn("part", F.when(F.col("end_us") <= F.col("_to"), F.col("part"))
                          .otherwise("dropped")).drop("_from", "_to")


GROUP_OF = {"held_out_session": "eid", "held_out_animal": "subject", "held_out_lab": "lab"}


def all_splits(sessions: DataFrame, kind: str) -> DataFrame:
    """Leave-one-group-out: one row per (split, test session) plus the sizes of both sides.

    The train side is the complement (for held_out_session: within the animal), so
    it is stored as its size; listing it would square the session table.
    """
    group = GROUP_OF[kind]
    sizes = sessions.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"))
    out = sessions.join(sizes, group)
    if kind == "held_out_session":
        pool = sessions.groupBy("subject").agg(F.count(F.lit(1)).alias("_pool"))
        out = out.join(pool, "subject")
    else:
        # One number for the whole table.
        out = out.withColumn("_pool", F.lit(sessions.count()).cast("bigint"))
    return out.select(F.concat(F.lit(kind + "="), F.col(group).cast("string")).alias("split_id"),
                      "eid", "subject", "lab", "n_test",
                      (F.col("_pool") - F.col("n_test")).alias("n_train"))


def all_region_splits(units: DataFrame, min_share: float = 0.2) -> DataFrame:
    """Leave-one-region-out: per region the sessions that have a unit in it, test or dropped.

    Every other session trains; it is stored as the count ``n_train``. ``units`` has eid,
    region and passed.
    """
    cells = units.groupBy("eid", "region").agg(
        F.count_if("passed").alias("_in"))
    passing = units.groupBy("eid").agg(F.count_if("passed").alias("_pass"))
    share = F.try_divide("_in", "_pass")
    n = units.select(F.count_distinct("eid")).head()[0]
    rows = cells.join(passing, "eid").select(
        "eid", "region", F.when(share >= min_share, "test").otherwise("dropped").alias("part"))
    sizes = cells.groupBy("region").agg((F.lit(n) - F.count(F.lit(1))).alias("n_train"))
    return rows.join(sizes, "region").select(
        F.concat(F.lit("held_out_region="), "region").alias("split_id"), "eid", "part", "n_train")


def split_hash(blocks: DataFrame, manifest_version: str,
               preproc_version: str = PREPROC_VERSION) -> DataFrame:
    """One hash per split over its blocks, the manifest version and the preprocessing version.

    The 32-bit words of the row digests are summed before the final digest: the
    order of rows does not matter and no list of rows is ever built.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                              for c in BLOCK_COLUMNS[1:]])
    digest = F.sha2(text, 256)
    words = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint"))
             .cast("string") for i in range(8)]
    return blocks.groupBy("split_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sha2(F.concat_ws("|", *words, F.lit(manifest_version), F.lit(preproc_version)),
               256).alias("hash"))


def split_power(blocks: DataFrame, needed: int = 20) -> DataFrame:
    """Test sessions per split against the number a stable correlation needs."""
    tested = blocks.where("part = 'test'").select("split_id", "eid").distinct()
    return (tested.groupBy("split_id").agg(F.count(F.lit(1)).alias("n_test_sessions"))
            .withColumn("enough", F.col("n_test_sessions") >= needed))


def split_interleaved(trials: DataFrame, seed: str, train: int = 70,
                      calib: int = 10) -> DataFrame:
    """Shuffled trials cut by share: leaky on purpose, only for measuring inflation.

    The rank inside a session comes from the hash order, with the first digits of
    the digest as chunk, so a session with very many trials is spread.
    """
    from truegauge.operators.ordered import running
    order = trials.withColumn("_h", hash_order("trial_id", F.lit(seed)))
    ranked = running(order, ["eid"], ["_h", "trial_id"],
                     F.conv(F.substring("_h", 1, 2), 16, 10).cast("bigint"),
                     {"_rank": ("sum", F.lit(1).cast("bigint"))})
    size = trials.groupBy("eid").agg(F.count(F.lit(1)).alias("_n"))
    pct = F.col("_rank") * 100
    part = (F.when(pct <= F.col("_n") * train, "train")
            .when(pct <= F.col("_n") * (train + calib), "calib").otherwise("test"))
    return ranked.join(size, "eid").withColumn("part", part).drop("_h", "_rank", "_n")


def trial_blocks(assigned: DataFrame, width_us: int) -> DataFrame:
    """Blocks of a trial-level assignment, one per trial."""
    from truegauge.functions.timing import bin_of
    return assigned.where(F.col("end_us").isNotNull()).select(
        F.lit("interleaved").alias("split_id"), F.lit("within_session").alias("kind"), "part",
        "eid", "subject", "lab", bin_of("start_us", width_us).alias("start_bin"),
        bin_of(F.col("end_us") - 1, width_us).alias("end_bin"))


def size_rank(sessions: DataFrame, by: str) -> DataFrame:
    """Sessions of each ``by`` in a stable order; used to pick a spread of sessions."""
    return sessions.withColumn("_rank", F.row_number().over(W.partitionBy(by).orderBy("eid")))
