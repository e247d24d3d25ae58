"""Ordered computations that survive a hot key.

A plain window partitioned by session (or unit, or nothing) sorts one key in one
task. Here every key is cut into chunks of its order, so that a key holding a
third of all rows is spread over as many tasks as it has chunks:

* ``with_halo``  for windows of a known reach: neighbours of a chunk border are
  copied into the next chunk, one shuffle, no join;
* ``running``    for unlimited reach: running value inside a chunk combined with
  the carry of the chunk summaries before it;
* ``ranks`` / ``quantiles`` on top of ``running`` over distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truegauge.session import cut_lineage

MIN_CHUNKS = 64
#: Rows that a task sorts; larger tables get more tasks than there are shuffle partitions.
TASK_ROWS = 1 << 20


def with_halo(df: DataFrame, index: str, chunk: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add ``_chunk`` and ``_core``; rows within reach of a border appear in both chunks.

    ``back`` is how far before a row its window looks, ``ahead`` how far after it.
    Windows go over ``(keys, _chunk)``; keep only ``_core`` rows afterwards.
    """
    if chunk <= max(back, ahead):
        raise ValueError("chunk has to be longer than the reach of the window")
    i = F.col(index)

    def chunk_of(position: Column) -> Column:
        return ((position - F.pmod(position, F.lit(chunk))) / F.lit(chunk)).cast("bigint")

    first, last = chunk_of(i - F.lit(ahead)), chunk_of(i + F.lit(back))
    return (df.withColumn("_chunk", F.explode(F.sequence(first, last)))
              .withColumn("_core", F.col("_chunk") == chunk_of(i)))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
            carry: Mapping[str, tuple[str, Column]], *, inclusive: bool = True,
            reverse: bool = False, back: Mapping[str, tuple[str, Column]] | None = None,
            parts: int | None = None) -> DataFrame:
    """Running sum / max / min / last of each ``carry`` entry, added as a column.

    ``order`` has to be a total order inside ``keys`` and ``chunk`` non-decreasing
    in it. ``reverse`` runs from the end; ``back`` has entries that run the other way in the same pass,
    from the same chunk summaries. ``parts`` deals the rows to so many tasks (``tasks_for``). ``last`` keeps the latest non-null value, so ``last`` with
    ``inclusive=False`` is lag (or lead, reversed).
    """
    # Null keys and a null chunk are groups of their own: flag and value, so that equality finds them
    # and window, sums and join share one partitioning of the rows.
    rows, by = null_keys(df.withColumn("_chunk", chunk), [*keys, "_chunk"])
    groups, at = [c for pair in by[:-1] for c in pair], by[-1]
    flat = [c for pair in by for c in pair]
    ways = [(carry, reverse), (back or {}, not reverse)]
    for entries, _ in ways:
        for name, (_, value) in entries.items():
            rows = rows.withColumn(f"_in_{name}", value)
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    summaries, carried, local, merged = [], [], [], []
    for entries, backwards in ways:
        # Nulls come first, as in the order of the rows.
        rising = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
        known = [F.col(at[0]).asc() if backwards else F.col(at[0]).desc(),
                 F.col(at[1]).desc() if backwards else F.col(at[1]).asc()]
        within = W.partitionBy(*flat).orderBy(*rising).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        across = W.partitionBy(*groups).orderBy(*known).rowsBetween(W.unboundedPreceding, -1)
        for name, (kind, _) in entries.items():
            value, total = F.col(f"_in_{name}"), F.col(f"_sum_{name}")
            before, here = F.col(f"_before_{name}"), F.col(f"_here_{name}")
            if kind == "sum":
                summaries.append(F.sum(value).alias(f"_sum_{name}"))
                carried.append(F.sum(total).over(across).alias(f"_before_{name}"))
                local.append(F.sum(value).over(within).alias(f"_here_{name}"))
                merged.append((F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))).alias(name))
            elif kind in ("max", "min"):
                fn = getattr(F, kind)
                summaries.append(fn(value).alias(f"_sum_{name}"))
                carried.append(fn(total).over(across).alias(f"_before_{name}"))
                local.append(fn(value).over(within).alias(f"_here_{name}"))
                pick = F.greatest if kind == "max" else F.least
                merged.append(pick(before, here).alias(name))
            elif kind == "last":
                seen = F.when(value.isNotNull(), position)
                summaries.append((F.min_by if backwards else F.max_by)(value, seen).alias(f"_sum_{name}"))
                carried.append(F.last(total, ignorenulls=True).over(across).alias(f"_before_{name}"))
                local.append(F.last(value, ignorenulls=True).over(within).alias(f"_here_{name}"))
                merged.append(F.coalesce(here, before).alias(name))
            else:
                raise ValueError(f"unknown running kind {kind!r}")

    if parts is not None:
        rows = rows.repartition(parts, *flat)
    ends = rows.groupBy(*flat).agg(*summaries).select(*flat, *carried)
    out = rows.select("*", *local).join(ends, flat)
    return out.select(*df.columns, *merged)


def tasks_for(df: DataFrame, rows: int) -> int | None:
    """Tasks for so many rows, where the shuffle partitions are too few."""
    wanted = math.ceil(rows / TASK_ROWS)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def null_keys(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """Columns that are equal exactly where the given ones are null-safe equal, and their names."""
    types, found = dict(df.dtypes), []
    for c in columns:
        kind = types[c]
        flag, value = f"_null_{c}", f"_key_{c}"
        if kind == "string":
            other = F.lit("")
        elif kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            other = F.lit(0).cast(kind)
        else:
            # Structs compare their nulls as equal, whatever the type.
            df = df.withColumns({flag: F.col(c).isNull(), value: F.struct(F.col(c))})
            found.append((flag, value))
            continue
        df = df.withColumns({flag: F.col(c).isNull(), value: F.coalesce(F.col(c), other)})
        found.append((flag, value))
    return df, found


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
             columns: Sequence[str], *, prefix: str = "prev_", reverse: bool = False) -> DataFrame:
    """lag(1) of several columns (lead(1) with ``reverse``), nulls included."""
    packed = running(df, keys, order, chunk, {"_prev": ("last", F.struct(*columns))},
                     inclusive=False, reverse=reverse)
    return packed.select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in columns])


def with_value_chunk(df: DataFrame, column: str, chunks: int | None = None) -> DataFrame:
    """Add ``_part``: an order-preserving chunk cut at approximate quantiles of a column.

    There are as many chunks as shuffle partitions by default. Their cut points are
    read once and frozen, so a recomputed partition falls into the same chunks. Any cut
    points give exact results; the quantiles only balance the load.
    """
    if chunks is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = max(MIN_CHUNKS, partitions)
    steps = [i / chunks for i in range(1, chunks)]
    found = df.approxQuantile(column, steps, 1.0 / (2 * chunks))
    cuts = sorted({float(c) for c in found if not math.isnan(c) and not math.isinf(c)})
    if not cuts:
        return df.withColumn("_part", F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=column, outputCol="_part",
                      handleInvalid="keep").transform(df)


def cumulative_cells(df: DataFrame, keys: Sequence[str], value: str,
                     totals: Mapping[str, Column], chunk: Column | None = None) -> DataFrame:
    """One row per (keys, value) with each total and ``before_<total>`` of smaller values.

    Copies of a value collapse in the map-side aggregation, so ties cannot form a
    hot chunk.
    """
    cells, parts = df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in totals.items()]), None
    if chunk is None:
        # The cells are read for the cuts, the chunk sums and the rows: write them once.
        cells = cut_lineage(cells)
        parts = tasks_for(cells, cells.count())
        cells = with_value_chunk(cells, value)
    else:
        cells = cells.withColumn("_part", chunk)
    return running(cells, keys, [value], F.col("_part"),
                   {f"before_{n}": ("sum", F.col(n)) for n in totals},
                   inclusive=False, parts=parts).drop("_part")


def rank_cells(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank of each distinct non-null ``value`` inside ``keys``, ties at their mean rank."""
    cells = cumulative_cells(df.where(F.col(value).isNotNull()), keys, value,
                             {"_n": F.count(F.lit(1))})
    return cells.select(*keys, value, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(out))


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              wanted: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without buffering a group."""
    cells = cumulative_cells(df.where(F.col(value).isNotNull()), keys, value,
                             {"_n": F.count(F.lit(1))})
    sizes = cells.groupBy(*keys).agg(F.sum("_n").alias("_size")) if keys else None
    if keys:
        cells = cells.join(sizes, list(keys))
    else:
        # The size of the whole table is one number; read it rather than cross join it.
        cells = cells.withColumn("_size", F.lit(cells.agg(F.sum("_n")).head()[0]))
    before, upto = F.col("before__n"), F.col("before__n") + F.col("_n")
    picks, outs = [], []
    for name, q in wanted.items():
        target = F.lit(float(q)) * (F.col("_size") - 1)
        low, high = F.floor(target), F.ceil(target)
        picks += [F.max(F.when((before <= low) & (low < upto), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when((before <= high) & (high < upto), F.col(value))).alias(f"_hi_{name}"),
                  F.max(target - low).alias(f"_w_{name}")]
        lo, hi, w = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        outs.append((lo + (hi - lo) * w).alias(name))
    return cells.groupBy(*keys).agg(*picks).select(*keys, *outs)


def kth_smallest(df: DataFrame, keys: Sequence[str], value: str, k: Column | int,
                 out: str) -> DataFrame:
    """The k-th order statistic per key (k may use the group size column ``size``).

    A k beyond the size gives +infinity, as a conformal quantile requires.
    """
    cells = cumulative_cells(df, keys, value, {"_n": F.count(F.lit(1))})
    sizes = cells.groupBy(*keys).agg(F.sum("_n").alias("size"))
    rank = k if isinstance(k, Column) else F.lit(k)
    if keys:
        cells = cells.join(sizes, list(keys))
    else:
        cells = cells.withColumn("size", F.lit(sizes.head()[0] or 0).cast("bigint"))
    hit = (F.col("before__n") < rank) & (rank <= F.col("before__n") + F.col("_n"))
    return cells.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(hit, F.col(value).cast("double"))),
                   F.lit(float("inf"))).alias(out),
        F.max("size").alias("size"))
