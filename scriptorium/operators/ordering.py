"""Position of each row in an order, or within its group, without a single-task window.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sorts a whole group in one task; a
group that holds a third of the table would become one straggler.  Here the rows are
ranged by Spark and sorted inside their partitions, and written once with their place
there.  The counts of the partitions (one row each) give the rows before every
partition, so a row's number is a sum; a group's positions are its rows' numbers
from its first one on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import checkpoint_dir

#: low bits of monotonically_increasing_id: the row's place in its partition
_PLACE = (1 << 33) - 1


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def number_rows(df: DataFrame, order: Sequence[str], out: str = "idx", ranges: int | None = None) -> DataFrame:
    """Add ``out`` BIGINT = 1-based position of the row by ``order`` (nulls first).

    Rows that tie on all of ``order`` get consecutive positions in an unspecified
    order, the same whenever the result is read: the places are a reliable
    checkpoint, which a lost executor does not change."""
    checkpoint_dir(df.sparkSession)
    part, place, before = _free(df, "_part"), _free(df, "_place"), _free(df, "_before")
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order) \
        .withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}).checkpoint()
    # one row per partition
    counts = placed.groupBy(part).agg(F.count("*").alias(before))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0)))
    return placed.join(F.broadcast(counts), part).withColumn(out, F.col(before) + F.col(place) + 1).drop(part, place, before)


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "idx", ranges: int | None = None) -> DataFrame:
    """Add ``out`` BIGINT = 1-based position of the row within ``group`` by ``order``;
    rows with equal keys, nulls included, are one group."""
    group = list(group)
    row, first = _free(df, "_row"), _free(df, "_first")
    numbered = number_rows(df, [*group, *order], row, ranges)
    starts = numbered.groupBy(*group).agg(F.min(row).alias(first)).alias("s")
    same = [F.col(f"n.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return numbered.alias("n").join(starts, cond).select("n.*", F.col(f"s.{first}")) \
        .withColumn(out, F.col(row) - F.col(first) + 1).drop(row, first)
