"""Places and running sums in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.shared import written

#: monotonically_increasing_id() holds the partition above these bits, and the row's place in it below.
_ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 0: rows are dealt out by ranges of the order, sorted within them, and
    written; then the sizes of the ranges before are added to the places within.

    The ranges come from Spark's own sample, so rows must be stable when read again (a written table) and the order
    should have few equal rows; equal ones get places in any order, but each its own. The sizes are a row for each
    partition of the plan, so they are sent to all tasks.
    """
    inside = _in_ranges(rows, *order)
    out = _with_sums_of_ranges(inside, {"__before": F.count("*")})
    return out.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1)).drop("__id", "__part", "__before")


def summed_before(rows: DataFrame, values: list[str], *order: Column | str) -> DataFrame:
    """rows with before_<value> for each of values: its sum over the rows that come earlier in the order (0 for none).
    Ranges are as in `numbered`, and a running sum stays within one; the order must tell all rows apart that matter."""
    inside = _in_ranges(rows, *order)
    out = _with_sums_of_ranges(inside, {f"__{v}": F.sum(v) for v in values})
    earlier = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"before_{v}": F.col(f"__{v}") + F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}
    return out.withColumns(sums).drop("__id", "__part", *(f"__{v}" for v in values))


def _in_ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows in sorted ranges of the order, written, with __id (range and place in it) and __part (the range)."""
    inside = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return written(inside, "numbered").withColumn("__part", F.shiftright("__id", _ROW_BITS))


def _with_sums_of_ranges(inside: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """inside with the given sums over all ranges before the row's own."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy("__part").agg(*(s.alias(n) for n, s in sums.items()))
    parts = parts.select("__part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums))
    return inside.join(F.broadcast(parts), "__part")
