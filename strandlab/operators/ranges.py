"""Order statistics of groups of any size, by ranges of their values: no task gets a whole large group.

Values are counted together where they are equal, then dealt out by ranges of (group, value), which Spark takes from a
sample: a large group fills many ranges, small groups share one. Sums over a group's ranges, one row each, put the ranges in
their places; only within a range are rows ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one aggregation buffer holds at most; the values of larger groups are found by ranges.
WHOLE = 1 << 20


def dealt(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, one for each value of a group, dealt out by ranges of group and value; __range numbers them."""
    return counted.repartitionByRange(*keys, value).withColumn("__range", F.spark_partition_id())


def before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def _positions(ps: tuple[float, ...], total: Column) -> list[tuple[Column, Column, Column]]:
    """(place, the rank below, the rank above) of each percentile among `total` values, from 0."""
    at = [F.lit(p) * (total - 1) for p in ps]
    return [(x, F.floor(x), F.ceil(x)) for x in at]


def _selected(own: DataFrame, keys: list[str], ps: tuple[float, ...]) -> DataFrame:
    """keys and p: the values at the ranks, each out of the one range that holds it."""
    counted = own.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    ranges = dealt(counted, keys, "v").groupBy(*keys, "__range").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n"))
    whole = Window.partitionBy(*keys)
    ranges = ranges.withColumns({"below": F.coalesce(F.sum("n").over(before(keys, "low")), F.lit(0)), "total": F.sum("n").over(whole)})
    ranks = F.array_distinct(F.array(*(r for _, low, high in _positions(ps, F.col("total")) for r in (low, high))))
    ranges = ranges.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))).filter(F.size("ranks") > 0)
    # Ranges are named by their ends, which hold for any other dealing of the same rows. At most two a percentile and large group.
    wanted = ranges.select(*(F.col(k).alias(f"of_{k}") for k in keys), "low", "high", "below", "total", "ranks")
    on = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    rows = counted.join(F.broadcast(wanted), on)
    rows = rows.withColumn("from", F.col("below") + F.coalesce(F.sum("c").over(before([*keys, "low"], "v")), F.lit(0)))
    hits = rows.select(*keys, "v", "total", F.explode(F.filter("ranks", lambda r: (r >= F.col("from")) & (r < F.col("from") + F.col("c")))).alias("r"))
    out = []
    for at, low, high in _positions(ps, F.col("total")):
        a, b = F.max(F.when(F.col("r") == low, F.col("v"))), F.max(F.when(F.col("r") == high, F.col("v")))
        x, y, z = (F.max(c) for c in (at, low, high))
        out.append(F.when(y == z, a).otherwise((z - x) * a + (x - y) * b))
    return hits.groupBy(*keys).agg(F.array(*out).alias("p"))


def percentiles(rows: DataFrame, value: str, keys: list[str], ps: tuple[float, ...], sizes: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """keys and p: exact interpolated percentiles of each group's values that aren't null.

    sizes(keys, n), if there is one already. Groups of up to `whole` rows are aggregated at once. Larger ones are found by
    their ranges; there are fewer of them than a millionth of the rows, so their keys are sent to all tasks.
    """
    names = [f"k{k}" for k in range(len(keys))] or ["k0"]
    given = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)] if keys else [F.lit(0).alias("k0")]
    own = rows.select(*given, F.col(value).cast("double").alias("v")).filter("v is not null")
    counts = sizes.select(*given, "n") if sizes is not None else own.groupBy(*names).agg(F.count("*").alias("n"))
    large = F.broadcast(counts.filter(F.col("n") > whole).select(*names))
    small = own.join(large, _same(own, large, names), "left_anti").groupBy(*names).agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("p"))
    ranged = _selected(own.join(large, _same(own, large, names), "left_semi"), names, ps)
    return small.unionByName(ranged).select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=False)), "p")
