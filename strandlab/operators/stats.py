"""Descriptive statistics, paired differences, bootstrap, contrasts, top lists and z-scores of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.operators.ranges import WHOLE, percentiles


def summarised(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, population standard deviation and n."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def described(rows: DataFrame, value: str, *keys: str, places: int = 4, whole: int = WHOLE) -> DataFrame:
    """n, mean, std, min, p25, median, p75 and max, with exact interpolated percentiles (see ranges.percentiles)."""
    own = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    p = percentiles(rows, value, list(keys), (0.25, 0.5, 0.75), own, whole)
    p = p.select(*(F.col(k).alias(f"__{k}") for k in keys), "p")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = own.join(p, on, "left")
    cells = {"n": F.col("n"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "p25": F.col("p")[0], "median": F.col("p")[1], "p75": F.col("p")[2], "max": F.col("max")}
    return out.select(*keys, *((c if name == "n" else F.round(c, places)).alias(name) for name, c in cells.items()))


def exceeding(rows: DataFrame, diff: Column, thresholds: tuple[float, ...] = (0.0, 0.02, 0.05), *keys: str) -> DataFrame:
    """n and how many differences are strictly above each threshold."""
    counts = [F.count_if(diff > t).alias(f"above_{k}") for k, t in enumerate(thresholds)]
    return rows.groupBy(*keys).agg(F.count(diff).alias("n"), *counts)


def hash_index(seed: int, size: Column, *ids: Column) -> Column:
    """A draw from 0 to size - 1 by the first 32 bits of an md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in ids)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size


#: Runs whose values are broadcast at most (16 MB); more are joined by place. Draws that one row stands for until they are made.
BROADCAST_RUNS, DRAWN_AT_ONCE = 1 << 20, 1 << 12


def bootstrap_mean(values: DataFrame, place: str, value: str, draws: int = 5000, seed: int = 0, least: int = 5) -> DataFrame:
    """low and high: the 95 % interval of the mean over draws with replacement; no row for fewer than `least` values.

    values has a row for each run (places 1 to n); they are counted when this is called. The draws times n picks are dealt
    out in blocks over all tasks; four of them come from the digits of one md5. Up to BROADCAST_RUNS values are sent to the tasks, so that
    only a sum for each draw and task is shuffled. Of more values, picks are first counted by draw and place, and the
    counts are joined to the values by place.
    """
    spark = values.sparkSession
    runs = values.select(place, value)
    n = runs.count()
    fours = -(-n // 4)
    blocks = max(1, -(-fours // DRAWN_AT_ONCE))
    if n < least:
        draws = 0
    each = spark.range(0, draws * blocks, 1, min(draws * blocks, max(spark.sparkContext.defaultParallelism, draws * n >> 22)) or 1)
    low = F.pmod("id", F.lit(blocks)) * DRAWN_AT_ONCE
    each = each.select(F.expr(f"id div {blocks}").alias("b"), F.explode(F.sequence(low, F.least(low + DRAWN_AT_ONCE, F.lit(fours)) - 1)).alias("i"))
    each = each.select("b", "i", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))).alias("h"))
    picks = F.array(*(F.when(F.col("i") * 4 + k < n, F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") % n + 1) for k in range(4)))
    drawn = each.select("b", F.explode(picks).alias(place))
    if n <= BROADCAST_RUNS:
        sums = drawn.join(F.broadcast(runs), place).groupBy("b").agg((F.sum(value) / F.count(value)).alias("m"))
    else:
        often = drawn.groupBy("b", place).agg(F.count("*").alias("__n")).join(runs, place)
        sums = often.groupBy("b").agg((F.sum(F.col("__n") * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), F.col("__n")))).alias("m"))
    at = sums.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count("*").alias("draws")).filter("draws > 0")
    return at.select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "draws")


def contrasted(rows: DataFrame, key: str, group: str, groups: list[str], value: str, contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """Means of groups side by side, and differences between pairs of them."""
    wide = rows.groupBy(key).pivot(group, groups).agg(F.avg(value))
    return wide.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in contrasts.items()})


def top(rows: DataFrame, value: str, tie: str, k: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(value), tie).limit(k)


def top_within(rows: DataFrame, value: str, ties: list[str], keys: list[str], k: int = 5) -> DataFrame:
    """The k largest in each group, ascending: the last is the best."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), *ties)
    best = rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k)
    item = F.struct(F.col(value), *(F.col(t) for t in ties))
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("top"))


def z_of_max(rows: DataFrame, value: str, place: list[str], *keys: str) -> DataFrame:
    """The largest value, where it is (the first place of equals), and its z-score against all values of the group."""
    first = F.struct(F.col(value), *(-F.col(p) for p in place))
    out = rows.groupBy(*keys).agg(F.max(first).alias("m"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    where = {f"at_{p}": -F.col(f"m.col{k + 2}") for k, p in enumerate(place)}
    return out.select(*keys, F.col(f"m.{value}").alias("max"), *(c.alias(n) for n, c in where.items()), "mean", ((F.col(f"m.{value}") - F.col("mean")) / (F.col("std") + 1e-9)).alias("z"))


def curve(trajectories: DataFrame, key: str = "direction", points: str = "trajectory", value: str = "transfer_flip") -> DataFrame:
    """Mean and deviation over runs at each step, as far as the group's shortest run goes."""
    shortest = trajectories.groupBy(key).agg(F.min(F.size(points)).alias("__n"))
    each = trajectories.join(shortest, key).select(key, "__n", F.posexplode(points).alias("pos", "p")).filter("pos < __n")
    return each.groupBy(key, F.col("p.step").alias("step")).agg(F.avg(f"p.{value}").alias("mean"), F.stddev_pop(f"p.{value}").alias("std"), F.count("*").alias("n"))
