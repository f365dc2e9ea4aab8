"""Deterministic shuffles, splits and samples by hash order: md5 of seed and id, the same in any engine and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int | Column, *ids: str) -> Column:
    """The md5 that orders rows; the seed may be a column, for many orders at once."""
    own = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", own, *(F.col(i).cast("string") for i in ids)))


def bucketed_sum(rows: DataFrame, value: Column, bucket: Column, order: list[Column | str], before: bool = False, name: str = "running", by: list[str] | None = None) -> DataFrame:
    """Running sum of value over the whole table in the given order, or over each group of `by`, without bringing a table
    or group to one task.

    bucket must ascend with the order; a null bucket comes first, as nulls do in the order. Sums of buckets are added up
    first (one small row each), rows only within their bucket.
    before: without the row's own value.
    """
    by = by or []
    rows = rows.withColumns({"__b": bucket, "__v": value})
    sums = rows.groupBy(*by, "__b").agg(F.sum("__v").alias("__s"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    of = {k: f"__of{i}" for i, k in enumerate([*by, "__b"])}
    sums = sums.withColumn("__base", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).select(*(F.col(k).alias(n) for k, n in of.items()), "__base")
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    total = F.col("__base") + F.coalesce(F.sum("__v").over(inside), F.lit(0))
    on = F.lit(True)
    for k, n in of.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return rows.join(sums, on).withColumn(name, total).drop("__b", "__v", "__base", *of.values())


def shuffled_rank(rows: DataFrame, seed: int | Column, *ids: str, digits: int = 4, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Each row's place in the shuffled order, from 1, or in that of its group of `by`. 16^digits buckets: more than small
    tables have rows, and a million and a half rows each of a hundred billion."""
    rows = rows.withColumn("__h", hash_key(seed, *ids))
    return bucketed_sum(rows, F.lit(1), F.substring("__h", 1, digits), ["__h", *ids], name=name, by=by).drop("__h")


def shuffled_head(rows: DataFrame, seed: int, n: int, *ids: str) -> DataFrame:
    """The first n rows of the shuffled order."""
    return rows.withColumn("__h", hash_key(seed, *ids)).orderBy("__h", *ids).limit(n).drop("__h")


def split(rows: DataFrame, seed: int, n_test: int, *ids: str) -> DataFrame:
    """A test split of exactly n_test rows; the rest is for training."""
    out = shuffled_rank(rows, seed, *ids)
    return out.withColumn("split", F.when(F.col("rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))).drop("rank")


def splits(rows: DataFrame, seeds: list[int], n_test: int, *ids: str) -> DataFrame:
    """split() for many seeds from one scan: each row once for each seed, with seed and split. The order is counted by
    seed and bucket, so more seeds are more groups and no more passes."""
    each = F.broadcast(rows.sparkSession.createDataFrame([(s,) for s in seeds], "seed int"))
    out = shuffled_rank(rows.crossJoin(each), F.col("seed"), *ids, by=["seed"])
    return out.withColumn("split", F.when(F.col("rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))).drop("rank")


def balanced(rows: DataFrame, seed: int, n: int, *ids: str, label: str = "label") -> DataFrame:
    """n // 2 rows of label 1 and the rest of label 0, without replacement."""
    parts = [shuffled_head(rows.filter(F.col(label) == y), seed, k, *ids) for y, k in ((1, n // 2), (0, n - n // 2))]
    return parts[0].unionByName(parts[1])


def placed_mixture(remote: DataFrame, standard: DataFrame, seed: int, n: int, share: float, *ids: str, label: str = "label") -> DataFrame:
    """mixture, with place: the position in one last shuffle over both parts, from 1."""
    rows = mixture(remote, standard, seed, n, share, *ids, label=label)
    return shuffled_rank(rows, seed, "part", *ids, name="place")


def mixture(remote: DataFrame, standard: DataFrame, seed: int, n: int, share: float, *ids: str, label: str = "label") -> DataFrame:
    """A balanced sample of n rows, share of them remote; the standard part draws with the next seed. part names the origin."""
    of_remote = round(n * share)
    parts = [balanced(remote, seed, of_remote, *ids, label=label).withColumn("part", F.lit("remote")), balanced(standard, seed + 1, n - of_remote, *ids, label=label).withColumn("part", F.lit("standard"))]
    return parts[0].unionByName(parts[1])


def fraction(rows: DataFrame, seed: int, share: float, *ids: str, least: int = 64) -> DataFrame:
    """max(least, floor(n * share)) rows; all for a share of one or more."""
    if share >= 1:
        return rows
    most = F.greatest(F.lit(least), F.floor(rows.agg(F.count("*") * share).scalar()))
    return shuffled_rank(rows, seed, *ids, name="__rank").filter(F.col("__rank") <= most).drop("__rank")


def placed(rows: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """rows with place: the position in the order of an integer key, from 1; width keys make a bucket."""
    return bucketed_sum(rows, F.lit(1), F.floor(F.col(key) / width), [key], name="place")


def mixtures(remote: DataFrame, standard: DataFrame, seeds: list[int], n: int, share: float, n_test: int, *ids: str, label: str = "label") -> DataFrame:
    """placed_mixture() for many seeds from one scan of each source, with seed, and split: the first n_test places are for
    testing."""
    each = F.broadcast(remote.sparkSession.createDataFrame([(s,) for s in seeds], "seed int"))

    def part(rows: DataFrame, after: int, most: int, name: str) -> DataFrame:
        ranked = shuffled_rank(rows.crossJoin(each), F.col("seed") + after, *ids, name="__r", by=["seed", label])
        kept = F.when(F.col(label) == 1, F.col("__r") <= most // 2).when(F.col(label) == 0, F.col("__r") <= most - most // 2)
        return ranked.filter(kept).drop("__r").withColumn("part", F.lit(name))

    of_remote = round(n * share)
    both = part(remote, 0, of_remote, "remote").unionByName(part(standard, 1, n - of_remote, "standard"))
    out = shuffled_rank(both, F.col("seed"), "part", *ids, name="place", by=["seed"])
    return out.withColumn("split", F.when(F.col("place") <= n_test, F.lit("test")).otherwise(F.lit("train")))
