"""Corpora: cleaning, token budgets and block packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts without outer white space and with spaces for line ends; empty ones go."""
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    return docs.withColumn(text, F.replace(trimmed, F.lit("\n"), F.lit(" "))).filter(F.length(text) > 0)


def capped(rows: DataFrame, order: list[str], bucket: Column, tokens: Column, target: int) -> DataFrame:
    """Rows in order until their tokens reach the target, with the row that crosses it; n_tokens is added.

    bucket ascends with the order; a null one comes first. Sums of buckets find the one that crosses. Rows of earlier
    buckets pass by a filter, those of later ones are dropped by it, and only the crossing bucket's rows are ordered: no
    other row is shuffled.
    """
    rows = rows.withColumn("n_tokens", tokens)
    sums = rows.groupBy(bucket.alias("b")).agg(F.sum("n_tokens").alias("s"))
    so_far = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(so_far), F.lit(0))).filter(F.col("before") < target)
    last = sums.agg(F.struct(F.max("b").alias("b"), F.coalesce(F.max("before"), F.lit(0)).alias("before"))).scalar()
    crossing = rows.filter(bucket.eqNullSafe(last["b"]))
    inside = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    crossing = crossing.withColumn("__so_far", last["before"] + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    earlier = rows.filter((bucket < last["b"]) | (bucket.isNull() & last["b"].isNotNull()))
    return earlier.unionByName(crossing.filter(F.col("__so_far") < target).drop("__so_far"))


def packed(rows: DataFrame, batch: Column, order: list[str], tokens: str, size: int) -> DataFrame:
    """Blocks of exactly size tokens from the token arrays of each batch put end to end; each batch's rest is dropped.

    A batch is a bounded number of rows, as in a batched map. batch, block and block_tokens come out. Each row is cut at
    the blocks' bounds, so a slice travels for each row and block, and no token by itself.
    """
    rows = rows.withColumn("batch", batch)
    n = F.size(tokens)
    earlier = Window.partitionBy("batch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    first, last = F.floor(F.col("__at") / size), F.floor((F.col("__at") + n - 1) / size)
    each = rows.filter(n > 0).select("batch", "__at", F.col(tokens).alias("__t"), F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.lit(0), F.col("block") * size - F.col("__at")).cast("int")
    high = F.least(F.size("__t"), ((F.col("block") + 1) * size - F.col("__at")).cast("int"))
    parts = each.select("batch", "block", (F.col("__at") + low).alias("__p"), F.slice("__t", low + 1, high - low).alias("__x"))
    blocks = parts.groupBy("batch", "block").agg(F.sum(F.size("__x")).alias("__n"), F.sort_array(F.collect_list(F.struct("__p", "__x"))).alias("__y"))
    return blocks.filter(F.col("__n") == size).select("batch", "block", F.flatten(F.transform("__y", lambda y: y["__x"])).alias("block_tokens"))


def mapped(rows: DataFrame, batch_rows, schema: str) -> DataFrame:
    """Rows made by batch_rows(pandas frame) -> pandas frame, for what built-in functions can't say; any number of rows
    may come out of a batch. Batches follow Spark's Arrow batches, so batch_rows must not depend on where they are cut."""
    return rows.mapInPandas(lambda frames: map(batch_rows, frames), schema)


def truncated_pair(a: Column, b: Column, length: int) -> tuple[Column, Column]:
    """Two token arrays cut to `length` tokens together, always taking from the longer one; of equals from the second."""
    m, n = F.size(a), F.size(b)
    over = F.greatest(F.lit(0), m + n - length)
    # Cutting the longer first brings both to the same size before the shorter one loses anything.
    only = F.least(over, F.abs(m - n))
    rest = over - only
    from_a = F.when(m > n, only).otherwise(0) + F.floor(rest / 2).cast("int")
    from_b = F.when(m > n, 0).otherwise(only) + F.ceil(rest / 2).cast("int")
    return F.slice(a, 1, m - from_a), F.slice(b, 1, n - from_b)


def padded(tokens: Column, length: int, pad: Column) -> tuple[Column, Column]:
    """Tokens cut or filled to a length, and the mask of true ones."""
    short = F.slice(tokens, 1, length)
    fill = F.greatest(F.lit(0), F.lit(length) - F.size(short))
    return F.concat(short, F.array_repeat(pad, fill)), F.concat(F.array_repeat(F.lit(1), F.size(short)), F.array_repeat(F.lit(0), fill))


def unknown_share(rows: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", most_rows: int = 200, most_tokens: int | None = None, order: str = "example_id") -> DataFrame:
    """unk_frac: the share of unknown tokens in the first rows, to 4 places; 0 for no tokens.

    vocabulary(token) is joined by Spark's own choice of strategy.
    """
    first = rows.orderBy(order).limit(most_rows)
    own = F.slice(tokens, 1, most_tokens) if most_tokens else F.col(tokens)
    each = first.select(F.explode(own).alias("token"))
    known = vocabulary.select("token").distinct().withColumn("known", F.lit(1))
    joined = each.join(known, "token", "left")
    share = F.count_if(F.col("known").isNull()) / F.greatest(F.count("*"), F.lit(1))
    return joined.agg(F.round(share, 4).alias("unk_frac"), F.count("*").alias("n_tokens"))
