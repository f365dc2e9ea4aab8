"""Sinks: appended records, single documents, task files, token-capped corpora and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.corpus import capped


def append_records(records: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Adds records. With a key each run has a partition of its own, which is replaced as a whole when the run comes again:
    nothing that is there is read, a repeated run adds nothing, and writers of different runs don't meet. Of rows that share
    a key within `records` one is written.
    """
    if key:
        own = records.dropDuplicates(key).repartition(*key)
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).json(path)
    else:
        records.write.mode("append").json(path)


def overwrite_document(row: DataFrame, path: str) -> None:
    """One row as one indented JSON document."""
    options = {"pretty": "true"}
    row.select(F.to_json(F.struct(*row.columns), options).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_task(examples: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split."""
    examples.write.mode("overwrite").partitionBy("split").json(path)


def write_capped(rows: DataFrame, path: str, order: list[str], bucket: Column, tokens: Column, target: int, text: str = "text") -> DataFrame:
    """Writes lines until their tokens reach the target; returns the manifest row (file, tokens, lines)."""
    kept = capped(rows, order, bucket, tokens, target)
    kept.select(F.col(text).alias("value")).write.mode("overwrite").text(path)
    return kept.agg(F.lit(path).alias("file"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("lines"))


def write_manifest(groups: DataFrame, path: str, target: int, seed: int) -> None:
    """groups(group, file, tokens, lines), a row for each corpus, as one nested document."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", F.struct("file", "tokens", "lines")))))
    overwrite_document(groups.agg(F.lit(target).alias("target_tokens"), F.lit(seed).alias("seed"), entry.alias("groups")), path)


def write_summary(lines: DataFrame, path: str) -> None:
    """(line_no, text) as one text file; summaries have a few dozen lines."""
    lines.coalesce(1).sortWithinPartitions("line_no").select(F.col("text").alias("value")).write.mode("overwrite").text(path)
