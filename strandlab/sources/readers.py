"""Sources: sequence files, pair tables, tasks, run records, corpora and the catalog of finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.schemas import PAIR, RECORDS, SENTENCE


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) names something, in whatever store it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def fasta(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """seq_id and seq of each record of a FASTA file: headers dropped, white space removed.

    seq_id is a hash of the record with its header, so it is the same however the files are split; equal records share
    one. Records are split by Spark's own line reader, so a large file is read in parallel. With `most` only the first
    records count, in order of files and of places within them, however the files are split. Records without residues are
    left out.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.regexp_replace("value", r"^>?[^\n]*\n?", ""), r"\s+", "")
    name = F.regexp_replace("value", r"^>|\s+$", "")
    out = raw.select(F.xxhash64(name).alias("seq_id"), body.alias("seq"), *_place()).filter("seq <> ''")
    return (out.orderBy("__file", "__block", "__row").limit(most) if most else out).select("seq_id", "seq")


def pairs_csv(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """Sentence pairs with a header line; quoted fields may hold commas, quotes and line ends."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def pairs_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Pairs kept as Parquet with a folder split=... for each split; a split prunes partitions."""
    out = spark.read.parquet(path)
    return out.filter(F.col("split") == split).drop("split") if split else out


def task_json(spark: SparkSession, path: str, schema: str = SENTENCE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def as_pairs(sentences: DataFrame) -> DataFrame:
    """Single sentences as pairs without a second sentence."""
    return sentences.select(F.col("sentence").alias("sentence1"), F.lit(None).cast("string").alias("sentence2"), "label")


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Run records of a kind, one JSON object a line; a file that isn't there has no rows."""
    schema = RECORDS[kind]
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def document_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document over many lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def _place() -> list[Column]:
    """Where a row of a text file stands: file, start of the block that a task read it from, and the order within a task."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")]


def lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """text of each line; with `most` of the first ones, in order of files and of places within them."""
    rows = spark.read.text(path).withColumnRenamed("value", "text")
    return rows.select("text", *_place()).orderBy("__file", "__block", "__row").limit(most).select("text") if most else rows


def lines_stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Lines of files as they come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path).withColumnRenamed("value", "text")


def available(requested: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    """Requested runs that exist."""
    return requested.join(catalog, on, "left_semi")


def pending(requested: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    """Requested runs that don't exist yet."""
    return requested.join(catalog, on, "left_anti")


def run_catalog(spark: SparkSession, folder: str, base_models: dict[str, str] | None = None) -> DataFrame:
    """base, group, seed and path of all checkpoints `<base>/<group>_seed<seed>` of a folder, from one listing.

    base_models (name -> path) are added as group `base` without a seed. Slashes of a base's name are underscores in the
    folder; base is the folder's name.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{folder}/*/*_seed*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = spark.createDataFrame([(s.getPath().toString(),) for s in found if s.isDirectory()], "path string")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)_seed(\d+)$", k)
    runs = paths.filter(part(3) != "").select(part(1).alias("base"), part(2).alias("group"), part(3).cast("int").alias("seed"), "path")
    own = [(name.replace("/", "_"), "base", None, path) for name, path in (base_models or {}).items()]
    return runs.unionByName(spark.createDataFrame(own, "base string, `group` string, seed int, path string"))
