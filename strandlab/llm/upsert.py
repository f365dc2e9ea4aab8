"""Keyed upserts into a table of sorted Parquet files: merge on read first, compaction of the marked files after.

The table is a folder of files sorted by an integer key, each with the keys of one range. A file is home to the keys from
its first one up to the next file's first; smaller keys than any have the first file as home. Changes are staged beside the
table, keyed by file and Parquet row_index: deletion vectors (rows that go) and upsert deltas (columns that are set, or rows
to insert, without a row_index). Only effective changes are staged: a deletion of a row that is there, a row whose columns
then differ (nulls are equal), a key that is new. `merged` reads the table through them; `compact` writes the marked files
anew and no other.

Nothing that grows with the rows goes through the driver: it plans over one entry for each file (key range, rows, path).
Rows are placed by a range-partitioned sort and each file is written by one task as a stream. New files are committed
before old ones are deleted; a job that is lost between leaves the old table and files that a new run starts without, as
each run has a folder of its own.

Rows without a key aren't stored and changes without one do nothing. Of a key that stands in several stored rows each row
is changed. An empty table has no files and so no homes: changes do nothing there. Other columns may have any names but
those of `_metadata`; their values are kept, and are null in inserted rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.llm.ordering import numbered
from strandlab.llm.shared import quoted, shared_folder, written


@dataclass(frozen=True)
class File:
    path: str
    first: int
    rows: int


@dataclass
class Staged:
    """Changes beside a table: vectors(file, row) and deltas(file, row, key and the set columns), files by number."""

    folder: str
    schema: T.StructType
    key: str
    columns: list[str]
    files: list[File]
    vectors: DataFrame
    deltas: DataFrame


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/strandlab/{tag}-{uuid.uuid4().hex}"


def create(rows: DataFrame, key: str, folder: str, file_rows: int) -> None:
    """Writes rows as files of exactly file_rows rows, sorted by key; the last has the rest. No rows, no files."""
    own = F.col(quoted(key))
    whole = F.struct(*(F.col(quoted(c)) for c in rows.columns))
    placed = numbered(rows.filter(own.isNotNull()).select(own.alias("key"), whole.alias("all")), "key")
    n = placed.count()
    if n:
        out = placed.withColumn("file", F.expr(f"cast(place div {file_rows} as int)")).repartitionById(-(-n // file_rows), "file").sortWithinPartitions("file", "place")
        out.select(*(F.col("all").getField(c).alias(c) for c in rows.columns)).write.option("maxRecordsPerFile", 0).parquet(folder)


def _read(spark: SparkSession, schema: T.StructType, paths: list[str] | str) -> DataFrame:
    """The rows of files as __all, with __path and __row; what isn't taken out of __all isn't read."""
    own = spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))
    return own.select(F.struct(*(F.col(quoted(f.name)) for f in schema)).alias("__all"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))


def _cell(name: str) -> Column:
    return F.col("__all").getField(name)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def files(spark: SparkSession, folder: str, schema: T.StructType, key: str) -> list[File]:
    """The table's files in order of their keys: one entry for each."""
    if not _exists(spark, folder):
        return []
    own = _read(spark, schema, folder).groupBy("__path").agg(F.min(_cell(key)).alias("first"), F.count("*").alias("n"))
    return sorted((File(*r) for r in own.collect()), key=lambda f: f.first)


def home(table: list[File]):
    """key -> the number of its home."""
    firsts = np.array([f.first for f in table], np.int64)

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(firsts, keys.to_numpy(np.int64), "right") - 1, 0).astype(np.int32))

    return of


def _by_number(rows: DataFrame, table: list[File]) -> DataFrame:
    """rows with the number of their file for its path; the list of files has an entry for each and is sent to all tasks."""
    names = rows.sparkSession.createDataFrame([(f.path, k) for k, f in enumerate(table)], "__path string, __file int")
    return rows.join(F.broadcast(names), "__path").drop("__path")


def stage(spark: SparkSession, folder: str, schema: T.StructType, key: str, changes: DataFrame, columns: list[str], deleted: Column, table: list[File] | None = None) -> Staged:
    """Stages changes(key, columns...), one row for each key; `deleted` says which of them delete.

    One join by key between the changes and the key and set columns of the table finds the rows; other columns aren't read.
    """
    table = files(spark, folder, schema, key) if table is None else table
    own = changes.filter(F.col(quoted(key)).isNotNull()).select(F.col(quoted(key)).cast("long").alias("__key"), F.coalesce(deleted, F.lit(False)).alias("__gone"), F.struct(*(F.col(quoted(c)).cast(schema[c].dataType).alias(c) for c in columns)).alias("__set"))
    if table:
        held = _by_number(_read(spark, schema, folder), table)
        held = held.select(_cell(key).cast("long").alias("__key"), "__file", "__row", F.struct(*(_cell(c).alias(c) for c in columns)).alias("__was"))
        both = own.join(held, "__key", "left").withColumn("__file", F.coalesce("__file", home(table)("__key")))
    else:
        both = own.filter("false").select("*", F.lit(None).cast("int").alias("__file"), F.lit(None).cast("long").alias("__row"), F.col("__set").alias("__was"))
    there = F.col("__row").isNotNull()
    both = both.filter(F.when(F.col("__gone"), there).otherwise(~there | ~F.col("__set").eqNullSafe(F.col("__was"))))
    staged = written(both.select("__file", "__row", "__key", "__gone", "__set"), "upsert-staged")
    return Staged(folder, schema, key, columns, table, staged.filter("__gone").select("__file", "__row"), staged.filter("not __gone").select("__file", "__row", "__key", "__set"))


def _merged(staged: Staged, spark: SparkSession, numbers: list[int]) -> DataFrame:
    """The rows of some files, the marked ones among them, as they are to be read: __file and __new."""
    s, names = staged, [f.name for f in staged.schema]
    held = _by_number(_read(spark, s.schema, [s.files[k].path for k in numbers]), s.files)
    place = ["__file", "__row"]
    held = held.join(s.vectors, place, "left_anti").join(s.deltas.filter("__row is not null").select(*place, "__set"), place, "left")
    changed = F.col("__set").isNotNull()
    value = {c: F.when(changed, F.col("__set").getField(c)).otherwise(_cell(c)) if c in s.columns else _cell(c) for c in names}
    new = {c: F.col("__set").getField(c) if c in s.columns else F.col("__key") if c == s.key else F.lit(None) for c in names}
    row = lambda cells: F.struct(*(cells[f.name].cast(f.dataType).alias(f.name) for f in s.schema)).alias("__new")
    inserted = s.deltas.filter(F.col("__row").isNull()).select("__file", row(new))
    return held.select("__file", row(value)).unionByName(inserted)


def merged(staged: Staged, spark: SparkSession) -> DataFrame:
    """The table read through its vectors and deltas, in no order."""
    if not staged.files:
        return spark.createDataFrame([], staged.schema)
    return _merged(staged, spark, list(range(len(staged.files)))).select(*(F.col("__new").getField(f.name).alias(f.name) for f in staged.schema))


def pieces(rows: int, most: int) -> list[int]:
    """The fewest sizes of at most `most` that make up rows, at most one apart, larger first."""
    n = -(-rows // most)
    return [rows // n + (k < rows % n) for k in range(n)]


def planned(sizes: dict[int, int], n_files: int, most: int) -> list[int]:
    """Sizes of the files that replace the marked ones (number -> rows then), in order: each piece joins the piece left of
    it if no unmarked file stands between and both have at most `most` rows together."""
    out, open_ = [], False
    for k in range(n_files):
        if k not in sizes:
            open_ = False
            continue
        for size in pieces(sizes[k], most) if sizes[k] else []:
            if open_ and out[-1] + size <= most:
                out[-1] += size
            else:
                out.append(size)
            open_ = True
    return out


def compact(staged: Staged, spark: SparkSession, file_rows: int) -> int:
    """Rewrites the marked files, as planned, and deletes what they replace; returns how many files were written."""
    s = staged
    change = s.vectors.select("__file", F.lit(-1).alias("__n")).unionByName(s.deltas.select("__file", F.when(F.col("__row").isNull(), 1).otherwise(0).alias("__n")))
    more = {r[0]: r[1] for r in change.groupBy("__file").agg(F.sum("__n")).collect()}
    if not more:
        return 0
    sizes = {k: s.files[k].rows + n for k, n in more.items()}
    until = list(accumulate(planned(sizes, len(s.files), file_rows)))
    if until:
        rows = written(_merged(s, spark, sorted(sizes)), "upsert-merged")
        placed = numbered(rows, "__file", F.col("__new").getField(s.key), name="__place")
        bounds = np.array(until, np.int64)

        @F.pandas_udf("int")
        def target(places: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, places.to_numpy(np.int64), "right").astype(np.int32))

        out = placed.withColumn("__out", target("__place")).repartitionById(len(until), "__out").sortWithinPartitions("__out", "__place")
        out.select(*(F.col("__new").getField(f.name).alias(f.name) for f in s.schema)).write.mode("append").option("maxRecordsPerFile", 0).parquet(s.folder)
        _delete(spark, [rows.__dict__["written_to"]])
    _delete(spark, [s.files[k].path for k in sizes])
    return len(until)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, key, cents, crc) sorted by file and key as a row for each file, hashed as they stream by."""
    import hashlib

    out, now = [], None
    for batch in batches:
        number, key, cents, crc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            text = ",".join(map(str, key[a:b].tolist())).encode()
            if now is None or now[0] != number[a]:
                now = [int(number[a]), int(key[a]), 0, 0, 0, hashlib.sha256()]
                out.append(now)
            else:
                text = b"," + text
            now[2] += b - a
            now[3] += int(cents[a:b].sum())
            now[4] += int(crc[a:b].sum())
            now[5].update(text)
    rows = [[*x[:5], x[5].hexdigest()] for x in out]
    names = ["__file", "first_id", "n_rows", "cents", "rows_crc", "ids_sha256"]
    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}, pa.schema(list(zip(names, [pa.int32(), *[pa.int64()] * 4, pa.string()], strict=True))))


def described(spark: SparkSession, folder: str, schema: T.StructType, key: str, table: list[File], cents: Callable[[Callable], Column], crc: Callable[[Callable], Column]) -> DataFrame:
    """__file, first_id, n_rows, sums of cents and crc (each made of cells: name -> Column), and the SHA-256 of the keys joined by commas, for each file.

    Each file's rows meet in one task in order of the key and are hashed as a stream; a task may have many files.
    """
    parts = min(len(table), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = _by_number(_read(spark, schema, folder), table).select("__file", _cell(key).cast("long").alias("__key"), cents(_cell).cast("long").alias("__cents"), crc(_cell).cast("long").alias("__crc"))
    rows = rows.repartitionById(parts, F.col("__file") % parts).sortWithinPartitions("__file", "__key")
    return rows.mapInArrow(_digests, "__file int, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")
