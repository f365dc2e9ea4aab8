"""What all operators of this subpackage need from the session: the shared folder, sizes of plans, worker paths."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch sent to Python at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ready(spark: SparkSession) -> None:
    """Let Python workers find this package where the session runs it from a source folder, and get batches of bounded size."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    # Rows are whole texts, so batches of ten thousand of them may be of any size.
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.isModifiable(key) and not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    """A setting's number, in bytes where it has a unit."""
    found = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on one machine (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandlab-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Whether Spark drops a statement's shuffles as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Statements within drop their shuffles as they end, not when the driver's garbage happens to be collected; the
    caller's setting is put back."""
    before = spark.conf.get(_CLEANUP, None) if spark.conf.isModifiable(_CLEANUP) else "true"
    if before == "true":
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/strandlab/{tag}-{uuid.uuid4().hex}"
    with _own_shuffles_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more, as later ones hold what they held."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["written_to"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column's name that means nothing but itself, also with dots or ticks in it."""
    return "`" + name.replace("`", "``") + "`"


def whole(columns: list[str]) -> Column:
    """The columns as one struct, so that their names meet no others; a constant's for none."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in columns)) if columns else F.struct(F.lit(0).alias("none"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one aggregate: the plan's own estimate is useless after joins and for data without files."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The contract's words as an array; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """How many words, without making them: separators become one character, then runs of it are counted by split."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
