"""Run records as they arrive: metrics that follow a growing folder, restarts without double counting, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlab.operators.corpus import capped
from strandlab.schemas import RECORDS


def arriving(spark: SparkSession, folder: str, kind: str, files_at_once: int = 64) -> DataFrame:
    """Records of files that producers add to a folder."""
    return spark.readStream.schema(RECORDS[kind]).option("maxFilesPerTrigger", files_at_once).json(folder)


def summarised(stream: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, population std and n so far; state holds a few numbers for each group."""
    return stream.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def once(stream: DataFrame, key: list[str], time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each run's record once, however often a restarted producer writes it.

    The keys seen are kept for ever, as a run may come back at any time; where records carry a time, they are kept as
    long as a repeated one may be late.
    """
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def follow(table: DataFrame, path: str, checkpoint: str, keys: list[str], available_now: bool = True, every: int = 20) -> StreamingQuery:
    """Keeps an aggregate's result as Parquet, which followed() reads; with available_now it ends after what is there.

    Each micro-batch writes the groups that it changed as a version of their own; after every `every`-th one all groups as
    they are then are written once more, and what is older goes. A batch that is played again after a crash overwrites its
    own version, so a restart counts nothing twice.
    """
    from strandlab.sources.readers import exists

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/merged=0/version={number}")
        if number % every == every - 1:
            whole = f"{path}/merged=1/version={number}"
            if not exists(spark, f"{whole}/_SUCCESS"):
                followed(spark, path, keys).write.mode("overwrite").parquet(whole)
            hadoop = spark._jvm.org.apache.hadoop.fs
            store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
            for s in store.globStatus(hadoop.Path(f"{path}/merged=*/version=*")) or []:
                at = s.getPath()
                if (int(at.getName().partition("=")[2]), at.getParent().getName()) < (number, "merged=1"):
                    store.delete(at, True)

    writer = table.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def followed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The result that follow() keeps, as far as it has come: the newest row of each group."""
    versions = spark.read.parquet(path)
    rest = [c for c in versions.columns if c not in [*keys, "version", "merged"]]
    out = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("version", "merged")).alias("__newest"))
    return out.select(*keys, *(F.col("__newest").getField(c).alias(c) for c in rest))


def windowed(events: DataFrame, time: str, value: str, *keys: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and mean for each event-time window; time without zone is read as UTC, as watermarks need instants."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def write_until(stream: DataFrame, path: str, target: int, tokens, checkpoint: str, order: list[str] | None = None) -> int:
    """Writes micro-batches of texts until their tokens reach the target, then stops; returns the tokens written.

    The batch that crosses the target is cut within, in the given order (by default the texts' own), with the row that
    crosses. Each batch has a folder of its own, which is overwritten if the batch is played again after a crash; what
    counts towards the target is what earlier batches have written, so a restart with the same checkpoint goes on from there.
    """
    spark, order = stream.sparkSession, order or ["text"]
    from strandlab.sources.readers import exists

    def total(before: int | None = None) -> int:
        if not exists(spark, f"{path}/batch=*"):
            return 0
        rows = spark.read.parquet(path)
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        return rows.agg(F.sum("n_tokens")).first()[0] or 0

    def add(batch: DataFrame, number: int) -> None:
        left = target - total(number)
        if left > 0:
            # Sums by the order's first letters first; a batch below the target passes whole.
            bucket = F.substring(F.col(order[0]).cast("string"), 1, 1) if dict(batch.dtypes)[order[0]] == "string" else F.col(order[0])
            capped(batch, order, bucket, tokens.cast("long"), left).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return total()
