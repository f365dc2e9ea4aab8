"""Exact top-k inner product search over a vector-approximation file.

Each component is cut to one of 2^bits cells of its range over all vectors; a vector's approximation is its cells, a
byte each. They are written as a table of their own. The inner product with a query lies within a distance of the
product with the cells' midpoints that depends on the query alone: half the cell widths times the query's absolute
components. So one scan of the approximations, which reads no exact vector, gives bounds for each vector; it carries the
best lower bounds found so far through a partition, and passes on the vectors whose upper bound still reaches them.

Exact vectors are then read in the order of their upper bounds, in two steps: the first few of each query settle a kth
score that is certain, and of the others only those whose bound reaches it are read. Equal vectors are one entry with
their smallest ids, as no more can be among the best, so a vector that many rows share is scored once.

Vectors: null ones, and those with null or non-finite components, take no part. Components become
floor(scale * x); scores must fit 64 bits. Vectors whose length differs from the query's are not its candidates; empty
vectors score 0 with empty queries. Candidates are all rows whose id differs from the query's; of repeated rows each
counts. Query rows with one id and different vectors are queries of their own. Ties go to the smaller id. A null id is
neither a query nor a candidate. With fewer than k candidates all are returned. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.shared import forget, ready, written

K, BITS, SCALE = 5, 8, 256
#: Components of queries broadcast at once (a block's size doesn't follow the input), and approximations scanned at once.
QUERY_COMPONENTS, SCAN_BLOCK = 1 << 19, 4096
#: Exact vectors of each query read in the first step, for each of the k.
FIRST = 4


def cells(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and the integer vector, of the rows that take part."""
    x = F.col(vector)
    fit = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return vectors.filter(F.col(id_col).isNotNull() & fit).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors their rows, and them as a matrix."""
    column = column.cast(pa.large_list(pa.int64()))
    ends = np.asarray(column.offsets, np.int64)
    values, sizes = np.asarray(column.values, np.int64), np.diff(ends)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, values[ends[rows][:, None] + np.arange(n)]


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, place, low and high of each component of the vectors of each length."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, x in _matrices(batch.column("v")):
            n, low, high = x.shape[1], x.min(0), x.max(0)
            before = found.get(n, (low, high))
            found[n] = np.minimum(before[0], low), np.maximum(before[1], high)
    for n, (low, high) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], ["n", "place", "low", "high"])


Grid = dict[int, tuple[np.ndarray, np.ndarray]]


def grid(exact: DataFrame, bits: int) -> Grid:
    """Lowest value and cell width of each component, by length: as large as the vectors are wide."""
    found = exact.select("v").mapInArrow(_extremes, "n int, place int, low long, high long")
    out: Grid = {}
    for n, rows in found.groupBy("n", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().groupby("n"):
        rows = rows.sort_values("place")
        low, high = rows["low"].to_numpy(float), rows["high"].to_numpy(float)
        out[int(n)] = low, np.maximum((high - low + 1) / (1 << bits), 1e-9) * (1 + 1e-12)
    return out


def coded(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return ((x - low) / width).astype(np.uint8)


def _approximator(own: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [b""] * len(batch)
            for rows, x in _matrices(batch.column("v")):
                if x.shape[1]:
                    for r, c in zip(rows.tolist(), coded(x, *own[x.shape[1]]), strict=True):
                        codes[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(codes, pa.binary())], ["rep", "code"])

    return run


class Queries:
    """The queries of one length, with what their bounds need."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, low: np.ndarray, width: np.ndarray):
        d = vectors.shape[1]
        size = np.abs(vectors.astype(float))
        far = np.maximum(np.abs(low), np.abs(low + width * 256))
        kind = np.float32 if float((size @ far).max(initial=0)) < 1e30 else np.float64
        # Half a cell for each component, and what the arithmetic may be off.
        self.slack = size @ (width / 2) + (d + 8) * np.finfo(kind).eps * (size @ far) + 1e-6
        self.keys, self.vectors, self.low, self.width, self.kind = keys, vectors.astype(kind), low, width, kind

    def middles(self, codes: np.ndarray) -> np.ndarray:
        """The products with the cells' midpoints, a row for each query."""
        return self.vectors @ (self.low + (codes + 0.5) * self.width).astype(self.kind).T


def reach(own: Queries, codes: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries and approximations whose upper bound reaches the best lower bounds, that bound, and the bounds to go on with.

    best has the k + 1 largest products with midpoints of each query so far: one of them may be the query itself.
    """
    middle = own.middles(codes)
    m = best.shape[1]
    best = np.concatenate([best, middle if middle.shape[1] <= m else np.partition(middle, middle.shape[1] - m, 1)[:, -m:]], 1)
    best = np.partition(best, best.shape[1] - m, 1)[:, -m:]
    q, r = np.nonzero(middle >= (best.min(1) - 2 * own.slack)[:, None])
    return q, r, middle[q, r] + own.slack[q], best


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, Queries] = sent.value
        best = {n: np.full((len(x.keys), k + 1), -np.inf) for n, x in block.items()}
        for batch in batches:
            for first in range(0, len(batch), SCAN_BLOCK):
                part = batch.slice(first, SCAN_BLOCK)
                codes = part.column("code").cast(pa.large_binary())
                ends = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
                data, sizes, reps = np.frombuffer(codes.buffers()[2] or b"", np.uint8), np.diff(ends), np.asarray(part.column("rep"))
                for n in np.unique(sizes).tolist():
                    if n in block:
                        rows = np.flatnonzero(sizes == n)
                        q, r, upper, best[n] = reach(block[n], data[ends[rows][:, None] + np.arange(n)], best[n])
                        yield pa.RecordBatch.from_arrays([pa.array(block[n].keys[q]), pa.array(reps[rows[r]]), pa.array(upper.astype(float))], ["query", "rep", "upper"])

    return run


def _scored(candidates: DataFrame, exact: DataFrame, asked: DataFrame) -> DataFrame:
    """query, query_id, vec_id and score of candidates(query, rep), from exact vectors."""
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    both = candidates.select("query", "rep").join(exact, "rep").join(asked.select("query", F.col("id").alias("query_id"), F.col("v").alias("q")), "query")
    return both.select("query", "query_id", F.explode("ids").alias("vec_id"), product.alias("score")).filter("vec_id <> query_id")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors. bits: 8 at most.

    Queries go out in blocks of a fixed size, one after another; each scans the approximations once and leaves its
    candidates in the shared folder, so the driver holds one block at a time.
    """
    spark = vectors.sparkSession
    ready(spark)
    same = Window.partitionBy("v").orderBy("id")
    few = cells(vectors, id_col, vector, scale).withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    exact = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    exact = written(exact.select(F.monotonically_increasing_id().alias("rep"), "ids", "v"), "vectors")
    own = {0: (np.zeros(0), np.zeros(0))} | grid(exact, bits)
    approximations = written(exact.select("rep", "v").mapInArrow(_approximator(own), "rep long, code binary"), "cells")
    asked = written(cells(queries, id_col, vector, scale).distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    components = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    blocks, found = -(-components // QUERY_COMPONENTS), []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.hash("query"), F.lit(blocks)) == b).toPandas()
        block = {int(n): Queries(x["query"].to_numpy(np.int64), np.stack(x["v"].to_list()).astype(np.int64), *own[int(n)]) for n, x in rows.groupby(rows["v"].map(len)) if int(n) in own}
        sent = spark.sparkContext.broadcast(block)
        found.append(written(approximations.mapInArrow(_scan(sent, k), "query long, rep long, upper double"), "candidates"))
        sent.destroy()
    empty = spark.createDataFrame([], "query long, rep long, upper double")
    candidates = spark.read.schema(empty.schema).parquet(*(x.__dict__["written_to"] for x in found)) if found else empty
    return _best(_scored(reads(candidates, exact, asked, k), exact, asked), k).select("query_id", "rank", "vec_id", "score") if found else _nothing(empty, approximations)


def _nothing(empty: DataFrame, approximations: DataFrame) -> DataFrame:
    forget(approximations)
    return empty.select(F.col("query").alias("query_id"), F.lit(0).alias("rank"), F.col("rep").alias("vec_id"), F.lit(0).cast("long").alias("score"))


def reads(candidates: DataFrame, exact: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Those of candidates(query, rep, upper) whose exact vector must be read once the first few are known."""
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "rep")
    first = candidates.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FIRST * k)
    kth = _best(_scored(first, exact, asked), k).filter(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    return candidates.join(kth, "query", "left").filter("kth is null or upper >= kth")
