"""Importance resampling towards a target distribution, by hashed word pairs in packed bucket streams.

A text's words are runs of digits, small letters (A-Z in lower case) and characters beyond ASCII; its features are all words
and all pairs of neighbours, each in the bucket of its CRC-32. One pass over the texts packs the buckets as uint16 streams,
with the documents' offsets, into a table of bounded rows: texts are read and hashed once. Streams are sorted and run-length
encoded for counts, which are added up by bucket; the counts of all buckets (a parameter, not a size of the data) give the
gains, which are gathered along the streams and added up between offsets. Gains are whole numbers, so sums are exact in any
order. Documents with enough of these words are drawn by weight plus Gumbel noise from a hash of the id: the highest scores,
in a global order.

Null and empty texts have no features, weight 0. A null doc_id counts as an empty one in the noise, and comes last among
equal scores. Repeated rows are documents of their own; those with one doc_id have one noise, and equal rows get ranks in
any order. An empty table has no rows; an empty target gives gains by the corpus alone. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.ordering import numbered
from strandlab.llm.shared import ready, written

BUCKETS = 10_000
SEED, LEAST_WORDS, SHARE = 7, 20, 25
#: Bytes of a text that are cut into words at once, and features in one row of the table of streams (a longer document has
#: a row of its own).
PIECE, STREAM = 1 << 20, 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PIECE bytes that end where no word goes on."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _WORD.match(text, end):
            end = _WORD.match(text, end).end()
        yield text[at:end]
        at = end


def buckets_of(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's features, as uint16: words first, then pairs, part by part."""
    out, last = [], None
    for part in _parts(text.lower()):
        words = _WORD.findall(part)
        if not words:
            continue
        own = list(map(zlib.crc32, words))
        # A pair's CRC goes on from its first word's, so no pair is made.
        spaced = list(map(zlib.crc32, repeat(b" "), own))
        pairs = list(map(zlib.crc32, words if last is not None else words[1:], [last, *spaced] if last is not None else spaced))
        last = spaced[-1]
        out.append(np.array([*own, *pairs], np.uint32) % buckets)
    return np.concatenate(out).astype(np.uint16) if out else np.zeros(0, np.uint16)


def _packed(least_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, enough, streams, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
            packed = np.concatenate(streams).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([enough], pa.list_(pa.bool_())), pa.array([offsets], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["ids", "enough", "offsets", "stream"])

        for batch in batches:
            for doc, text in zip(*(batch.column(k) for k in range(2)), strict=True):
                own = buckets_of((text.as_py() or "").encode(), buckets)
                if streams and (size + len(own) > STREAM or len(ids) >= STREAM):
                    yield row()
                    ids, enough, streams, size = [], [], [], 0
                ids.append(doc.as_py())
                enough.append((len(own) + 1) // 2 >= least_words)  # n words have n - 1 pairs
                streams.append(own)
                size += len(own)
        if ids:
            yield row()

    return run


def streams(docs: DataFrame, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """ids, enough (words), offsets and stream of runs of documents, as a written table."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(_packed(least_words, buckets), "ids array<long>, enough array<boolean>, offsets array<long>, stream binary"), "bucket-streams")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stream is sorted and its runs are counted; a task sends its counts once."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for stream in batch.column(0):
            own = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            total[own[starts]] += np.diff(np.append(starts, len(own)))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])


def counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has: `buckets` numbers, whatever the size of the data."""
    ready(packed.sparkSession)
    rows = packed.select("stream").mapInArrow(_runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for b, n in rows.collect():
        out[b] = n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    s, t, n = own.astype(float), target.astype(float), float(len(own))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, enough, offsets, stream in zip(*(batch.column(k) for k in range(4)), strict=True):
                at = offsets.values.to_numpy()
                n = np.diff(at)
                total = np.zeros(len(n), np.int64)
                full = n > 0  # reduceat would give an empty document its neighbour's first gain
                if full.any():
                    total[full] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], at[:-1][full])
                yield pa.RecordBatch.from_arrays([ids.values, enough.values, pa.array(n), pa.array(np.where(full, total // np.maximum(n, 1), 0))], ["doc_id", "enough", "n_features", "weight"])

    return run


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, enough, n_features and weight (the floored mean of the gains) of each document."""
    ready(packed.sparkSession)
    return packed.mapInArrow(_weighed(gain), "doc_id long, enough boolean, n_features long, weight long")


def drawn(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs(doc_id, text); target(text). Of the documents with
    least_words words `share` percent are drawn."""
    own = streams(docs, least_words, buckets)
    aim = streams(target.select(F.lit(0).alias("doc_id"), "text"), 0, buckets)
    rows = weights(own, gains(counts(own, buckets), counts(aim, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = written(rows.withColumn("score", F.col("weight") + noise), "resample-scored")
    most = scored.filter("enough").count() * share // 100
    # Rows of one id and score go on by what they hold, and equal rows by where they lie, so that ranges can part them.
    ties = [F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.monotonically_increasing_id()]
    ranked = numbered(scored.select("*", ties[-1].alias("__uid")), F.desc("enough"), F.desc("score"), *ties[:-1], "__uid")
    rank = F.when(F.col("enough") & (F.col("place") < most), F.col("place") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
