"""Sequence controls: residue frequencies, shuffles that keep composition, and resampling that keeps length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions.scalars import letters, protein_line, unit_hash
from strandlab.operators.sampling import shuffled_head

#: The twenty residues.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


#: Sequences that the frequencies of a corpus are taken from: the first in hash order.
FREQUENCY_SAMPLE = 20_000


def _byte_counts(letters: bytes):
    """How often each letter stands in the texts of a task: their bytes are counted as they lie in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0)
            for chunk in [column] if isinstance(column, pa.Array) else column.chunks:
                texts = chunk.cast(pa.large_string())
                if len(texts):
                    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
                    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                    total += np.bincount(data[bounds[0] : bounds[-1]], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in letters]), pa.array(total[list(letters)])], ["residue", "n"])

    return run


def frequencies(sequences: DataFrame, seq: str = "seq", alphabet: str = RESIDUES, most: int | None = None, seed: int = 0, key: str = "seq_id") -> DataFrame:
    """residue, n and p for each letter of the alphabet (ASCII); a letter never seen counts as seen once.

    With `most` only the first sequences of the shuffled order count. Each task counts the bytes of its own texts and
    sends a row for each letter, so neither characters nor texts are shuffled.
    """
    if not alphabet.isascii():
        raise ValueError("the alphabet must be ASCII letters, as bytes are counted")
    if most:
        sequences = shuffled_head(sequences, seed, most, key)
    each = sequences.select(F.coalesce(F.col(seq), F.lit("")).alias("t")).mapInArrow(_byte_counts(alphabet.encode()), "residue string, n long")
    dim = sequences.sparkSession.createDataFrame([(c,) for c in alphabet], "residue string")
    sums = dim.join(each.groupBy("residue").agg(F.sum("n").alias("n")), "residue", "left")
    out = sums.select("residue", F.when(F.col("n") > 0, F.col("n")).otherwise(1).alias("n"))
    return out.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def shuffled(seq: Column, seed: int, key: Column) -> Column:
    """The same letters in the order of the md5 of seed, key and place."""
    order = F.array_sort(F.transform(letters(seq), lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), c.alias("c"))))
    return F.array_join(F.transform(order, lambda x: x["c"]), "")


def resampled(length: Column, seed: int, key: Column, cumulative: list[tuple[str, float]]) -> Column:
    """Letters drawn independently: at each place the first letter whose cumulative share exceeds the place's hash.

    cumulative has a row for each letter of the alphabet, so it is a constant of the expression.
    """
    steps = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(p).alias("p")) for c, p in cumulative))
    places = F.when(length < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), length - 1))
    last = cumulative[-1][0]

    def draw(i: Column) -> Column:
        u = unit_hash(F.lit(str(seed)), key.cast("string"), i.cast("string"))
        return F.coalesce(F.get(F.filter(steps, lambda s: s["p"] > u), F.lit(0))["c"], F.lit(last))

    return F.array_join(F.transform(places, draw), "")


def cumulative(freq: DataFrame) -> list[tuple[str, float]]:
    """frequencies() as (letter, cumulative share), by letter; as many rows as the alphabet has letters."""
    total, out = 0.0, []
    for r in freq.orderBy("residue").collect():
        total += r["p"]
        out.append((r["residue"], total))
    return out


def corpus_lines(sequences: DataFrame, group: str, seed: int = 0, seq: str = "seq", key: str = "seq_id", freq: DataFrame | None = None) -> DataFrame:
    """key and text of the groups protein, shuffled and randomaa."""
    own, name = F.col(seq), F.col(key)
    if group == "shuffled":
        own = shuffled(own, seed, name)
    elif group == "randomaa":
        own = resampled(F.length(own), seed, name, cumulative(freq if freq is not None else frequencies(sequences, seq, most=FREQUENCY_SAMPLE, seed=seed, key=key)))
    elif group != "protein":
        raise ValueError(f"unknown group {group!r}")
    return sequences.select(key, protein_line(own).alias("text"))
