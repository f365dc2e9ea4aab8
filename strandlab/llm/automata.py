"""Substring dedup over words by suffix automata of reference shards.

The reference is the corpus itself, so it is cut into shards by anchor (see repeats.py): two passages with a common
window of `threshold` words share an anchor, and so a shard. Each shard's suffix automaton is built in the task that
gets the shard, with the smallest document of each state, and the shard's passages are streamed through it. Matching
statistics say where at least `threshold` words match; the state of just that many words names the smallest document
that has them. Maximal runs of such windows are removed. A shard is delivered to its one task by shuffle; it isn't
broadcast to all, as all shards together are as large as the corpus' repeated text. `against` takes a reference of its own
(a benchmark, say), whose size is checked: there the automata of all shards are broadcast, and the documents streamed.

Words are [^\\x20\\x09-\\x0D]+, unchanged, and stand as 64-bit hashes. Windows are judged on the input. Null text has no
words. Documents with fewer words than the threshold lose nothing. A null doc_id neither removes nor loses anything;
rows that share a doc_id remove nothing from each other, and each has its own result. Kept words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm import repeats
from strandlab.llm.shared import n_words, ready

THRESHOLD, GRAM, HOT = 50, 8, 1024
#: Words after which a shard's automaton is closed, at the next anchor.
SHARD_WORDS = 20_000
#: Words of a reference whose automata are broadcast.
MOST_REFERENCE = 100_000


class Automaton:
    """A suffix automaton of several sequences, put in by ascending document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [-1]

    def _state(self, edges: dict[int, int], link: int, length: int, least: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        """A state for the strings of q up to the length of p's plus one."""
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.least[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int], document: int) -> None:
        last = 0
        for token in sequence:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
            else:
                new, p = self._state({}, 0, self.length[last] + 1, -1), last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
                last = new
            s = last
            while s > 0 and self.least[s] < 0:  # documents ascend: the first to come is the smallest
                self.least[s] = document
                s = self.link[s]

    def windows(self, sequence: list[int], n: int) -> list[int]:
        """For each window of n tokens the smallest document that has it, or -1."""
        out, s, matched = [], 0, 0
        for at, token in enumerate(sequence):
            while s and token not in self.next[s]:
                s = self.link[s]
                matched = self.length[s]
            if token in self.next[s]:
                s = self.next[s][token]
                matched += 1
            if matched >= n:
                while self.length[self.link[s]] >= n:
                    s = self.link[s]
                matched = n
            if at >= n - 1:
                out.append(self.least[s] if matched >= n else -1)
        return out


def automata(contents: np.ndarray, ends: np.ndarray, anchors: np.ndarray, documents: np.ndarray, n: int) -> np.ndarray:
    """For each window of each content the smallest document that has it."""
    count = np.diff(ends) - (n - 1)
    least, at = np.repeat(documents, count), np.append(0, np.cumsum(count))
    _, which, size = np.unique(anchors, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(size[which] > 1)  # a passage alone under its anchor equals no other
    shared = shared[np.argsort(which[shared], kind="stable")]
    shard: list[int] = []
    words = 0
    for i, c in enumerate(shared.tolist()):
        shard.append(c)
        words += int(ends[c + 1] - ends[c])
        if i + 1 == len(shared) or words >= SHARD_WORDS and which[shared[i + 1]] != which[c]:
            reference = Automaton()
            for x in sorted(shard, key=lambda x: documents[x]):
                reference.add(contents[ends[x] : ends[x + 1]].tolist(), int(documents[x]))
            for x in shard:
                least[at[x] : at[x + 1]] = reference.windows(contents[ends[x] : ends[x + 1]].tolist(), n)
            shard, words = [], 0
    return least


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept (text of the words left) for each row of docs(doc_id, text)."""
    p = repeats.plan(docs, words=True, n=threshold, k=gram, hot=hot)
    out = repeats.without_repeats(docs, p, automata).withColumnRenamed("n_tokens", "n_words")
    return out.withColumn("kept", out["kept"].cast("string"))


def _streamed(sent, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[Automaton] = sent.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            tokens = repeats.Tokens(table.column("text"), words=True)
            edges = np.zeros(len(tokens.values) + 1, np.int32)
            for a, b in zip(tokens.ends[:-1].tolist(), tokens.ends[1:].tolist(), strict=True):
                own = tokens.values[a:b].tolist()
                for shard in shards:
                    hit = a + np.flatnonzero(np.array(shard.windows(own, n), np.int64) >= 0)
                    edges[hit] += 1
                    edges[hit + n] -= 1
            yield from repeats.removed(table, tokens, np.cumsum(edges[:-1]) > 0, True, False).to_batches()

    return run


def against(docs: DataFrame, reference: DataFrame, threshold: int = THRESHOLD, most_words: int = MOST_REFERENCE) -> DataFrame:
    """without_repeats' columns for each row of docs(doc_id, text), less every run of `threshold` words that a text of
    reference(text) holds. A reference of more than most_words words is refused. Ids don't matter; null texts have no words.
    """
    spark = docs.sparkSession
    ready(spark)
    size = reference.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the reference has {size} words; {most_words} can be broadcast")
    tokens = repeats.Tokens(pa.chunked_array([pa.array([r["text"] for r in reference.select("text").collect()], pa.string())]), words=True)
    shards, words = [Automaton()], 0
    for k, (a, b) in enumerate(zip(tokens.ends[:-1].tolist(), tokens.ends[1:].tolist(), strict=True)):
        if words >= SHARD_WORDS:
            shards.append(Automaton())
            words = 0
        shards[-1].add(tokens.values[a:b].tolist(), k)
        words += b - a
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_streamed(spark.sparkContext.broadcast(shards), threshold), "doc_id long, n_tokens long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("n_tokens", "n_words").withColumn("kept", F.col("kept").cast("string"))
