"""Toxicity scores by a convolutional text classifier, trained and run in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and five bytes. Filters of several
widths slide over the words; each filter's largest value over the whole text feeds one logistic unit. Embeddings start
from the label log-odds of their bucket in the training sample; gradients then flow through the largest windows only.
The logit is scaled on held-back training rows, so that 0.5 is its natural boundary, and a threshold for each language
with enough labels is chosen there; the language never enters the score.

Training rows are bounded, and nothing else is: at most `most_toxic` and `most_clean` labelled documents, those with the
smallest hashes of doc_id, whole, whatever their length (twelve bytes a word in the one task that reads them as they come
and sends back the model). The driver holds no text. Scoring covers every
document, whole, whatever its length. Null or empty text has the score of no words. Labels without a document, null
labels and null ids are ignored in training; a document labelled more than once is used with its highest label, and of
rows that share an id the one with the smallest text. If a class is missing all scores are 0 (no toxic row) or 1.
`scored` replaces columns named like its outputs; `clean` returns all columns of its input as they were.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.llm import kernel
from strandlab.llm.kernel import U64
from strandlab.llm.shared import ready, whole

MOST_TOXIC, MOST_CLEAN = 3000, 5000
WORD_BITS, PREFIX_BITS, SIZE, FILTERS, WIDTHS = 16, 14, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.05
#: Words after which a batch of training documents is closed, and of a piece of a long one.
BATCH_WORDS, PIECE_WORDS = 1 << 17, 1 << 16
#: Sightings by which a bucket's log-odds are drawn to zero.
SMOOTH = 10
#: Labels of each kind that a language needs for a threshold of its own.
ENOUGH = 20
_GAP = max(WIDTHS) - 1
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(33), *(i for i in range(33, 127) if not chr(i).isalnum()), 127]] = 32


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.tables[0][ids[0]]
        for table, own in zip(self.tables[1:], ids[1:], strict=True):
            x += table[own]
        return x

    def windows(self, x: np.ndarray) -> np.ndarray:
        """All filters' values at each position."""
        n = len(x) - _GAP
        return np.concatenate([sum(x[j : j + n] @ f[j] for j in range(len(f))) for f in self.filters], 1)

    def pooled(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum.reduceat(self.windows(x), firsts, 0) + self.bias, 0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out[:-1] + self.out[-1]

    def scores(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits.astype(float) + self.scale[1], -500, 500)))


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word and its two prefixes, with empty places before each text and after the last; where each
    text's empty places begin."""
    plain = kernel._LOWER[_PLAIN[data]]
    start, end, first = kernel.word_spans(plain, offsets)
    sums = kernel.prefix_sums(kernel._BYTE[plain])
    texts, count = len(offsets) - 1, np.diff(first)
    place = np.arange(len(start)) + np.repeat(np.arange(1, texts + 1), count) * _GAP  # so no window has words of two texts
    out = np.zeros((3, len(start) + (texts + 1) * _GAP), np.int32)
    for row, (last, bits) in enumerate(((end, WORD_BITS), (np.minimum(start + 4, end), PREFIX_BITS), (np.minimum(start + 5, end), PREFIX_BITS))):
        out[row, place] = 1 + (kernel.span_hash(sums, start, last) >> U64(64 - bits)).astype(np.int32)
    return out, first[:-1] + np.arange(texts) * _GAP


def _ids_of(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        out.append(word_ids(raw, np.array([0, len(raw)]))[0])
    return out


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, as word_ids gives them."""
    parts = [d[:, :-_GAP] for d in docs] + [docs[-1][:, -_GAP:]]
    firsts = np.append(0, np.cumsum([p.shape[1] for p in parts[:-1]]))[:-1]
    return np.concatenate(parts, 1), firsts


def _fit(docs: list[np.ndarray], labels: np.ndarray) -> Model:
    random = np.random.default_rng(31)
    tables = []
    for row, bits in enumerate((WORD_BITS, PREFIX_BITS, PREFIX_BITS)):
        table = random.normal(0, 0.05, ((1 << bits) + 1, SIZE)).astype(np.float32)
        seen, share = np.zeros((2, len(table))), np.bincount(labels, minlength=2)[:, None] / len(labels)
        for d, y in zip(docs, labels, strict=True):
            seen[y, np.unique(d[row])] += 1
        seen = (seen + SMOOTH * share) / share  # a bucket never seen has odds of one
        table[:, 0] = np.log(seen[1] / seen[0])
        table[0] = 0
        tables.append(table)
    filters = [random.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 1 / len(f)
    n = FILTERS * len(WIDTHS)
    model = Model(tables, filters, np.zeros(n, np.float32), np.append(np.where(np.arange(n) % FILTERS < FILTERS // 2, 0.1, 0.0), -1).astype(np.float32))
    state = {id(p): np.full(p.shape, 1e-3, np.float32) for p in (*tables, *filters, model.bias, model.out)}

    def step(p: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        at = slice(None) if rows is None else rows
        state[id(p)][at] += grad * grad
        p[at] -= RATE * grad / np.sqrt(state[id(p)][at])

    for _ in range(EPOCHS):
        order = random.permutation(len(docs))
        for some in _batches(order, docs):
            ids, firsts = _joined([docs[i] for i in some])
            top, at = _tops(model, ids, firsts)
            top += model.bias
            pooled = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(model.logits(pooled), -30, 30)))
            error = ((p - labels[some]) / len(some)).astype(np.float32)
            back = error[:, None] * model.out[:-1] * (top > 0)
            step(model.out, np.append(error @ pooled, error.sum()))
            step(model.bias, back.sum(0))
            # Only the largest windows' words get a gradient.
            places, grads = [], []
            for k, f in enumerate(filters):
                here = slice(k * FILTERS, (k + 1) * FILTERS)
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    place = at[:, here] + j
                    grad[j] = np.einsum("dfs,df->sf", model.vectors(ids[:, place.ravel()]).reshape(*place.shape, SIZE), back[:, here])
                    places.append(place.ravel())
                    grads.append((back[:, here, None] * f[j].T[None]).reshape(-1, SIZE))
                step(f, grad)
            touched, dx = np.concatenate(places), np.concatenate(grads)
            for table, own in zip(tables, ids, strict=True):
                rows, where = np.unique(own[touched], return_inverse=True)
                total = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(total, where, dx)
                total[rows == 0] = 0
                step(table, total, rows)
    return model


def _batches(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Up to BATCH documents of about BATCH_WORDS words; a longer one is a batch of its own."""
    first, words = 0, 0
    for k, i in enumerate(order):
        if k > first and (k - first == BATCH or words + docs[i].shape[1] > BATCH_WORDS):
            yield order[first:k]
            first, words = k, 0
        words += docs[i].shape[1]
    if first < len(order):
        yield order[first:]


def _tops(model: Model, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's largest value of each filter and where it stands, piece by piece."""
    ends = np.append(firsts[1:], ids.shape[1] - _GAP)
    top = np.full((len(firsts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    at = np.zeros(top.shape, np.int64)
    a = 0
    while a < len(firsts):
        b = max(a + 1, int(np.searchsorted(ends, firsts[a] + PIECE_WORDS, "right")))
        for low in range(firsts[a], ends[b - 1], PIECE_WORDS):
            high = min(low + PIECE_WORDS, ends[b - 1])
            values = model.windows(model.vectors(ids[:, low : high + _GAP]))
            for d in range(a, b):
                x, y = max(firsts[d], low) - low, min(ends[d], high) - low
                if x < y:
                    best = values[x:y].argmax(0) + x
                    value = np.take_along_axis(values, best[None], 0)[0]
                    more = value > top[d]
                    top[d][more], at[d][more] = value[more], best[more] + low
        a = b
    return top, at


def _scaled(logits: np.ndarray, labels: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-back rows, by damped Newton steps on smoothed labels."""
    y = np.where(labels == 1, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    weight = np.where(labels == 1, 1.0, clean_weight)
    weight /= weight.sum()
    x, prior = np.stack([logits.astype(float), np.ones(len(logits))], 1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * ((w - prior) ** 2).sum())

    at = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move, size = np.linalg.solve(hess, x.T @ (weight * (p - y)) + 1e-3 * (at - prior)), 1.0
        while size > 1e-3 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def _threshold(scores: np.ndarray, labels: np.ndarray, clean_weight: float) -> float:
    """The best F1; of equals the one nearest to one half."""
    best, at = -1.0, 0.5
    for t in sorted(np.arange(5, 100, 5) / 100, key=lambda t: abs(t - 0.5)):
        hit, wrong = float(((scores >= t) & (labels == 1)).sum()), clean_weight * float(((scores >= t) & (labels == 0)).sum())
        f1 = 2 * hit / max(1.0, hit + wrong + float(labels.sum()))
        if f1 > best + 1e-9:
            best, at = f1, float(t)
    return at


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(ids: list[np.ndarray], y: np.ndarray, langs: np.ndarray, total: dict[int, int]) -> Model:
    """A model of texts' word ids and labels; total: how many of each label there are beside the sample."""
    if len(set(y.tolist())) < 2:
        empty = Model([np.zeros(((1 << b) + 1, SIZE), np.float32) for b in (WORD_BITS, PREFIX_BITS, PREFIX_BITS)], [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS) + 1, np.float32))
        empty.constant = float(y[0]) if len(y) else 0.0
        return empty
    back = np.arange(len(y)) % 5 == 0  # held back for scale and thresholds
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back = np.zeros(len(y), bool)
    model = _fit([d for d, b in zip(ids, back, strict=True) if not b], y[~back])
    if not back.any():
        return model
    own = [d for d, b in zip(ids, back, strict=True) if b]
    logits = np.concatenate([model.logits(np.maximum(_tops(model, *_joined([own[i] for i in some]))[0] + model.bias, 0)) for some in _batches(np.arange(len(own)), own)])
    # The sample may hold fewer of the clean than there are beside the toxic ones; here they count for all.
    share = [total.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)]
    weight = max(1.0, share[0] / max(share[1], 1e-9))
    model.scale = _scaled(logits, y[back], weight)
    scores, held = model.scores(logits), langs[back]
    model.thresholds[""] = _threshold(scores, y[back], weight)
    for lang in np.unique(held):
        mine = held == lang
        if min(y[back][mine].sum(), (1 - y[back][mine]).sum()) >= ENOUGH:
            model.thresholds[str(lang)] = _threshold(scores[mine], y[back][mine], weight)
    return model


def _trainer(total: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, langs, seen = [], [], [], set()
        for batch in batches:
            for k, row in enumerate(batch.column("doc_id").to_pylist()):
                if row in seen:
                    continue
                seen.add(row)
                ids.append(_ids_of([batch.column("text")[k].as_py()])[0])
                y.append(batch.column("y")[k].as_py())
                langs.append(str(batch.column("lang")[k].as_py()))
        blob = pickle.dumps(trained(ids, np.array(y, int), np.array(langs, str), total))
        ids.clear()
        kernel.release()
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """A model from labelled documents outside the held-out fifth."""
    ready(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", lang.alias("lang"))
    total = {int(k): int(n) for k, n in known.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [known.filter(F.col("y") == y).orderBy(*order).limit(most) for y, most in ((1, most_toxic), (0, most_clean))]
    # The sample's size is fixed, so it may be broadcast; labels of documents that are missing cost places in it.
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").repartition(1).sortWithinPartitions(*order, "text")
    got = rows.mapInArrow(_trainer(total), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else trained([], np.zeros(0, int), np.zeros(0, str), total)


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = kernel.utf8(batch.column("text"))
            logits = [np.zeros(0)]
            for a, b in kernel.blocks(offsets, 1 << 19):
                ids, firsts = word_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                logits.append(model.logits(_pooled_long(model, ids, firsts)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.scores(np.concatenate(logits)), pa.float64())], ["row", "score"])
        kernel.release()

    return run


def _pooled_long(model: Model, ids: np.ndarray, firsts: np.ndarray, most: int = PIECE_WORDS) -> np.ndarray:
    """pooled, in pieces where a text is long: each filter's maximum over pieces is that over the text."""
    if len(firsts) > 1 or ids.shape[1] <= most + _GAP:
        return model.pooled(model.vectors(ids), firsts)
    zero = np.zeros(1, int)
    return np.max([model.pooled(model.vectors(ids[:, a : a + most + _GAP]), zero) for a in range(0, ids.shape[1] - _GAP, most)], 0)


def _judged(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """row (a struct of the columns to keep) and score of each document."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(whole(keep).alias("row"), F.col("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), schema)


def _threshold_of(model: Model, lang: Column | None) -> Column:
    out = F.lit(model.thresholds.get("", 0.5))
    for name, t in model.thresholds.items() if lang is not None else ():
        if name:
            out = F.when(lang == name, F.lit(t)).otherwise(out)
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with score, predicted, threshold (its language's) and toxic (the score reaches it)."""
    keep = [c for c in docs.columns if c not in ("text", "score", "predicted", "threshold", "toxic")]
    lang = F.col("row").getField("lang") if "lang" in keep else None
    out = _judged(docs, keep, model).select("row", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), _threshold_of(model, lang).alias("threshold"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), "score", "predicted", "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """docs whose score stays below their language's threshold, with the columns that they came with."""
    lang = F.col("row").getField("lang") if "lang" in docs.columns else None
    model = fit(docs, labels, **bounds)
    out = _judged(docs, docs.columns, model).filter(F.col("score") < _threshold_of(model, lang))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
