"""Representations and attention: linear CKA, its permuted floor, difference selectivity and linear probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandlab.functions.scalars import diff_positions, usable_difference
from strandlab.operators.sampling import placed, shuffled_rank


#: Rows of a matrix that one Arrow batch holds at most when a task sends its sums.
SENT_ROWS = 256
#: Tasks that add up a probe's rows on few cores, or before all executors are there.
LEAST_TASKS = 12


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where the keys change, with the keys' values."""
    for batch in batches:
        key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(batch)
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)] if key else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield key[a], batch.slice(a, b - a)


def _matrix(column: pa.Array) -> np.ndarray:
    """An array<double> column without nulls, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class _Moments:
    """Rows so far of two features tables: their number, means, and sums of products about the means; batches are added by
    the pairwise update, so large means cost no digits."""

    def __init__(self):
        self.n, self.mean, self.sums = 0, {}, {}

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        own, n, total = {"x": x, "y": y}, len(x), self.n + len(x)
        mean = {k: m.mean(0) for k, m in own.items()}
        off = {k: m - mean[k] for k, m in own.items()}
        moved = {k: mean[k] - self.mean[k] for k in own} if self.n else None
        for side in ("xy", "xx", "yy"):
            p, q = side
            sums = off[p].T @ off[q]
            if moved:
                sums += self.sums[side]
                sums += np.outer(moved[p], moved[q]) * (self.n * n / total)
            self.sums[side] = sums
        self.mean = {k: self.mean[k] + moved[k] * (n / total) for k in own} if moved else mean
        self.n = total

    def rows(self) -> Iterator[tuple[str, int, np.ndarray]]:
        """side, a first row, and rows of the sums, with the means and the number that are needed to add them to others'."""
        for side in ("xy", "xx", "yy"):
            sums, mp, mq = self.sums[side], self.mean[side[0]], self.mean[side[1]]
            for at in range(0, len(sums), SENT_ROWS):
                part = sums[at : at + SENT_ROWS]
                yield side, at, np.concatenate([part, np.broadcast_to(mq, part.shape), mp[at : at + SENT_ROWS, None], np.full((len(part), 1), self.n)], 1)


def _grams(keys: list[str], types: list[pa.DataType]):
    """The rows of three Gram matrices for each key of a task, sent once: rows come sorted by key, and the sums of one key
    stand in memory until the next begins, however many batches there are."""

    def sent(key: tuple, moments: _Moments) -> Iterator[pa.RecordBatch]:
        for side, at, part in moments.rows():
            own = [pa.array([v] * len(part), t) for v, t in zip(key, types, strict=True)]
            lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([*own, pa.array([side] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int32()), lists], [*keys, "side", "i", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, moments = None, _Moments()
        for key, batch in _runs(batches, keys):
            if now is not None and key != now:
                yield from sent(now, moments)
                moments = _Moments()
            now = key
            moments.add(_matrix(batch.column("x")), _matrix(batch.column("y")))
        if now is not None:
            yield from sent(now, moments)

    return run


def _norms(keys: list[str]):
    """The squared norm of one row of a Gram matrix over all runs' parts, by the pairwise update of co-moments."""

    def run(table: pa.Table) -> pa.Table:
        parts = np.array(table.column("part").to_pylist(), float)
        d = (parts.shape[1] - 2) // 2
        gram, mq, mp, n = parts[:, :d], parts[:, d : 2 * d], parts[:, -2:-1], parts[:, -1:]
        total = n.sum()
        whole = gram.sum(0) + (n * (mp - (n * mp).sum() / total) * (mq - (n * mq).sum(0) / total)).sum(0)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "side": table.column("side").slice(0, 1), "norm": pa.array([float(whole @ whole)])})

    return run


def linear_cka(x: DataFrame, y: DataFrame, row: str = "row", features: str = "features", keys: tuple[str, ...] = ()) -> DataFrame:
    """cka of two feature tables with rows matched by `row`, for each combination of `keys` (model, layer).

    Each task adds its rows up to partial Gram matrices and sends their rows once for each key it has: what is shuffled
    depends on tasks and features, not on rows. No whole matrix of all rows meets in one task, and no row stands for a
    product.
    """
    on = [*keys, row]
    both = x.select(*on, F.col(features).alias("x")).join(y.select(*on, F.col(features).alias("y")), on)
    both = both.select(*keys, F.transform("x", lambda v: v.cast("double")).alias("x"), F.transform("y", lambda v: v.cast("double")).alias("y"))
    both = both.sortWithinPartitions(*keys) if keys else both
    own = [both.schema[k] for k in keys]
    part = T.StructType([*own, T.StructField("side", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("part", T.ArrayType(T.DoubleType()))])
    norms = both.mapInArrow(_grams(list(keys), [to_arrow_type(f.dataType) for f in own]), part).groupBy(*keys, "side", "i").applyInArrow(_norms(list(keys)), T.StructType([*own, T.StructField("side", T.StringType()), T.StructField("norm", T.DoubleType())]))
    sums = norms.groupBy(*keys).agg(*(F.sum(F.when(F.col("side") == s, F.col("norm"))).alias(s) for s in ("xy", "xx", "yy")))
    return sums.select(*keys, (F.col("xy") / (F.sqrt("xx") * F.sqrt("yy") + 1e-12)).alias("cka"))


def permuted(table: DataFrame, row: str, seed: int) -> DataFrame:
    """The table with its rows dealt anew: the row at each place gets the id found there in hash order; rows that share
    an id (of several layers or models) move together."""
    ids = table.select(row).distinct()
    to = placed(ids, row).withColumnRenamed(row, "__to")
    moved = shuffled_rank(ids, seed, row, name="place").join(to, "place").drop("place")
    return table.join(moved, row).drop(row).withColumnRenamed("__to", row)


def layer_similarity(x: DataFrame, y: DataFrame, seed: int, row: str = "row", features: str = "features", keys: tuple[str, ...] = ("model", "layer")) -> DataFrame:
    """keys, cka and cka_shuffled, its floor: the same with y's rows dealt anew."""
    floor = linear_cka(x, permuted(y, row, seed), row, features, keys).withColumnRenamed("cka", "cka_shuffled")
    return linear_cka(x, y, row, features, keys).join(floor, list(keys))


def rows_of_weights(attention: DataFrame) -> DataFrame:
    """The contract's relation, a row for each weight, as a row for each query with its weights as an array by key place."""
    places = F.sort_array(F.collect_list(F.struct("k", "w")))
    return attention.groupBy("model", "modality", "pair_id", "layer", "head", "q").agg(F.transform(places, lambda x: x["w"]).alias("w"))


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, modality and diff of the pairs(pair_id, modality, a, b token arrays) of which some places differ, but not all
    of the shorter side."""
    rows = pairs.select("pair_id", "modality", diff_positions(F.col("a"), F.col("b")).alias("diff"), F.least(F.size("a"), F.size("b")).alias("__n"))
    return rows.filter(usable_difference(F.col("diff"), F.col("__n"))).drop("__n")


#: How many of a pair's L places may not differ at least, by the analysis; "min" leaves that to usable_pairs.
GUARDS = {"min": None, "L": 1, "L-1": 2}


def selectivity(attention: DataFrame, diff: DataFrame, last_query: bool = False, guard: str = "min") -> DataFrame:
    """Per (model, modality, layer, head): the mean over pairs of attention to differing places minus to the others.

    attention(model, modality, pair_id, layer, head, q, w array<double>) has a row for each query, diff(pair_id, modality,
    diff array<int>) the differing places, each once. With last_query only each pair's last query counts, else all do. Places
    beyond the weights don't count; guard says which pairs are left out for having none or (nearly) all of the L places.
    Sums over an array's places stay within its row, so a weight is no row of a shuffle. Both sides of the join are dealt by
    pair, where a pair's sums stay too; nothing is broadcast for it.
    """
    if last_query:
        last = attention.groupBy("model", "modality", "pair_id").agg(F.max("q").alias("q"))
        attention = attention.join(last, ["model", "modality", "pair_id", "q"], "left_semi")
    # Plans tell too little of attention that is made from ids, and may broadcast it; so the pairs are the side that is hashed.
    rows = attention.join(diff.select("pair_id", "modality", "diff").hint("shuffle_hash"), ["pair_id", "modality"])
    inside = F.filter("diff", lambda i: (i >= 0) & (i < F.size("w")))
    if GUARDS[guard]:
        rows = rows.filter((F.size(inside) > 0) & (F.size(inside) <= F.size("w") - GUARDS[guard]))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    hits = F.transform(inside, lambda i: F.get("w", i))
    there = lambda xs: F.size(F.filter(xs, lambda x: x.isNotNull()))
    rows = rows.select("model", "modality", "pair_id", "layer", "head", add(hits).alias("h"), there(hits).alias("nh"), add(F.col("w")).alias("a"), there(F.col("w")).alias("na"))
    sums = rows.groupBy("model", "modality", "pair_id", "layer", "head").agg(*(F.sum(c).alias(c) for c in ("h", "nh", "a", "na")))
    score = F.try_divide(F.col("h"), F.col("nh")) - F.try_divide(F.col("a") - F.col("h"), F.col("na") - F.col("nh"))
    pairs = sums.withColumn("s", score)
    return pairs.groupBy("model", "modality", "layer", "head").agg(F.avg("s").alias("score"), F.count("s").alias("n_pairs"))


def stratified_folds(rows: DataFrame, label: str, seed: int, *ids: str, folds: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """fold 0 to folds - 1, dealt in turn within each label (of each key) by hash order; labels of any size, by buckets."""
    out = shuffled_rank(rows, seed, *ids, name="__place", by=[*keys, label])
    return out.withColumn("fold", F.pmod(F.col("__place"), F.lit(folds)).cast("int")).drop("__place")


def _softmax_sums(a: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of rows a with classes t. Two classes have one row of weights, more have one each."""
    z = a @ w.T
    if len(w) == 1:
        p = 1 / (1 + np.exp(-z))
        loss, off = np.sum(np.logaddexp(0, z[:, 0]) - t * z[:, 0]), p - t[:, None]
        return loss, (off.T @ a).ravel(), (a * (p * (1 - p))).T @ a
    z = z - z.max(1, keepdims=True)
    total = np.log(np.exp(z).sum(1))
    p = np.exp(z - total[:, None])
    k, d = w.shape
    here = np.zeros_like(p)
    here[np.arange(len(t)), t.astype(int)] = 1
    blocks = np.empty((k, d, k, d))
    for i in range(k):
        for j in range(i, k):
            blocks[i, :, j] = (a * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a
            blocks[j, :, i] = blocks[i, :, j].T
    return float(np.sum(total - z[here > 0])), ((p - here).T @ a).ravel(), blocks.reshape(k * d, k * d)


def _loss_parts(keys: list[str], types: list[pa.DataType], folds: int, vectors: int, weights: dict):
    """A Newton step's sums over a task's rows, for each key and fold: the loss, the gradient and the Hessian's rows, sent
    once a key. A row counts in all folds but its own. Index -1 holds the loss."""

    def sent(key: tuple, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for fold, part in enumerate(sums):
            for at in range(0, len(part), SENT_ROWS):
                block = part[at : at + SENT_ROWS]
                own = [pa.array([v] * len(block), t) for v, t in zip(key, types, strict=True)]
                lists = pa.ListArray.from_arrays(np.arange(0, block.size + 1, block.shape[1], dtype=np.int32), pa.array(block.ravel()))
                yield pa.RecordBatch.from_arrays([*own, pa.array([fold] * len(block), pa.int32()), pa.array(np.arange(at, at + len(block)) - 1, pa.int32()), lists], [*keys, "fold", "i", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, []
        for key, batch in _runs(batches, keys):
            x, y, own = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            size = vectors * x.shape[1]
            if key != now:
                if now is not None:
                    yield from sent(now, sums)
                now, sums = key, [np.zeros((size + 1, size + 1)) for _ in range(folds)]
            for fold in range(folds):
                w = weights.get((*key, fold), np.zeros(size)).reshape(vectors, -1)
                loss, gradient, hessian = _softmax_sums(x[own != fold], y[own != fold], w)
                sums[fold][0, 0] += loss
                sums[fold][1:, :-1] += hessian
                sums[fold][1:, -1] += gradient
        if now is not None:
            yield from sent(now, sums)

    return run


def _added(table: pa.Table) -> pa.Table:
    """One row of the sums over all tasks."""
    total = _matrix(table.column("part").combine_chunks()).sum(0)
    return table.slice(0, 1).set_column(table.schema.get_field_index("part"), "part", pa.array([total], pa.list_(pa.float64())))


def _step(c: float, vectors: int, weights: dict, keys: list[str]):
    """The penalised loss at the weights and the weights after a whole Newton step, of one key and fold; intercepts aren't
    penalised."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        key = tuple(table.column(k)[0].as_py() for k in [*keys, "fold"])
        rows = _matrix(table.column("part").combine_chunks())
        d = rows.shape[1] - 1
        w, penalty = weights.get(key, np.zeros(d)), np.tile(np.append(np.ones(d // vectors - 1), 0.0), vectors)
        gradient, hessian = c * rows[1:, -1] + penalty * w, c * rows[1:, :-1] + np.diag(penalty)
        # All intercepts of several classes may move together without any change; that direction has no gradient.
        to = w - np.linalg.solve(hessian + 1e-9 * np.eye(d), gradient)
        loss = c * rows[0, 0] + (penalty * w) @ w / 2
        return pa.table({**{k: table.column(k).slice(0, 1) for k in [*keys, "fold"]}, "loss": pa.array([loss]), "size": pa.array([float(np.abs(gradient).max())]), "w": pa.array([to], pa.list_(pa.float64()))})

    return run


def probe_weights(rows: DataFrame, keys: tuple[str, ...] = (), classes: int = 2, folds: int = 5, c: float = 1.0, steps: int = 100, tolerance: float = 1e-6) -> dict[tuple, np.ndarray]:
    """Weights (the intercept last) of a logistic regression for each combination of `keys` and each fold left out, from
    rows(keys, x array<double>, y double, fold int) with y from 0 to classes - 1; they minimise c * loss + |w|^2 / 2. Two
    classes have one vector of weights, more have one for each, end to end.

    One job an iteration fits all of them together by Newton's method: tasks add up their rows, rows of the Hessians are
    added up by key, and each is solved in a task. The driver only gets the weights, keys times folds times features, and
    halves a step that made the loss greater.
    """
    own = [rows.schema[k] for k in keys]
    types = [to_arrow_type(f.dataType) for f in own]
    parts = T.StructType([*own, T.StructField("fold", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("part", T.ArrayType(T.DoubleType()))])
    solved = T.StructType([*own, T.StructField("fold", T.IntegerType()), T.StructField("loss", T.DoubleType()), T.StructField("size", T.DoubleType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    names, vectors = list(keys), 1 if classes <= 2 else classes
    best: dict[tuple, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, weights there, the step that led on from there
    trial: dict[tuple, np.ndarray] = {}
    done: dict[tuple, np.ndarray] = {}
    for _ in range(steps):
        sums = rows.mapInArrow(_loss_parts(names, types, folds, vectors, trial), parts).groupBy(*names, "fold", "i").applyInArrow(_added, parts)
        found = sums.groupBy(*names, "fold").applyInArrow(_step(c, vectors, trial, names), solved).collect()
        for r in found:
            key, to = tuple(r[k] for k in [*names, "fold"]), np.array(r["w"])
            at = trial.get(key, np.zeros(len(to)))
            if key in best and not r["loss"] <= best[key][0] + 1e-12 * abs(best[key][0]):
                step = best[key][2] / 2
                best[key] = (best[key][0], best[key][1], step)
                trial[key] = best[key][1] + step
                if np.abs(step).max() < 1e-12:
                    done[key] = best[key][1]
            else:
                best[key] = (r["loss"], at, to - at)
                trial[key] = to
                if r["size"] < tolerance:
                    done[key] = at
        if len(done) == len(found):
            break
    return {key: done.get(key, at) for key, (_, at, _) in best.items()}


def _right(keys: list[str], vectors: int, weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, batch in _runs(batches, keys):
            x, fold = _matrix(batch.column("x")), batch.column("fold").to_numpy()
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            found = np.zeros(len(x))
            for f in set(fold.tolist()):
                z = x[fold == f] @ weights[*key, f].reshape(vectors, -1).T
                found[fold == f] = z[:, 0] > 0 if vectors == 1 else z.argmax(1)
            right = (found == batch.column("y").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("fold"), pa.array(right)], [*keys, "fold", "right"])

    return run


def probe_accuracy(rows: DataFrame, features: str, label: str, seed: int, *ids: str, keys: tuple[str, ...] = (), folds: int = 5, c: float = 1.0, steps: int = 100) -> DataFrame:
    """keys, fold, accuracy and n of a logistic probe on frozen features, each fold predicted by the others' fit.

    All folds of all keys (models, layers) are fitted together when this is called, one job an iteration; predictions are
    made when the result is read. Rows without features or label take no part. The labels are the same few for all keys.
    What an iteration shuffles depends on cores, keys, folds, classes and features, not on rows.
    """
    rows = rows.filter(F.col(features).isNotNull() & F.col(label).isNotNull())
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1 if classes else F.lit(0)
    own = stratified_folds(rows, label, seed, *ids, folds=folds, keys=keys)
    own = own.select(*keys, F.col("fold").cast("int").alias("fold"), number.cast("double").alias("y"), F.transform(features, lambda v: v.cast("double")).alias("x"))
    # A task sends whole Hessians in each iteration, however few rows it has: so there are as many tasks as cores.
    own = own.coalesce(max(own.sparkSession.sparkContext.defaultParallelism, LEAST_TASKS))
    own = (own.sortWithinPartitions(*keys) if keys else own).persist()
    weights = probe_weights(own, keys, len(classes), folds, c, steps)
    own.unpersist()
    names = list(keys)
    schema = T.StructType([*(own.schema[k] for k in keys), T.StructField("fold", T.IntegerType()), T.StructField("right", T.IntegerType())])
    return own.mapInArrow(_right(names, 1 if len(classes) <= 2 else len(classes), weights), schema).groupBy(*keys, "fold").agg(F.avg("right").alias("accuracy"), F.count("*").alias("n"))
