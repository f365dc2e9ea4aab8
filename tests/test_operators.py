"""Operators against hand-computed values, fresh oracles and properties."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.functions import scalars
from strandlab.operators import corpus, metrics, represent, sampling, sequences, stats, tasks


def balanced_brackets(word, n_types):
    pairs = {b[1]: b[0] for b in scalars.BRACKETS[:n_types]}
    stack = []
    for t in word:
        if t in pairs.values():
            stack.append(t)
        elif not stack or stack.pop() != pairs.get(t):
            return False
    return not stack


def test_well_formed(spark):
    rng = random.Random(5)
    words = [[rng.choice("()[]{}<>x") for _ in range(rng.randrange(7))] for _ in range(400)] + [[], ["(", ")"], list("([{}])"), list("<>"), [")"], ["("]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    for n in (2, 3, 4):
        got = {r["i"]: r["ok"] for r in rows.select("i", scalars.well_formed(F.col("w"), n).alias("ok")).collect()}
        assert got == {i: balanced_brackets(w, n) for i, w in enumerate(words)}


def test_bracket_task(spark):
    rows = tasks.bracket_task(spark.range(200), length=20, n_types=3).collect()
    assert all(len(r["sentence"].split()) == 20 for r in rows)
    assert all(balanced_brackets(r["sentence"].split(), 3) for r in rows if r["label"] == 1)
    assert sum(not balanced_brackets(r["sentence"].split(), 3) for r in rows if r["label"] == 0) > 0.9 * sum(r["label"] == 0 for r in rows)


def test_agreement_task(spark):
    for n, words in ((12, 12), (10, 12), (0, 0)):
        for r in tasks.agreement_task(spark.range(50), n_distract=n).collect():
            w = r["sentence"].split()
            assert len(w) == words + 4
            assert ((w[1] in tasks.SG_NOUNS) == (w[-2] in tasks.SG_VERBS)) == (r["label"] == 1)


def test_metrics(spark):
    rng = random.Random(3)
    rows = [("a", rng.randrange(2), rng.randrange(2), rng.randrange(6)) for _ in range(80)] + [("one", 1, 1, 3), ("bad", 0, 1, 1), ("bad", 1, 0, 2), ("bad", 1, 1, 2)]
    df = spark.createDataFrame(rows, "g string, label int, pred int, score int")
    got = {r["g"]: r for r in metrics.evaluated(df, "g").collect()}
    guard = {r["g"]: r for r in metrics.guarded(df, "g").collect()}
    auc = {r["g"]: r["auc"] for r in metrics.auc(df, "score", "g").collect()}
    mcc = {r["g"]: r["m"] for r in df.groupBy("g").agg(metrics.mcc().alias("m")).collect()}
    for g in ("a", "one", "bad"):
        own = [(y, p, s) for k, y, p, s in rows if k == g]
        c = Counter((y, p) for y, p, _ in own)
        acc = (c[0, 0] + c[1, 1]) / len(own)
        assert got[g]["acc_raw"] == pytest.approx(acc) and got[g]["acc_flipbest"] == pytest.approx(max(acc, 1 - acc))
        assert got[g]["confusion"] == [[c[0, 0], c[0, 1]], [c[1, 0], c[1, 1]]]
        assert guard[g]["label_flipped"] == (acc < 0.5) and guard[g]["accuracy"] == pytest.approx(max(acc, 1 - acc))
        pos, neg = [s for y, _, s in own if y], [s for y, _, s in own if not y]
        if pos and neg:
            assert auc[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
        else:
            assert auc[g] is None
        if len(set(y for y, _, _ in own)) == 2 and len(set(p for _, p, _ in own)) == 2:
            assert mcc[g] == pytest.approx(np.corrcoef([y for y, _, _ in own], [p for _, p, _ in own])[0, 1])
        else:
            assert mcc[g] == 0


def test_described(spark):
    x = [1.0, 2.0, 4.0, 8.0]
    r = stats.described(spark.createDataFrame([(v,) for v in x], "v double"), "v").first()
    assert (r["n"], r["min"], r["median"], r["max"]) == (4, 1, 3, 8)
    assert r["std"] == round(float(np.std(x)), 4) and r["p25"] == float(np.percentile(x, 25))


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i + 1, float(i)) for i in range(20)], "place int, v double")
    r = stats.bootstrap_mean(rows, "place", "v", draws=300).first()
    assert r["low"] < 9.5 < r["high"] and r["draws"] == 300
    assert stats.bootstrap_mean(rows.filter("place < 5"), "place", "v").count() == 0


def test_capped_takes_the_crossing_row(spark):
    rows = spark.createDataFrame([(i, 3) for i in range(50)], "i int, n int")
    for target, kept in ((1, 1), (3, 1), (4, 2), (10, 4), (1000, 50)):
        got = corpus.capped(rows, ["i"], F.floor(F.col("i") / 7), F.col("n"), target)
        assert sorted(r["i"] for r in got.collect()) == list(range(kept))


def test_sampling_properties(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "id int, b boolean").select("id", F.col("b").cast("int").alias("label"))
    for layout in (1, 5):
        own = rows.repartition(layout)
        split = {r["id"]: r["split"] for r in sampling.split(own, 1, 40, "id").collect()}
        assert Counter(split.values()) == {"test": 40, "train": 260}
        assert split == {r["id"]: r["split"] for r in sampling.split(rows, 1, 40, "id").collect()}
    assert Counter(r["label"] for r in sampling.balanced(rows, 2, 21, "id").collect()) == {1: 10, 0: 11}
    assert sampling.fraction(rows, 0, 0.01, "id").count() == 64 and sampling.fraction(rows, 0, 1.0, "id").count() == 300
    mix = sampling.mixture(rows, rows, 0, 40, 0.7, "id").collect()
    assert Counter(r["part"] for r in mix) == {"remote": 28, "standard": 12}


def test_sequences(spark):
    rows = spark.createDataFrame([(0, "MKVLAA"), (1, "A"), (2, "")], "seq_id int, seq string")
    got = {g: {r["seq_id"]: r["text"] for r in sequences.corpus_lines(rows, g, 3).collect()} for g in ("protein", "shuffled", "randomaa")}
    assert got["protein"][0] == "<protein> M K V L A A </protein>"
    for i, s in ((0, "MKVLAA"), (1, "A")):
        assert sorted(got["shuffled"][i].split()[1:-1]) == sorted(s)
        assert len(got["randomaa"][i].split()[1:-1]) == len(s)
    freq = {r["residue"]: r for r in sequences.frequencies(rows).collect()}
    assert len(freq) == 20 and freq["A"]["n"] == 3 and freq["W"]["n"] == 1 and sum(r["p"] for r in freq.values()) == pytest.approx(1)


def test_cka(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 3))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    table = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "row int, features array<double>")
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.sum((xc.T @ yc) ** 2) / (np.linalg.norm(xc.T @ xc) * np.linalg.norm(yc.T @ yc))
    assert represent.linear_cka(table(x), table(y)).first()["cka"] == pytest.approx(want)
    assert represent.linear_cka(table(x), table(3 * x @ q)).first()["cka"] == pytest.approx(1)
    back = represent.permuted(table(x), "row", 4).collect()
    assert sorted(r["row"] for r in back) == list(range(30)) and sorted(map(tuple, x.tolist())) == sorted(tuple(r["features"]) for r in back)


def test_packing_drops_each_batch_rest(spark):
    rows = spark.createDataFrame([(i, [f"{i}.{k}" for k in range(5)]) for i in range(6)], "i int, t array<string>")
    got = corpus.packed(rows, F.col("i") % 2, ["i"], "t", 4).collect()
    assert len(got) == 6 and all(len(r["block_tokens"]) == 4 for r in got)
    first = next(r for r in got if r["batch"] == 0 and r["block"] == 1)
    assert first["block_tokens"] == ["0.4", "2.0", "2.1", "2.2"]


def _cka(x, y):
    x, y = x - x.mean(0), y - y.mean(0)
    return np.sum((x.T @ y) ** 2) / (np.linalg.norm(x.T @ x) * np.linalg.norm(y.T @ y) + 1e-12)


def test_cka_by_key_is_wide_and_stable(spark):
    """At 256 features, for each model and layer, in any layout, and with means a million times the spread."""
    rng = np.random.default_rng(1)
    keys = [("a", 0), ("a", 1), ("b", 0)]
    x, y = ({k: rng.normal(size=(40, 256)) for k in keys} for _ in range(2))
    x["b", 0] = x["b", 0] + 1e6
    table = lambda m: spark.createDataFrame([(*k, i, [float(v) for v in r]) for k in keys for i, r in enumerate(m[k])], "model string, layer int, row int, features array<double>")
    for layout in (1, 7):
        got = {(r["model"], r["layer"]): r["cka"] for r in represent.linear_cka(table(x).repartition(layout), table(y), keys=("model", "layer")).collect()}
        assert got == {k: pytest.approx(_cka(x[k], y[k]), rel=1e-6) for k in keys}
    floor = represent.layer_similarity(table(x), table(x), 3).collect()
    assert all(r["cka"] == pytest.approx(1) and r["cka_shuffled"] < 0.99 for r in floor) and len(floor) == 3


def test_probe_like_a_plain_solver(spark):
    """Each fold's accuracy is that of the regression solved by Newton's method."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, f array<double>, y int")
    fold = {r["id"]: r["fold"] for r in represent.stratified_folds(df, "y", 7, "id").collect()}
    fold = np.array([fold[i] for i in range(120)])
    got = {r["fold"]: r["accuracy"] for r in represent.probe_accuracy(df, "f", "y", 7, "id").collect()}
    for k in range(5):
        a, t = np.c_[x, np.ones(120)][fold != k], y[fold != k]
        w, penalty = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - t) + penalty @ w)
        assert got[k] == pytest.approx(np.mean((np.c_[x, np.ones(120)][fold == k] @ w > 0) == y[fold == k]))


def test_null_keys_have_places(spark):
    rows = spark.createDataFrame([(i if i % 4 else None, 2) for i in range(20)], "i int, n int")
    got = corpus.capped(rows, ["i"], F.floor(F.col("i") / 3), F.col("n"), 14).collect()
    assert len(got) == 7 and sum(r["i"] is None for r in got) == 5


def test_pairs_lose_from_the_longer(spark):
    for m, n, length in ((5, 3, 6), (3, 5, 6), (4, 4, 5), (10, 1, 4), (2, 2, 10), (0, 6, 4), (7, 7, 0)):
        a, b = list(range(m)), list(range(n))
        while len(a) + len(b) > length:
            (a if len(a) > len(b) else b).pop()
        row = spark.createDataFrame([(list(range(m)), list(range(n)))], "a array<int>, b array<int>")
        x, y = corpus.truncated_pair(F.col("a"), F.col("b"), length)
        assert tuple(row.select(x, y).first()) == (a, b)


def test_mapped_batches(spark):
    got = corpus.mapped(spark.range(10), lambda frame: frame.loc[frame.index.repeat(2)], "id long")
    assert sorted(r["id"] for r in got.collect()) == sorted([*range(10)] * 2)


def test_mixture_is_shuffled_once_more(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(200)], "id int, label int")
    got = sampling.placed_mixture(rows, rows, 0, 40, 0.7, "id").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 41)) and 0 < sum(r["part"] == "remote" for r in got[:20]) < 20
