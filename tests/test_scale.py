"""What must hold at any size: no task gets a whole group, and what is shuffled doesn't grow with what is dropped."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlab import schemas
from strandlab.functions import tokenize
from strandlab.functions.scalars import tokenizer
from strandlab.operators import corpus, metrics, ranges, represent, sampling, stats
from strandlab.plans import twins
from strandlab.sources import readers, sinks
from strandlab.streaming import records as live


@pytest.fixture
def dealt_out(spark):
    """Partitions stay as many as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def nodes(plan):
    """All operators of an executed plan, in the stages of adaptive ones too; not in subqueries."""
    name = plan.getClass().getSimpleName()
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ResultQueryStageExec": "plan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan"}.get(name)
    below = [getattr(plan, inner)()] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
    return [(name, plan)] + [x for p in below for x in nodes(p)]


def shuffled(df):
    """Rows written by the shuffles of a query that has run."""
    return sum(p.metrics().apply("shuffleRecordsWritten").value() for name, p in nodes(df._jdf.queryExecution().executedPlan()) if name == "ShuffleExchangeExec")


def test_percentiles_of_large_groups(spark, dealt_out):
    rng = random.Random(4)
    rows = [("hot", float(rng.choice([1.5, rng.gauss(0, 1), rng.randrange(5)]))) for _ in range(4000)] + [(g, float(v)) for g in "ab" for v in range(7)] + [(None, 2.0), (None, 4.0), ("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for whole in (3, 100, 10_000):
        got = {r["g"]: r for r in stats.described(df, "v", "g", whole=whole).collect()}
        for g in ("hot", "a", None, "one"):
            own = [v for k, v in rows if k == g]
            assert [got[g][c] for c in ("p25", "median", "p75")] == pytest.approx(list(np.percentile(own, [25, 50, 75])), abs=6e-5), (whole, g)
        assert got["none"]["n"] == 0 and got["none"]["median"] is None
    counted = df.filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    most = ranges.dealt(counted, ["g"], "v").filter("g = 'hot'").groupBy("__range").count().agg(F.max("count"), F.count("*")).first()
    assert most[1] >= 3 and most[0] < counted.filter("g = 'hot'").count() * 0.6
    assert stats.described(df.select("v"), "v", whole=3).first()["n"] == 4017


def test_auc_of_large_groups(spark, dealt_out):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(2), round(rng.gauss(0, 1), 2)) for _ in range(1500)] + [("a", 1, 2.0), ("a", 0, 2.0), ("b", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, label int, s double").repartition(4)
    out = metrics.auc(df, "s", "g")
    got = {r["g"]: r["auc"] for r in out.collect()}
    pos, neg = ([s for g, y, s in rows if g == "hot" and y == t] for t in (1, 0))
    assert got["hot"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    assert got["a"] == 0.5 and got["b"] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and not re.search(r"Window \[sum\(q#\d+L\) windowspecdefinition\(g#\d+, s#", plan), "scores are ordered by group only within a range"


def test_cap_shuffles_one_bucket(spark):
    seen = []
    for n in (2_000, 16_000):
        rows = spark.range(n).selectExpr("id as i", "repeat('x', 50) as text")
        out = corpus.capped(rows, ["i"], F.floor(F.col("i") / 100), F.lit(3), 1000)
        assert sorted(r["i"] for r in out.collect()) == list(range(334))
        seen.append(shuffled(out))
    assert seen == [100, 100], "only the bucket that crosses the target is ordered"


def test_bootstrap_of_many_runs(spark, monkeypatch):
    rows = spark.createDataFrame([(i + 1, float(i * i % 17)) for i in range(30)], "place long, v double")
    few = stats.bootstrap_mean(rows, "place", "v", draws=200, seed=3).first()
    monkeypatch.setattr(stats, "BROADCAST_RUNS", 5)
    monkeypatch.setattr(stats, "DRAWN_AT_ONCE", 2)
    many = stats.bootstrap_mean(rows, "place", "v", draws=200, seed=3)
    assert tuple(many.first()) == pytest.approx(tuple(few)) and few["draws"] == 200


def _newton(a, t, penalty):
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - t) + penalty * w)
    return w


def test_probe_of_all_layers_at_once(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in (("m", 0), ("m", 1), ("n", 0)):
        x = rng.normal(size=(90, 4)) * (40 if key == ("n", 0) else 1)
        y = (x @ rng.normal(size=4) + rng.normal(size=90) > 0).astype(float)
        fold = rng.integers(0, 3, 90)
        rows += [(*key, [float(v) for v in r], float(t), int(f)) for r, t, f in zip(x, y, fold, strict=True)]
        for k in range(3):
            want[*key, k] = _newton(np.c_[x, np.ones(90)][fold != k], y[fold != k], np.array([1.0] * 4 + [0.0]))
    df = spark.createDataFrame(rows, "model string, layer int, x array<double>, y double, fold int").repartition(3).sortWithinPartitions("model", "layer")
    got = represent.probe_weights(df, ("model", "layer"), folds=3)
    assert set(got) == set(want)
    for key, w in want.items():
        assert got[key] == pytest.approx(w, abs=1e-5)


def test_probe_sends_hessians_once_a_core(spark, monkeypatch):
    """More partitions of rows don't make more tasks that send sums."""
    seen, fit = [], represent.probe_weights
    monkeypatch.setattr(represent, "probe_weights", lambda rows, *a: (seen.append(rows.rdd.getNumPartitions()), fit(rows, *a))[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        df = spark.range(120).selectExpr("id", "cast(id % 2 as int) as y", "array(cast(id % 7 as double), cast(id % 2 + id % 5 as double)) as f")
        n = sum(r["n"] for r in represent.probe_accuracy(df, "f", "y", 7, "id", folds=2, steps=2).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n == 120 and seen[0] <= max(spark.sparkContext.defaultParallelism, represent.LEAST_TASKS)


def test_probe_of_several_classes(spark):
    """At the weights the penalised softmax loss has no slope."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    y = np.argmax(x @ rng.normal(size=(3, 4)) + rng.normal(size=(150, 4)), 1)
    df = spark.createDataFrame([([float(v) for v in r], float(t), i % 2) for i, (r, t) in enumerate(zip(x, y, strict=True))], "x array<double>, y double, fold int").repartition(2)
    for fold, w in ((k[0], v.reshape(4, 4)) for k, v in represent.probe_weights(df, classes=4, folds=2).items()):
        a, t = np.c_[x, np.ones(150)][np.arange(150) % 2 != fold], y[np.arange(150) % 2 != fold]
        p = np.exp(a @ w.T)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(t)), t] -= 1
        assert np.abs(p.T @ a + w * [1, 1, 1, 0]).max() < 1e-4
    labelled = spark.createDataFrame([(i, [float(v) for v in r], f"c{t}") for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, label string")
    out = represent.probe_accuracy(labelled, "x", "label", 1, "id").collect()
    assert len(out) == 5 and sum(r["n"] for r in out) == 150 and all(r["accuracy"] > 0.35 for r in out)


def test_gram_rows_are_sent_once(monkeypatch):
    monkeypatch.setattr(represent, "SENT_ROWS", 4)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 6)) + 1e5, rng.normal(size=(60, 5))
    table = pa.table({"k": ["a"] * 40 + ["b"] * 20, "x": [list(r) for r in x], "y": [list(r) for r in y]})
    sums = {}
    for size in (7, 60):
        out = list(represent._grams(["k"], [pa.string()])(iter(table.to_batches(max_chunksize=size))))
        assert max(map(len, out)) <= 4
        sums[size] = pa.Table.from_batches(out)
        assert len(sums[size]) == 2 * (6 + 6 + 5)
    for side, p, q in (("xy", x, y), ("xx", x, x)):
        own = np.array([r["part"] for r in sums[7].to_pylist() if r["k"] == "a" and r["side"] == side])
        p, q = p[:40] - p[:40].mean(0), q[:40] - q[:40].mean(0)
        assert own[:, : q.shape[1]] == pytest.approx(p.T @ q, rel=1e-6, abs=1e-6)


def test_guards(spark):
    """One pair each that only some analyses leave out: L = 4 places, differing at 1, 3, 4 or none of them."""
    w = [[0.1, 0.2, 0.3, 0.4], [0.4, 0.3, 0.2, 0.1]]
    long = [("m", "NL", pair, 0, 0, q, k, w[q][k]) for pair in range(4) for q in range(2) for k in range(4)]
    attention = represent.rows_of_weights(spark.createDataFrame(long, schemas.ATTENTION))
    assert attention.count() == 8 and attention.filter("pair_id = 0 and q = 1").first()["w"] == w[1]
    pairs = [(0, "NL", list("abcd"), list("abcx")), (1, "NL", list("abcd"), list("axyz")), (2, "NL", list("abcd"), list("wxyz")), (3, "NL", list("ab"), list("ab"))]
    pairs = spark.createDataFrame(pairs, "pair_id long, modality string, a array<string>, b array<string>")
    from strandlab.functions.scalars import diff_positions

    diff = pairs.select("pair_id", "modality", diff_positions(F.col("a"), F.col("b")).alias("diff"))
    mean = np.mean
    score = lambda pair, qs: {0: mean([w[q][3] for q in qs]) - mean([w[q][k] for q in qs for k in (0, 1, 2)]), 1: mean([w[q][k] for q in qs for k in (1, 2, 3)]) - mean([w[q][0] for q in qs])}[pair]
    for guard, last, kept in (("min", True, (0, 1)), ("L", True, (0, 1)), ("L-1", False, (0,))):
        own = represent.usable_pairs(pairs) if guard == "min" else diff
        (r,) = represent.selectivity(attention, own, last, guard).collect()
        assert (r["n_pairs"], r["score"]) == (len(kept), pytest.approx(mean([score(p, [1] if last else [0, 1]) for p in kept])))


def test_attention_is_never_broadcast(spark, tmp_path):
    """Attention made from few ids looks small to a plan; it stays where its ids were dealt, as do the sums of its pairs."""
    spark.range(50).withColumnRenamed("id", "vec_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    attention, diff = twins._attention(spark, str(tmp_path))
    plan = represent.selectivity(attention, diff)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(pair_id") == 2 and plan.count("Exchange ") == 3


def test_seeds_are_a_dimension(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(120)], "id int, label int")
    seeds = list(range(15))
    got = sampling.splits(rows, seeds, 20, "id").collect()
    for s in seeds:
        assert {r["id"]: r["split"] for r in got if r["seed"] == s} == {r["id"]: r["split"] for r in sampling.split(rows, s, 20, "id").collect()}
    mixed = sampling.mixtures(rows, rows.filter("id < 60"), [3, 8], 40, 0.7, 10, "id").collect()
    for s in (3, 8):
        own = [r for r in mixed if r["seed"] == s]
        want = sampling.placed_mixture(rows, rows.filter("id < 60"), s, 40, 0.7, "id").collect()
        assert {(r["id"], r["part"], r["place"]) for r in own} == {(r["id"], r["part"], r["place"]) for r in want}
        assert Counter(r["split"] for r in own) == {"test": 10, "train": 30}


def test_stratified_folds_are_even(spark):
    rows = spark.createDataFrame([(i, i % 3, "ab"[i % 2]) for i in range(300)], "id int, y int, k string")
    for r in represent.stratified_folds(rows, "y", 1, "id", keys=("k",)).groupBy("k", "y", "fold").count().collect():
        assert r["count"] == 10


def test_appended_runs_are_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "r"), schemas.RECORDS["forward_source"]
    row = lambda s, v: spark.createDataFrame([("a->b", "t", s, v, v)], schema)
    sinks.append_records(row(0, 0.5), path, ["source", "seed"])
    sinks.append_records(row(1, 0.6), path, ["source", "seed"])
    sinks.append_records(row(0, 0.7).union(row(0, 0.7)), path, ["source", "seed"])
    assert sorted((r["source"], r["seed"], r["auc"]) for r in readers.records(spark, path, "forward_source").collect()) == [("a->b", 0, 0.7), ("a->b", 1, 0.6)]


def test_followed_result_survives_a_crash(spark, tmp_path):
    """The last batch's commit is lost after its result was written; every version is read once, merged or not."""
    for every in (2, 20):
        at = tmp_path / str(every)
        for k in range(5):
            spark.createDataFrame([(str(i % 3), "t", k * 10 + i, float(i + k), 0.0) for i in range(6)], schemas.RECORDS["forward_source"]).coalesce(1).write.mode("append").json(str(at / "in"))

            def run():
                stream = live.arriving(spark, str(at / "in"), "forward_source", 1)
                live.follow(live.summarised(stream, "acc_flipbest", "source"), str(at / "out"), str(at / "ck"), ["source"], every=every).awaitTermination()

            run()
            if k == 3:
                for f in (at / "ck/commits").iterdir():
                    if f.name.strip(".").startswith("3"):
                        f.unlink()
                run()
        want = spark.read.schema(schemas.RECORDS["forward_source"]).json(str(at / "in")).groupBy("source").agg(F.avg("acc_flipbest"), F.stddev_pop("acc_flipbest"), F.count("*")).collect()
        got = sorted(map(tuple, live.followed(spark, str(at / "out"), ["source"]).collect()))
        assert [g[:1] for g in got] == sorted(tuple(r)[:1] for r in want) and [g[1:] for g in got] == [pytest.approx(tuple(r)[1:]) for r in sorted(want)]
        assert sorted(str(p.relative_to(at / "out")) for p in (at / "out").glob("*/version=*")) == (["merged=0/version=4", "merged=1/version=3"] if every == 2 else [f"merged=0/version={k}" for k in range(5)])


def test_longest_matches(spark):
    rng = random.Random(9)
    vocabulary = {"un", "##aff", "##able", "a", "##b", "ab", "##ab", "c", "##c", ".", "abc", "##bc"}

    def greedy(word):
        out, rest = [], word
        while rest:
            found = [p for p in ({v for v in vocabulary if not v.startswith("##")} if rest is word else {v[2:] for v in vocabulary if v.startswith("##")}) if rest.startswith(p)]
            if not found:
                return ["[UNK]"]
            best = max(found, key=len)
            out.append(best if rest is word else "##" + best)
            rest = rest[len(best) :] or ""
        return out

    texts = ["Unaffable abc.", "", "é ab", None, "a" * 101] + [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(5)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", tokenize.word_pieces(vocabulary)(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"\w+|[^\w\s]", (t or "").lower())
        assert got[i] == (None if t is None else ["[CLS]", *(p for w in words for p in (greedy(w) if len(w) <= 100 else ["[UNK]"])), "[SEP]"])
    (cut,) = df.filter("i = 0").select(tokenize.word_pieces(vocabulary, most=4)(F.col("t"))).first()
    assert cut == ["[CLS]", "un", "##aff", "[SEP]"]


def test_residue_tokens_and_unknown_share(spark, tmp_path):
    df = spark.createDataFrame([(0, "MK J"), (1, "A"), (2, "")], "i int, s string").select("i", tokenizer("residues")(F.col("s")).alias("t"))
    assert {r["i"]: r["t"] for r in df.collect()} == {0: ["<cls>", "M", "K", "<unk>", "<eos>"], 1: ["<cls>", "A", "<eos>"], 2: ["<cls>", "<eos>"]}
    assert tokenize.unknown_fraction(df, "t", "<unk>", "i").first()[0] == 0.1 and tokenize.unknown_fraction(df, "t", "<unk>", "i", most_rows=1).first()[0] == 0.2
    (tmp_path / "v.txt").write_text("[UNK]\nab\n##c\n")
    assert spark.createDataFrame([("abc x",)], "t string").select(tokenizer(str(tmp_path / "v.txt"))(F.col("t"))).first()[0] == ["[CLS]", "ab", "##c", "[UNK]", "[SEP]"]


def test_first_records_in_any_split(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.fasta").write_text("".join(f">s{k}.{i}\n{'ACDE'[i % 4] * (i + 1)}\n{'K' * k}\n" for i in range(40)))
    want = ["ACDE"[i % 4] * (i + 1) + "K" * k for k in range(2) for i in range(40)][:55]
    for size in ("64", "700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [r["seq"] for r in readers.fasta(spark, str(tmp_path), 55).collect()]
            first = [r["text"] for r in readers.lines(spark, str(tmp_path), 3).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(got) == sorted(want) and sorted(first) == sorted([">s0.0", "A", ""]), size


def test_records_from_predictions_to_report(spark, tmp_path):
    """Predictions become the records that the report reads."""
    from strandlab.__main__ import main

    rng, out = random.Random(2), str(tmp_path / "records")
    logits = lambda y, right: (0.0, 1.0) if (y == 1) == right else (1.0, 0.0)
    tasks = [(t, m, f"hub/{m}", s, i, i % 2, *logits(i % 2, i % 10 < n)) for t in ("paws-x", "cola") for m, n in (("esm2_8M", 6), ("bert_small", 8)) for s in (0, 1) for i in range(40)]
    spark.createDataFrame(tasks, schemas.TASK_PREDICTIONS).write.parquet(str(tmp_path / "t"))
    tokens = [(t, m, i, ["[CLS]", "a", "[UNK]", "[SEP]"] if m == "bert_small" else ["<cls>", "A", "C", "<eos>"]) for t in ("paws-x", "cola") for m in ("esm2_8M", "bert_small") for i in range(10)]
    spark.createDataFrame(tokens, "task string, model string, example_id bigint, tokens array<string>").write.parquet(str(tmp_path / "k"))
    groups = [("paws-x", g, f, "gpt2-medium", 0, i, i % 2, *logits(i % 2, i % 10 < n)) for g, n in (("base", 5), ("text", 6), ("protein", 7), ("shuffled", 4)) for f in (0.05, 1.0) for i in range(40)]
    spark.createDataFrame(groups, schemas.GROUP_PREDICTIONS).write.parquet(str(tmp_path / "g"))
    runs = [("gpt2", s, p, i, rng.randrange(2), 0.0, 1.0) for s in (0, 1) for p in ("baseline_pawsx_test", "protein_indomain", "transfer_pawsx_test", "transfer_pawsx_val") for i in range(30)]
    spark.createDataFrame(runs, schemas.RUN_PREDICTIONS).write.parquet(str(tmp_path / "s"))
    main(["sentence", "--out", out, "--predictions", str(tmp_path / "t"), "--tokens", str(tmp_path / "k")])
    main(["crossmodal", "--out", out, "--predictions", str(tmp_path / "t")])
    main(["ablation", "--out", out, "--predictions", str(tmp_path / "g")])
    main(["transfer", "--out", out, "--predictions", str(tmp_path / "s")])
    found = {(r["task"], r["model"], r["seed"]): r for r in readers.records(spark, f"{out}/esm_on_nl.jsonl", "sentence_tasks").collect()}
    assert len(found) == 8 and found["cola", "esm2_8M", 0]["metric"] == "mcc" and found["cola", "esm2_8M", 0]["score"] == pytest.approx(0.2, abs=0.01) and found["paws-x", "esm2_8M", 1]["score"] == 0.6
    assert found["cola", "bert_small", 1]["unk_frac"] == 0.25 and found["cola", "esm2_8M", 1]["unk_frac"] == 0.0 and found["cola", "esm2_8M", 0]["hf"] == "hub/esm2_8M"
    main(["report", "--out", str(tmp_path / "report"), "--records", out])
    lines = [r["text"] for r in readers.lines(spark, str(tmp_path / "report")).collect()]
    assert "0.05 base=0.500 text=0.600 protein=0.700 shuffled=0.400 +0.300 +0.100" in lines and any(x.startswith("bert_small English 0.800 0.800") for x in lines), lines


def test_seed_commands(spark, tmp_path):
    from strandlab.__main__ import main

    for name, shift in (("p", 0), ("q", 500)):
        (tmp_path / f"{name}.csv").write_text("sentence1,sentence2,label\n" + "".join(f"a{i + shift},b{i},{i % 2}\n" for i in range(80)))
    main(["distribution", "--out", str(tmp_path / "d"), "--pairs", str(tmp_path / "p.csv"), "--n_seeds", "3", "--start", "4", "--n_test", "10"])
    rows = spark.read.parquet(str(tmp_path / "d/pairs")).groupBy("seed", "split").count().collect()
    assert {(r["seed"], r["split"]): r["count"] for r in rows} == {(s, p): n for s in (4, 5, 6) for p, n in (("test", 10), ("train", 70))}
    main(["remote", "--out", str(tmp_path / "m"), "--pairs", str(tmp_path / "p.csv"), "--remote_pairs", str(tmp_path / "q.csv"), "--n_seeds", "2", "--n_source", "40", "--n_test", "10"])
    rows = spark.read.parquet(str(tmp_path / "m/mixture")).groupBy("seed", "split").count().collect()
    assert {(r["seed"], r["split"]): r["count"] for r in rows} == {(s, p): n for s in (0, 1) for p, n in (("test", 10), ("train", 30))}
