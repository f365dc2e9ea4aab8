"""Mixing, exact search and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandlab.llm import mixing, vafile


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return held | share
        for s in over:
            held[s] = most * sizes[s]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice(["a", "b", "b", "b", "c", "d", None, "e"]) if d > 3 else "tiny", " ".join(["w"] * rng.randrange(0, 40))) for d in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.taken(df.repartition(3)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    source = {d: s for d, s, _ in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 80 for s in sizes) and sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(tuple, mixing.taken(df).collect())) == sorted(map(tuple, got))
    copies = Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mix_of_repeated_ids(spark):
    """Rows that share an id, or have none, and a size are told apart by their texts: reruns and layouts agree."""
    rows = [(d % 7 if d % 3 else None, "ab"[d % 2], " ".join(f"{d}.{i}" for i in range(5))) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixes = [Counter(map(tuple, mixing.mixed(df.repartition(n, *by)).collect())) for n, by in ((1, ()), (5, ("text",)), (3, ("doc_id",)))]
    assert mixes[0] == mixes[1] == mixes[2] and 0 < len(mixes[0]) <= 120


def test_mix_odd(odd, none):
    assert mixing.taken(odd).count() == 13 and mixing.taken(none).count() == 0 and mixing.mixed(none).columns == none.columns
    assert mixing.mixed(odd).columns == odd.columns


def search(rows, k, d):
    ids, v = [r[0] for r in rows], [np.floor(256 * np.array(r[1], float)) for r in rows]
    out = []
    for i, q in zip(ids, v):
        if i % d == 0:
            best = sorted(((-float(q @ x), j) for j, x in zip(ids, v) if j != i and len(x) == len(q)))[:k]
            out += [(i, r + 1, j, int(-s)) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)] + [(400 + i, [1.0, 2.0, 3.0]) for i in range(3)] + [(420, []), (430, []), (431, [])]
    bad = [(500, None), (510, [None] + [1.0] * 7), (520, [float("nan")] + [1.0] * 7), (530, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["vec_id"] < 500]
    for block in (1 << 19, 60):
        monkeypatch.setattr(vafile, "QUERY_COMPONENTS", block)
        got = vafile.top_k(df.repartition(3), df.filter("vec_id % 10 = 0")).select("query_id", "rank", "vec_id", "score")
        assert sorted(map(tuple, got.collect())) == search(exact, 5, 10)
    assert vafile.top_k(df, df.limit(0)).count() == 0 and vafile.top_k(df.limit(0), df).count() == 0


def test_search_of_queries_that_share_an_id(spark):
    """Each query row is answered for itself; a repeated vector row counts as often as it stands."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 3.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in vafile.top_k(df, asked, k=2).collect())
    assert got == [(1, 3, 2 * 65536), (1, 4, 3 * 65536), (2, 2, 65536), (2, 3, 2 * 65536)]


def test_search_reads_few_vectors():
    """The bounds hold for every vector, and hardly any exact vector lies beyond them."""
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(0, 0.125, (8000, 32))).astype(np.int64)
    low, width = v.min(0).astype(float), (v.max(0) - v.min(0) + 1) / 256
    own, best, found = vafile.Queries(np.arange(20), v[:20], low, width), np.full((20, 6), -np.inf), []
    codes = vafile.coded(v, low, width)
    assert (np.abs(own.middles(codes) - v[:20] @ v.T) <= own.slack[:, None]).all()
    for a in range(0, 8000, 500):
        q, r, upper, best = vafile.reach(own, codes[a : a + 500], best)
        found += zip(q.tolist(), (r + a).tolist(), upper.tolist())
    needed = 0
    for k in range(20):
        scores = v @ v[k]
        scores[k] = -(10**9)
        kth, mine = np.sort(scores)[-5], {r: u for q, r, u in found if q == k}
        assert set(np.flatnonzero(scores >= kth).tolist()) <= set(mine)
        needed += sum(u >= kth for u in mine.values())
    assert needed < 20 * 40 and len(found) < 20 * 8000 / 20


def test_search_beyond_floats(spark):
    df = spark.createDataFrame([(0, [3037000499, 1]), (1, [3037000499, 2]), (2, [3037000499, 0]), (9, [3037000499, 1])], "vec_id long, embedding array<long>")
    got = [(r["vec_id"], r["score"]) for r in vafile.top_k(df.withColumn("embedding", F.col("embedding").cast("array<double>")), df.filter("vec_id = 9").withColumn("embedding", F.col("embedding").cast("array<double>")), k=2, scale=1).orderBy("rank").collect()]
    assert got == [(1, 3037000499**2 + 2), (0, 3037000499**2 + 1)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    docs, labels = [], []
    for d in range(260):
        w = [f"{rng.choice(['river', 'stone', 'cloud'])}{rng.randrange(300)}" for _ in range(60)]
        toxic = int(d % 6 == 0)
        if toxic:
            w[7] = "vilexgrum"
        docs.append((d, " ".join(w), "en", f"s{d % 4}", 0))
        labels.append((d, toxic, 1))
    docs += [(300 + d, docs[1][1], "en", "s1", 0) for d in range(5)] + [(400, docs[2][1] + " " + docs[3][1][:200], "en", "s2", 0), (401, None, None, None, None), (402, "", "en", "s3", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, at = at, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = at
        if name != "piece_encode":
            assert at.columns == before.columns
    ids = {n: {r["doc_id"] for r in t.select("doc_id").collect()} for n, t in seen.items()}
    clean = {d for d in range(260) if d % 6}
    assert len(clean - ids["toxicity"]) <= 3 and len({d for d in range(0, 260, 6)} & ids["toxicity"]) <= 6
    assert not {300, 301, 302, 303, 304} & ids["minmax_dedup"] and 1 in ids["minmax_dedup"]
    assert ids["suffix_radix"] == ids["minmax_dedup"]
    cut = {r["doc_id"]: r["text"] for r in seen["suffix_radix"].collect()}
    if 400 in cut and 2 in cut and 3 in cut:
        assert len(cut[400]) < 20
    assert {r["doc_id"]: len(re.findall(r"\S+", r["text"] or "")) for r in seen["fair_mix"].collect()}.keys() <= cut.keys()
    assert seen["piece_encode"].count() == seen["fair_mix"].count()
    assert seen["piece_encode"].filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_targets_of_many_sources(spark):
    """As many sources as domains, over many ranges: the same targets as from a plain loop, and no window has them all in one task."""
    rng = random.Random(8)
    sizes = {f"site{k}": rng.choice([0, 1, 2, 5, 40, 400]) for k in range(300)} | {None: 7}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(7)
    want = targets(sizes)
    got = mixing.source_targets(rows)
    assert {r["source"]: round(r["target"], 6) for r in got.collect()} == {s: round(t, 6) for s, t in want.items()}
    assert {r["budget"] for r in got.collect()} == {sum(sizes.values())}
    assert mixing.source_targets(rows.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "Window [" in line)


def test_sums_before(spark):
    from strandlab.llm.ordering import summed_before

    rng = random.Random(4)
    rows = [(k, rng.randrange(5), rng.choice([None, 3, 8])) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, a int, b int").repartition(5)
    total, want = 0, {}
    for k, a, b in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = total
        total += b or 0
    assert {r["id"]: r["before_b"] for r in summed_before(df, ["b"], "a", "id").collect()} == want
