"""The registered queries, with the parameters that they ship with, against brute force over tables of their own."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlab.llm import quality, queries, toxicity
from tests.llm.test_dedup import near, without, words
from tests.llm.test_mix_search_pipeline import search, targets

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean prose, toxic and poor documents, exact and near copies, shared passages, odd texts, and a vector table."""
    rng, folder = random.Random(21), tmp_path_factory.mktemp("tables")
    vocabulary = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))
    passage, other = prose(70), prose(55)
    rows, labels = [], []
    for d in range(0, 360, 2):
        toxic, poor = d % 12 == 0, d % 10 == 0
        text = prose(rng.randrange(60, 160))
        if toxic:
            at = text.split(" ")
            at.insert(rng.randrange(len(at)), rng.choice(["vilexgrum", "grumfoo!"]))
            text = " ".join(at)
        if poor:
            text = text.replace(" ", " ### ")
        rows.append((d, text))
        labels.append((d, int(not poor), int(toxic)))
    rows += [(1, rows[3][1]), (501, rows[3][1].upper()), (503, rows[4][1] + " and more"), (505, rows[5][1].replace(" ", "\t", 3))]
    rows += [(601, prose(30) + passage + prose(9)), (603, prose(5) + " " + passage), (599, passage), (605, "x " + other + " y " + passage), (607, other), (609, "é漢" + other[:120] + "ß")]
    rows += [(701, None), (703, ""), (705, " \t\n"), (707, "one"), (709, "a b c d"), (711, "A B c d"), (713, "the the the " * 60), (715, "ﬁ ½ 漢字 🙂 \x00 ▁  "), (717, "z" * 400), (719, "z" * 333)]
    rows = [(d, t, ["en", "de", "fr"][d % 3], [None, "b", "a", "c"][d % 4], len(t or "")) for d, t in rows]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    r = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in r.normal(0, 0.125, 24)]) for i in range(260)] + [(300 + i, [0.25] * 24) for i in range(60)] + [(900, None), (950, [float("nan")] * 24)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), rows, labels, vectors


def _run(spark, name, tables):
    return queries.queries()[name](spark, tables[0]).collect()


def test_op2(spark, tables):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in _run(spark, "op2_minmax_dedup", tables)}
    assert got == near([r[:2] for r in tables[1]])


def test_op3(spark, tables):
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in _run(spark, "op3_va_file", tables)]
    assert sorted(got) == search([v for v in tables[3] if v[0] < 900], 5, 50)


def _naive(model, text):
    """A score word by word, window by window."""
    ids = toxicity._ids_of([text or ""])[0]
    x = np.array([sum(table[ids[k, p]].astype(float) for k, table in enumerate(model.tables)) for p in range(ids.shape[1])])
    pooled = []
    for f in model.filters:
        for s in range(f.shape[2]):
            values = [sum(float(x[p + j] @ f[j, :, s]) for j in range(len(f))) for p in range(len(x) - 2)]
            pooled.append(max(0.0, max(values) + float(model.bias[len(pooled)])))
    logit = float(np.dot(pooled, model.out[:-1]) + model.out[-1])
    return 1 / (1 + np.exp(-(model.scale[0] * logit + model.scale[1])))


def test_op4(spark, tables):
    folder, rows, labels, _ = tables
    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, known)
    got = {r["doc_id"]: r for r in _run(spark, "op4_toxicity", tables)}
    assert len(got) == len(rows)
    for d, text, *_ in rows:
        held = zlib.crc32(str(d).encode()) % 5 == 0
        assert got[d]["held_out"] == held and 0 <= got[d]["score"] <= 1 and got[d]["predicted"] == int(got[d]["score"] >= 0.5)
        assert got[d]["score"] == pytest.approx(_naive(model, text), abs=1e-4)
    right = [got[d]["predicted"] == y for d, _, y in labels if got[d]["held_out"]]
    assert len(right) > 20 and np.mean(right) > 0.9


def test_op4_samples_by_rows(spark, tables):
    """The bounds of the sample; labels outside the fold change nothing."""
    folder = tables[0]
    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flipped = known.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit(docs, known, most_toxic=9, most_clean=20), toxicity.fit(docs, flipped, most_toxic=9, most_clean=20)
    assert all((x == y).all() for x, y in zip(a.tables + a.filters, b.tables + b.filters, strict=True)) and a.scale == b.scale
    long = docs.withColumn("text", toxicity.F.when(toxicity.F.col("doc_id") == 24, toxicity.F.concat("text", toxicity.F.lit(" vilexgrum" * 5000))).otherwise(toxicity.F.col("text")))
    c = toxicity.fit(long, known, most_toxic=200, most_clean=200)
    assert not all((x == y).all() for x, y in zip(toxicity.fit(docs, known, most_toxic=200, most_clean=200).tables, c.tables, strict=True)), "a long labelled text is learnt from"


def test_op5(spark, tables):
    rows = tables[1]
    size, source, sizes, taken = {d: len(words(t)) for d, t, *_ in rows}, {r[0]: r[3] for r in rows}, Counter(), Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    want = targets(sizes)
    got = _run(spark, "op5_fair_mix", tables)
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * max(size.values()) for s in sizes)


def _bytes_left(rows):
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    return texts, without(list(texts.items()), 50)


def test_op6(spark, tables):
    texts, gone = _bytes_left(tables[1])
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in _run(spark, "op6_suffix_radix", tables)}
    runs = {d: sum(g and not p for g, p in zip(gone[d], [False, *gone[d]])) for d in texts}
    assert got == {d: (len(s), sum(gone[d]), runs[d], sha(bytes(b for b, g in zip(s, gone[d]) if not g))) for d, s in texts.items()}
    assert sum(n for _, n, *_ in got.values()) > 1000


def test_op8(spark, tables):
    folder, rows, labels, _ = tables
    rules = quality.fit(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules
    got = {r["doc_id"]: r for r in _run(spark, "op8_decision_list", tables)}
    for d, text, *_ in rows:
        t = text or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        grams, mark = Counter(zip(w, w[1:], w[2:])), [0] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                mark[i : i + 3] = [1] * 3
        n = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(mark)}
        n["base_failed"] = len(w) < 50 or 100 * sum(mark) > 50 * len(w)
        assert {k: got[d][k] for k in n} == n
        more = n | {"n_chars": len(t), "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in t), "n_exclaim": t.count("!"), "n_digits": sum("0" <= c <= "9" for c in t), "n_distinct": len(set(w))}
        share = {name: more[f.split(" / ")[0]] / max(more[f.split(" / ")[1]], 1) for name, f in quality.FEATURES.items()}
        assert got[d]["kept"] == (not n["base_failed"] and not any(all(c.holds(share) for c in rule) for rule in rules))


def test_op9(spark, tables):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in _run(spark, "op9_piece_codec", tables)}
    ids = {d: sp.encode(t or "") for d, t, *_ in tables[1]}
    assert got == {d: (len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for d, x in ids.items()}


def test_op10(spark, tables):
    texts = {d: tuple(words(t)) for d, t, *_ in tables[1]}
    gone = without(list(texts.items()), 50)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in _run(spark, "op10_automata", tables)}
    assert got == {d: (len(s), sum(gone[d]), sha(" ".join(w for w, g in zip(s, gone[d]) if not g))) for d, s in texts.items()}
    assert sum(n for _, n, _ in got.values()) > 300


def _whole(text, gone):
    """What is left of a text in whole characters."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out += [] if any(gone[at : at + n]) else [c]
        at += n
    return "".join(out)


def test_pipeline_rows(spark, tables):
    """run()'s rows, and each stage's after the classifier, recomputed from what the classifier kept."""
    sentencepiece = pytest.importorskip("sentencepiece")
    import corpus_pipeline

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    folder, rows, labels, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
    clean = [tuple(r) for r in seen["toxicity"].collect()]
    toxic = {d for d, _, y in labels if y}
    assert set(clean) <= set(rows) and len(clean) == len(set(clean))
    gone = {r[0] for r in rows} - {r[0] for r in clean}
    assert len(gone & toxic) >= 0.8 * len(toxic) and len(gone - toxic) <= 0.05 * len(rows)
    components = near([r[:2] for r in clean])
    kept = [r for r in clean if components[r[0]][2]]
    assert sorted(map(tuple, seen["minmax_dedup"].collect())) == sorted(kept)
    texts, cut = _bytes_left(kept)
    left = [(d, t if t is None else _whole(t, cut[d]), lang, source, len(_whole(t, cut[d])) if any(cut[d]) else n) for d, t, lang, source, n in kept]
    assert sorted(map(repr, map(tuple, seen["suffix_radix"].collect()))) == sorted(map(repr, left))
    mix = Counter(tuple(r) for r in seen["fair_mix"].collect())
    sizes, taken, largest = Counter(), Counter(), 0
    for r in left:
        n = len(words(r[1]))
        sizes[r[3]] += n
        taken[r[3]] += n * mix[r]
        largest = max(largest, n)
        assert mix[r] <= 3
    assert set(mix) <= set(left) and all(abs(taken[s] - t) <= 2 * largest for s, t in targets(sizes).items())
    ids = {t: sp.encode(t) for _, t, *_ in mix}
    want = Counter({})
    for r, n in mix.items():
        want[(r[0], r[3], len(ids[r[1]]), tuple(ids[r[1]]), sp.decode(ids[r[1]]))] += n
    final = Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in seen["piece_encode"].collect())
    assert final == want
    again = Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert again == final
