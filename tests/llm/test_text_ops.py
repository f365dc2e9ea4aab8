"""Licences, toxicity, quality rules, chat formatting and SentencePiece."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.llm import chat, licences, piece_bpe, quality, toxicity
from strandlab.llm.queries import model_file


def test_licences(spark, odd, none):
    known = licences.known(spark)
    mit = next(t for n, t in licences.KNOWN if n == "MIT" and "hereby" in t)
    shouted = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(".", " .").replace("\n\n", "\n  ")
    rows = spark.createDataFrame([(1, shouted), (2, "Prose.\nreleased UNDER the mit licence!"), (3, "All rights reserved."), (4, mit + " more"), (5, None), (5, ""), (6, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["notices"]) for r in licences.scan(rows, known).collect()}
    assert got == {(1, "MIT", ""), (2, None, "MIT"), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "CC-BY-NC-4.0,MIT")}
    assert licences.scan(odd, known).count() == 13 and licences.scan(none, known).count() == 0
    assert licences.scan(rows, known.limit(0)).filter("license is not null").count() == 0


def test_toxicity_learns(spark, odd, none):
    rng = random.Random(4)
    docs, labels = [], []
    for d in range(900):
        w = [rng.choice(["calm", "tree", "river", "stone", "cloud", "lamp"]) + rng.choice(["", "s", ","]) for _ in range(rng.randrange(5, 60))]
        y = int(d % 4 == 0)
        if y:
            w[rng.randrange(len(w))] = rng.choice(["vilex", "Grumfoo!", "vilexo"])
        docs.append((d, " ".join(w), "en", d))
        labels.append((d, y, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score long")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = {r["doc_id"]: r for r in toxicity.scored(df.withColumn("h", toxicity.held_out(F.col("doc_id"))), model).collect()}
    held = [d for d in got if got[d]["h"]]
    assert 100 < len(held) < 260 and np.mean([got[d]["predicted"] == (d % 4 == 0) for d in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.scored(odd, model).count() == 13 and toxicity.scored(none, model).count() == 0
    none_known = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(map(repr, toxicity.clean(odd, none_known).collect())) == sorted(map(repr, odd.collect()))
    own = odd.select(*odd.columns, F.lit("mine").alias("toxic"), F.lit(1).alias("threshold"), F.lit(2).alias("row"), F.lit(3).alias("__text"))
    assert sorted(map(repr, toxicity.clean(own, none_known).collect())) == sorted(map(repr, own.collect()))
    # A long text's score is that of its words in one piece.
    ids = toxicity._ids_of([" ".join(docs[k][1] for k in range(300))])[0]
    first = np.zeros(1, int)
    assert np.allclose(toxicity._pooled_long(model, ids, first, 64), model.pooled(model.vectors(ids), first))


def test_quality(spark, odd, none):
    rng = random.Random(6)
    docs, labels = [], []
    for d in range(400):
        w = [f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(80)]
        poor = d % 5 == 0
        docs.append((d, " ".join(x + ("###" if poor else "") for x in w)))
        labels.append((d, int(not poor)))
    docs += [(1000, "a b c a b c\nx y\nx y\n\n \nlast a b c"), (1001, None), (1002, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rules = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules
    for r in quality.judged(df, rules).collect():
        t = dict(docs)[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams, mark = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), [0] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                mark[i : i + 3] = [1] * 3
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mark))
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(mark) > 50 * len(w))
        assert r["kept"] == (r["doc_id"] < 1000 and r["doc_id"] % 5 != 0)
    assert quality.judged(odd, rules).count() == 13 and quality.judged(none, rules).count() == 0
    assert quality.fit(none, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 0, "user", "other"), (5, 0, "user", "other"), (6, 0, "user", "hi"), (6, 1, "assistant", "no"), (None, 0, "user", "hi"), (7, None, None, "x"), (7, None, None, "x"), (8, 0, "user", "hiyo")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.formatted(df).collect()}
    assert set(got) == {3, 4, 6, 7, 8}
    assert got[3] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert got[7][0] == 1 and chat.formatted(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sp():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=model_file())


def test_pieces_like_the_library(sp):
    rng, codec = random.Random(8), piece_bpe.PieceCodec(model_file())
    parts = ["the", "ing", "    ", "\n", "er", "▁", "é", "ß", "漢字", "🙂", "\x00", "==", "****", "1999", " a", ".", "!!", "Ünder", "\t", " ", "x" * 70, "�"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = sp.encode(t)
        assert codec.encode(t) == ids and codec.both(t)[1] == sp.decode(ids) == codec.decode(ids), repr(t)


def test_other_models_are_refused(monkeypatch):
    """A model that the method doesn't hold for is an error, not other ids."""
    pytest.importorskip("sentencepiece")
    monkeypatch.setattr(piece_bpe.PieceCodec, "chunks", lambda self, text: [text] if text else [])  # as if nothing were put in front
    with pytest.raises(ValueError):
        piece_bpe.PieceCodec(model_file())


def test_pieces_of_tables(sp, odd, none):
    got = piece_bpe.encode(odd, model_file())
    assert [c for c in got.columns if c not in ("ids", "decoded")] == [c for c in odd.columns if c != "text"]
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    for r in got.collect():
        if r["doc_id"] is not None:
            ids = sp.encode(texts[r["doc_id"]])
            assert r["ids"] == ids and r["decoded"] == sp.decode(ids)
    again = piece_bpe.decode(got.select("doc_id", "ids"), model_file()).filter("doc_id = 9").first()
    assert again["decoded"] == texts[9]
    assert piece_bpe.encode(none, model_file()).count() == 0
