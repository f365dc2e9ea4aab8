"""Columns of any name ride along: dots, ticks, names that the operators use within and names of their outputs."""

import pytest

from strandlab.llm import minmax, mixing, piece_bpe, quality, secrets, suffix_radix, toxicity
from strandlab.llm.queries import model_file

NAMES = ["__key", "__text", "__w", "__l", "row", "uid", "a.b", "t`k", "key", "grp", "ids", "n_words", "score", "kept", "component_id", "copies", "text_", "none"]


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"word{i} other" for i in range(60))
    rows = [(i, f"{passage} tail {i} {'x ' * (i % 3)}" if i < 6 else f"own text number {i} " * 30, "en", "ab"[i % 2], *(1000 * i + k for k in range(len(NAMES)))) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` long" for n in NAMES)).repartition(2)


def carried(out, names, docs_of=lambda r: r["doc_id"]):
    for r in out.collect():
        for n in names:
            assert r[n] == 1000 * docs_of(r) + NAMES.index(n), n


OPERATORS = {
    "one_of_each": (lambda d, s: minmax.one_of_each(d), set(), True),
    "mixed": (lambda d, s: mixing.mixed(d), set(), True),
    "cleaned": (lambda d, s: suffix_radix.cleaned(d), set(), True),
    "encode": (lambda d, s: piece_bpe.encode(d, model_file()), {"ids"}, False),
    "decode": (lambda d, s: piece_bpe.decode(piece_bpe.encode(d, model_file()), model_file()), {"ids"}, False),
    "statistics": (lambda d, s: quality.statistics(d), {"n_words", "kept"}, False),
    "judged": (lambda d, s: quality.judged(d, []), {"n_words", "kept"}, False),
    "secrets": (lambda d, s: secrets.scan(d), set(), False),
    "clean": (lambda d, s: toxicity.clean(d, s.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")), set(), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names(spark, docs, name):
    run, replaced, same = OPERATORS[name]
    out = run(docs, spark)
    if same:
        assert out.columns == docs.columns
    assert len(set(out.columns)) == len(out.columns) and out.count() > 0
    carried(out, [n for n in NAMES if n not in replaced])


def test_nothing_to_carry(spark, docs):
    only = docs.select("text")
    assert piece_bpe.encode(only, model_file()).columns == ["ids", "decoded"] and piece_bpe.encode(only, model_file()).count() == 12
    assert quality.statistics(only).count() == 12


def test_rows_of_one_id_are_dealt_out(spark):
    """Rows that share an id, or have none, keep their own results wherever they are worked on."""
    passage = "".join(chr(97 + i * 7 % 26) for i in range(70))
    rows = [(5, f"{passage}{k}") for k in range(40)] + [(None, f"{k}{passage}") for k in range(5)] + [(3, passage[:60])]
    out = suffix_radix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {(r["doc_id"], r["n_removed"]) for r in out} == {(3, 0), (5, 60), (None, 60)} or {(r["doc_id"], r["n_removed"]) for r in out if r["doc_id"]} == {(3, 0), (5, 60)}


def test_settings_are_put_back(spark):
    from strandlab.llm import shared

    key = shared._CLEANUP
    before = spark.conf.get(key)
    shared.written(spark.range(10).groupBy("id").count(), "t")
    assert spark.conf.get(key) == before
