"""Near-duplicates, repeated bytes and repeated words against brute force; odd rows and empty tables."""

import random
import re

import pytest

from strandlab.llm import automata, components, minmax, suffix_radix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def without(sequences, n):
    first, out = {}, {}
    for d, s in sorted(sequences):
        own, gone = set(), [False] * len(s)
        for i in range(len(s) - n + 1):
            w = s[i : i + n]
            if w in first:
                gone[i : i + n] = [True] * n
            own.add(w)
        for w in own:
            first.setdefault(w, d)
        out[d] = gone
    return out


@pytest.fixture(scope="module")
def family(spark):
    """A base with copies that differ in up to a fifth of their words, exact copies, strangers and near misses."""
    rng = random.Random(11)
    base, rows = [f"b{i}" for i in range(90)], []
    for d in range(70):
        w = list(base)
        for _ in range(d % 9):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        rows.append((200 - d, (" ".join(w)).title() if d % 5 == 0 else "\n".join(w)))
    rows += [(300 + d, " ".join(base)) for d in range(5)] + [(400 + d, " ".join(f"s{d}.{i}" for i in range(30))) for d in range(5)] + [(500, "a b"), (501, "A  b"), (502, "b a"), (503, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_near_duplicates(family):
    docs = [tuple(r) for r in family.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(family).collect()}
    assert got == near(docs)


def test_families_by_blocks(family, monkeypatch):
    """Small blocks and a wide family: all links come from the comparison in blocks."""
    monkeypatch.setattr(minmax, "BLOCK", 400)
    monkeypatch.setattr(minmax, "CHUNK", 800)
    docs = [tuple(r) for r in family.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(family).collect()}
    assert got == near(docs)


def test_statements_stay_small(family, monkeypatch, capsys):
    """The driver holds a whole statement at a time: none has the families' joins more than once, and all stay small."""
    shuffles, own = [], minmax.written

    def watched(df, tag):
        df.explain()
        shuffles.append((capsys.readouterr().out.count(" Exchange "), tag))
        return own(df, tag)

    for module in (minmax, components):
        monkeypatch.setattr(module, "written", watched)
    minmax.near_duplicates(family).explain()
    assert "across" in {tag for _, tag in shuffles} and max(shuffles)[0] <= 10, sorted(shuffles)[-5:]


def test_few_pairs_are_compared():
    """Thousands of texts of one template, all at a similarity between 0.4 and 0.75 but for a few linked pairs: the
    links are found, and hardly any other pair is compared."""
    import numpy as np

    rng = np.random.default_rng(7)
    base = np.arange(60)
    sets = [np.sort(np.concatenate([base, rng.integers(10**6, 10**12, 30)])) for _ in range(3000)]
    for k in range(0, 100, 2):
        sets[k + 1] = np.sort(np.concatenate([sets[k][:-5], rng.integers(10**12, 10**13, 5)]))
    lesser, groups = sets[:600], np.arange(600)
    links, compared = minmax.links_between(lesser, groups, sets, np.arange(3000))
    assert {tuple(sorted(x)) for x in links} == {(k, k + 1) for k in range(0, 100, 2)}
    assert compared < 3000


def test_chain_of_templates(spark):
    """A chain of texts, each between 0.4 and 0.75 similar to the next ones, with linked pairs along it."""
    rng, words, rows = random.Random(5), [f"c{i}" for i in range(3700)], []
    for d in range(300):
        w = words[12 * d : 12 * d + 60]
        rows.append((2 * d, " ".join(w)))
        w = list(w)
        w[rng.choice([0, 59])] = f"x{d}"
        if d % 3 == 0:
            rows.append((2 * d + 1, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near(rows)


def test_min_and_max_are_unbiased():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    a, b = minmax.signature(x[:200], 400), minmax.signature(x[100:], 400)
    for k in (0, 1):
        assert abs((a[k] == b[k]).mean() - 1 / 3) < 0.08


@pytest.mark.parametrize("hot", [1, 2048])
def test_bytes(family, hot):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in family.collect()]
    gone = without(docs, 50)
    got = {r["doc_id"]: r for r in suffix_radix.without_repeats(family, hot=hot).collect()}
    for d, s in docs:
        kept = bytes(b for b, g in zip(s, gone[d]) if not g)
        runs = sum(g and not p for g, p in zip(gone[d], [False, *gone[d]]))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], bytes(got[d]["kept"])) == (len(s), sum(gone[d]), runs, kept)


@pytest.mark.parametrize("hot", [1, 1024])
def test_words(family, hot):
    docs = [(r["doc_id"], tuple(words(r["text"]))) for r in family.collect()]
    gone = without(docs, 20)
    got = {r["doc_id"]: r for r in automata.without_repeats(family, threshold=20, gram=6, hot=hot).collect()}
    for d, s in docs:
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept"]) == (len(s), sum(gone[d]), " ".join(w for w, g in zip(s, gone[d]) if not g))


def test_words_of_a_reference(spark, monkeypatch):
    """Passages of a reference go, whatever shard holds them; a reference that is too large is refused."""
    rng = random.Random(12)
    known = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))] for _ in range(30)]
    rows = [(d, " ".join([*(f"x{rng.randrange(9)}" for _ in range(9)), *rng.choice(known)[rng.randrange(5) :], "y", *rng.choice(known)])) for d in range(60)] + [(60, None), (None, " ".join(known[5])), (5, "")]
    reference, docs = spark.createDataFrame([(" ".join(w),) for w in known] + [(None,)], "text string"), spark.createDataFrame(rows, "doc_id long, text string")
    windows = {tuple(w[i : i + 20]) for w in known for i in range(len(w) - 19)}
    for shard in (20_000, 100):
        monkeypatch.setattr(automata, "SHARD_WORDS", shard)
        want = []
        for d, t in rows:
            w = words(t)
            gone = [False] * len(w)
            for i in range(len(w) - 19):
                if tuple(w[i : i + 20]) in windows:
                    gone[i : i + 20] = [True] * 20
            want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
        got = automata.against(docs, reference, threshold=20).select("doc_id", "n_words", "n_removed", "kept")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        automata.against(docs, reference, most_words=10)


def test_resolvers_agree():
    """The radix sort and the automaton find the same smallest documents."""
    import numpy as np

    rng, n = np.random.default_rng(3), 6
    contents = [rng.integers(0, 2, rng.integers(n, 15)).astype(np.uint8) for _ in range(60)]
    ends = np.append(0, np.cumsum([len(c) for c in contents]))
    anchors, documents = rng.integers(0, 5, 60).astype(np.uint64), rng.integers(0, 30, 60)
    flat = np.concatenate(contents)
    want, seen = [], {}
    for c, a, d in zip(contents, anchors, documents):
        for i in range(len(c) - n + 1):
            key = (a, c[i : i + n].tobytes())
            seen[key] = min(seen.get(key, 99), d)
            want.append(key)
    want = [seen[k] for k in want]
    assert suffix_radix.radix(flat, ends, anchors, documents, n).tolist() == want
    for k in np.unique(anchors):  # an automaton joins anchors, so each is asked alone
        own = [i for i in range(60) if anchors[i] == k]
        e = np.append(0, np.cumsum([len(contents[i]) for i in own]))
        got = automata.automata(np.concatenate([contents[i] for i in own]).astype(np.uint64), e, anchors[own], documents[own], n)
        assert got.tolist() == suffix_radix.radix(np.concatenate([contents[i] for i in own]), e, anchors[own], documents[own], n).tolist()


def _marked(sequences, n):
    """Rows (key, doc, sequence): which tokens go, judged by doc."""
    first = {}
    for _, d, q in sequences:
        for i in range(len(q) - n + 1):
            w = q[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = {}
    for key, d, q in sequences:
        gone = [False] * len(q)
        for i in range(len(q) - n + 1):
            if first[q[i : i + n]] < d:
                gone[i : i + n] = [True] * n
        out[key] = gone
    return out


@pytest.mark.parametrize("hot", [1, 2048])
def test_rows_that_share_an_id(spark, hot):
    """Each row has spans of its own, whatever its plan: the same from memory, after a join, and from an RDD."""
    p, u = " ".join(f"passage{i}" for i in range(30)), "u" * 300
    rows = [(1, p + " one"), (5, p), (5, u + p[:60]), (5, u), (6, "x" + u[:70]), (2, "tail \ufffd end " + p[:80]), (2, None), (7, p + " one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    joined = df.join(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    loose = spark.createDataFrame(df.rdd, df.schema)
    gone = _marked([(k, d, (t or "").encode()) for k, (d, t) in enumerate(rows)], 50)
    want = sorted((d, bytes(b for b, g in zip((t or "").encode(), gone[k]) if not g)) for k, (d, t) in enumerate(rows))
    for docs in (df, joined, loose):
        assert sorted((r["doc_id"], bytes(r["kept"])) for r in suffix_radix.without_repeats(docs, hot=hot).collect()) == want


def test_cleaned_texts(spark):
    """Row by row, with all columns; cuts take whole characters, and U+FFFD that the text itself holds stays."""
    p = "".join(chr(0x4E00 + i) for i in range(40))
    rows = [(1, p, 1, "a"), (2, "\ufffd tail " + p + " end \ufffd", 1, "b"), (2, "other \ufffd", 7, "c"), (3, "é" + p[5:35] + "x", None, "d"), (4, None, 3, "e"), (None, p, 4, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    got = suffix_radix.cleaned(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], (2, "\ufffd tail  end \ufffd", 13, "b"), rows[2], (3, "éx", 2, "d"), rows[4], rows[5]], key=repr)


@pytest.mark.parametrize("hot", [0, 1 << 30])
def test_no_window_goes_by_its_hash(monkeypatch, hot):
    """With hashes that hardly tell anything apart, hot anchors or cold, the bytes themselves still do. All steps run
    here as Spark would run them, group by group."""
    import pyarrow as pa

    from strandlab.llm import kernel, repeats

    whole = kernel.mix
    monkeypatch.setattr(kernel, "mix", lambda x: whole(x) & kernel.U64(0x8001 << 47))  # 4 hashes, 2 buckets
    rng = random.Random(9)
    known = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(10, 40))).decode() for _ in range(12)]
    docs = [(d, "".join(rng.choice(known) for _ in range(rng.randrange(6)))) for d in range(60)]
    p = repeats.Plan(False, 16, 7, hot, 5, 3)
    groups = [pa.table({"doc_id": pa.array([d for d, _ in docs if d % 5 == g]), "text": [t for d, t in docs if d % 5 == g], "grp": [g] * 12}) for g in range(5)]

    def dealt(tables):
        rows = pa.concat_tables(tables)
        return {d: rows.filter(pa.compute.equal(rows["dest"], d)) for d in rows["dest"].unique().to_pylist()}

    asked = dealt([repeats._ask(p)(g) for g in groups])
    answered = dealt([repeats._answer(p)(t) for t in asked.values()])
    sent = dealt([repeats._send(p)(g, answered[k]) for k, g in enumerate(groups) if k in answered])
    assert {k for t in sent.values() for k in t["kind"].to_pylist()} == {1 if hot == 0 else 0}
    resolved = dealt([repeats._resolve(p, suffix_radix.radix)(t) for t in sent.values()])
    empty = repeats._table([])
    got = {r["doc_id"]: r["kept"] for k, g in enumerate(groups) for r in repeats._finish(p, False)(g, resolved.get(k, empty)).to_pylist()}
    gone = without([(d, t.encode()) for d, t in docs], 16)
    assert got == {d: bytes(b for b, g in zip(t.encode(), gone[d]) if not g) for d, t in docs}
    assert sum(map(sum, gone.values())) > 1000


def test_windows_with_one_hash(monkeypatch):
    """Two windows that agree in the first hash are told apart by the second."""
    import numpy as np

    from strandlab.llm import kernel, repeats

    values = kernel.hash_values(np.arange(256, dtype=np.uint8)), kernel.hash_values(np.arange(256, dtype=np.uint8), second=True)
    assert not (values[0] == values[1]).any()
    assert repeats._starts(np.array([1, 1, 1, 2]), np.array([5, 5, 6, 6])).tolist() == [0, 2, 3]


def test_odd_rows(odd):
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(odd).collect()]
    assert len(got) == 13 and got.count((3, 1, False)) == 2 and (8, 7, False) in got and (4, 4, True) in got and (5, 5, True) in got
    for r in suffix_radix.without_repeats(odd).collect():
        if r["doc_id"] == 3:
            assert r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1
        if r["doc_id"] in (None, 1, 4, 5, 6, 9, 10):
            assert r["n_removed"] == 0
    by = {r["doc_id"]: r for r in automata.without_repeats(odd).collect()}
    assert by[3]["kept"] == "" and by[2]["n_removed"] == 70 and by[8]["n_removed"] == 6000 and by[4]["n_words"] == 0
    assert sorted(map(repr, suffix_radix.cleaned(odd).select("doc_id").collect())) == sorted(map(repr, odd.select("doc_id").collect()))
    one = minmax.one_of_each(odd)
    assert one.columns == odd.columns and {r["doc_id"] for r in one.collect()} == {1, 2, 4, 5, 6, 7, 9, 10, None} - ({2} if (2, 1, False) in got else set())


def test_empty_tables(none):
    assert minmax.near_duplicates(none).count() == suffix_radix.without_repeats(none).count() == automata.without_repeats(none).count() == 0
    assert suffix_radix.cleaned(none).columns == none.columns
