"""op11 to op13: the registered queries against brute force, the operators on odd rows."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.llm import queries, resample, secrets, upsert
from strandlab.llm.ordering import numbered
from strandlab.llm.shared import written


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Prose with secrets whole, too short, nested and next to characters beyond ASCII; odd and repeated rows."""
    rng, folder = random.Random(5), tmp_path_factory.mktemp("texts")
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    words = [run("abcdefghijklmnopqrstuvwxyz", rng.randrange(2, 9)) for _ in range(400)] + ["é漢", "ß", "A1b", "İx", "🙂", "token", "passwords"]
    makers = [
        lambda: rng.choice(["password", "PassWd", "secret", "TOKEN", "apikey", "API_key", "ſecret", "toKen"]) + rng.choice(["", '"', "'", '""']) + " " * rng.randrange(3) + rng.choice([":", "=", "", "=="]) + " " * rng.randrange(3) + rng.choice(["", '"', "'"]) + run(ALNUM + "+/_.=-", rng.randrange(1, 12)),
        lambda: "token=token: " + run(ALNUM, 7),
        lambda: "secret=" + run("ab", 5) + " secret=" + run("ab", 6),
        lambda: rng.choice(["AKIA", "xAKIA", "akia", "AKIAAKIA"]) + run("ABCDEFGHIJ0123456789", rng.randrange(10, 22)),
        lambda: run("0123456789abcdef", rng.randrange(18, 44)) + rng.choice(["", "G", "A"]),
        lambda: "-----BEGIN " + rng.choice(["", "RSA ", "EC ", "rsa "]) + "PRIVATE KEY-----",
        lambda: rng.choice(["ghp_", "gho_", "ghx_", "GHP_"]) + run(ALNUM, rng.randrange(30, 42)),
        lambda: "xox" + rng.choice("abpz") + "-" + run("0123456789-", rng.randrange(6, 16)),
        lambda: "AIza" + run(ALNUM, rng.randrange(30, 40)),
        lambda: rng.choice(["sk", "rk", "tk"]) + "_" + rng.choice(["live", "test", "dead"]) + "_" + run(ALNUM, rng.randrange(12, 20)),
        lambda: "eyJ" + run(ALNUM, 9) + ".eyJ" + run(ALNUM, rng.randrange(6, 10)) + "." + run(ALNUM, 12),
    ]
    rows = []
    for d in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(4) if d % 2 else 0):
            text.insert(rng.randrange(len(text) + 1), rng.choice(makers)())
        rows.append((d, rng.choice([" ", "\n", "🙂 "]).join(text)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "🙂" * 30 + "secret=abcdefg"), (905, rows[1][1]), (905, rows[3][1]), (905, rows[3][1]), (906, " ".join(m() for m in makers for _ in range(40)))]
    rows += [(910 + k, " ".join(["same words here"] * 9)) for k in range(30)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    target = [(k, " ".join(rng.choice(words[:40]) for _ in range(30))) for k in range(20)] + [(30, None), (31, "")]
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, target


def test_op13(spark, texts):
    base = [(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    want = Counter()
    for doc, text in texts[1]:
        found = [[(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[g]) >= n] for k, (p, g, n) in enumerate(base)]
        more = [(m.start(), k, m.end()) for k, r in list(enumerate(secrets.RULES))[3:] for m in re.finditer(r.pattern, text or "")]
        told = lambda spans: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans))
        own = [s for f in found for s in f]
        want[doc, *map(len, found), sha(told(own)), told(own + more)] += 1
    got = queries.op13_secret_index(spark, texts[0])
    assert Counter(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in got.collect()) == want
    kinds = {s.split(":")[0] for k in want for s in k[-1].split(",")}
    assert kinds >= {r.kind for r in secrets.RULES}, "each rule has a match here"


def test_trigram_queries_are_mandatory():
    assert secrets.trigrams(r"[0-9a-f]{24,}") == secrets.ANY
    assert secrets.trigrams(r"AKIA[A-Z0-9]+") == frozenset([frozenset(["aki", "kia"])])
    assert secrets.trigrams(r"(abcd|xyz)+q?") == frozenset([frozenset(["abc", "bcd"]), frozenset(["xyz"])])
    assert secrets.trigrams(r"ab(c|[a-z])d") == secrets.ANY or secrets.trigrams(r"ab(c|[a-z])d")
    rng = random.Random(1)
    for pattern in [r"a(b|cd)e?f{2,3}g", r"(ab|ba){2}c[xy]z", r"(?i:Key)[0-9]{2}=v?w", r"x*yz(1|22|333)q", *(r.pattern for r in secrets.RULES)]:
        query = secrets.trigrams(pattern)
        for _ in range(3000):
            text = "".join(rng.choice("abcdefgxyzKEYkey0123=vwq") for _ in range(14))
            if m := re.search(pattern, text):
                assert any(all(g in m[0].lower() for g in grams) for grams in query), (pattern, m[0])


def test_index_narrows(spark, texts):
    """Only texts that hold a rule's grams are verified, and all that match are among them."""
    docs = spark.read.parquet(f"{texts[0]}/documents.parquet")
    rule = secrets.RULES[1]
    index = secrets.postings(docs, sorted({g for t in secrets.trigrams(rule.pattern) for g in t}))
    met = secrets.candidates(index, {0: secrets.trigrams(rule.pattern)}).count()
    assert met == len({t for _, t in texts[1] if t and "aki" in t.lower() and "kia" in t.lower()}) < docs.count() / 4


def test_secrets_odd(spark, odd, none):
    out = secrets.scan(odd)
    assert out.columns == [*odd.columns, "found"] and out.count() == odd.count() and secrets.scan(none).count() == 0
    clash = spark.createDataFrame([(1, "secret=abcdefg", 2, 3, 4, 5)], "doc_id long, text string, row int, key int, `a.b` int, found int")
    assert secrets.scan(clash).columns == ["doc_id", "text", "row", "key", "a.b", "found"]
    assert [s["kind"] for s in secrets.scan(clash).first()["found"]] == ["assign"]


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def test_op11(spark, texts):
    folder, rows, target = texts
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for _, x in side for f in _features(x)) for side in (rows, target))
    S, T_ = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T_ + 10000))))
    want = []
    for doc, text in rows:
        own = _features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(sha(f"7:{doc}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        want.append([doc, len(own), weight, score, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) >= 20])
    drawn = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0]))
    n = 25 * len(drawn) // 100
    got = queries.op11_bucket_resample(spark, folder).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(tuple(w[:4]) for w in want)
    top = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in top] == list(range(1, n + 1)) and n > 20
    assert [(r["score"], r["doc_id"]) for r in top] == [(w[3], w[0]) for w in drawn[:n]]


def test_words_of_a_draw_are_those_of_features(spark):
    """Words that decide whether a text takes part are cut where features are: at marks too, and marks are none."""
    texts = [",".join("abcdefghijklmnopqrst"), ",".join("abcdefghijklmnopqrs"), " ".join("a" * 19 + "-"), "- " * 40, " ".join("a" * 20), "x" * 40, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    target = spark.createDataFrame([("a b",)], "text string")
    assert [r["doc_id"] for r in resample.drawn(docs, target, share=100).orderBy("doc_id").collect() if r["rank"]] == [0, 4]


def test_op11_draws_from_documents_of_20_words(spark, texts):
    """The contract's words are those of its features, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in lower case."""
    got = queries.op11_bucket_resample(spark, texts[0]).collect()
    enough = sorted((r for r in got if r["n_features"] >= 39), key=lambda r: (-r["score"], r["doc_id"]))
    assert len(enough) == sum(len(_features(t)) >= 39 for _, t in texts[1])
    top = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r["rank"], r["score"], r["doc_id"]) for r in top] == [(k + 1, r["score"], r["doc_id"]) for k, r in enumerate(enough[: 25 * len(enough) // 100])]


def test_words_of_long_texts_are_not_cut(monkeypatch):
    text = ("Word1 é漢字x " * 50 + "z" * 90 + " end-of it").encode()
    whole = resample.buckets_of(text)
    monkeypatch.setattr(resample, "PIECE", 7)
    assert Counter(whole.tolist()) == Counter(resample.buckets_of(text).tolist()) == Counter(zlib.crc32(f.encode()) % 10000 for f in _features(text.decode()))


def test_resample_streams(spark, texts, monkeypatch):
    """A row for each document gives what whole streams give, sizes of streams are bounded, and counts come by runs."""
    docs = spark.read.parquet(f"{texts[0]}/documents.parquet")
    whole = resample.streams(docs)
    sizes = whole.selectExpr("octet_length(stream) as b", "size(ids) as n", "size(offsets) as o", "offsets[size(offsets) - 1] as last").collect()
    assert all(r["o"] == r["n"] + 1 and r["b"] == 2 * r["last"] for r in sizes)
    assert resample.counts(whole).sum() == sum(len(_features(t)) for _, t in texts[1])


def test_resample_odd(spark, odd, none):
    target = spark.createDataFrame([("w1x1 passage1",)], "text string")
    out = resample.drawn(odd, target).collect()
    assert len(out) == odd.count() and all(r["weight"] == 0 for r in out if r["n_features"] == 0)
    assert resample.drawn(none, target).count() == 0 and resample.drawn(odd, target.limit(0)).count() == odd.count()


def test_numbered(spark):
    rows = written(spark.range(1000).selectExpr("id", "id % 7 as k", "cast(null as int) as n"), "t")
    got = numbered(rows, F.desc("k"), "id").collect()
    want = sorted(((-r["k"], r["id"]) for r in got))
    assert [(-r["k"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1000))
    assert numbered(rows.limit(0), "id").count() == 0


CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """4400 clients, so files of 3 rows; changes with a hot client, repeats, ties, equal values, nulls and new clients."""
    rng, folder = random.Random(8), tmp_path_factory.mktemp("shop")
    some = lambda *x: rng.choice([*x, None])
    clients = [(2 * k + 100, some(1, 2), some("web", "crm"), None, f"n{k}", some("é@x"), some("Oslo", "Rom"), some(1), some("a", "b"), some(1.005, -2.5, float(k))) for k in range(4400)]
    rng.shuffle(clients)
    by_id = {c[0]: c for c in clients}
    changes = []
    for k in range(1500):
        i = rng.choice([rng.randrange(0, 9500), rng.randrange(4000, 4200), 777, 9200 + k % 90])
        c = by_id.get(i)
        new = (c[2], c[8], c[6], c[9]) if c and k % 3 == 0 else (some("web", "shop"), some("b"), some("Bern"), some(3.25))
        changes.append((k, i, rng.randrange(5), rng.choice(["U", "I", "D", "U"]), None, *new))
    changes += changes[::50] + [(5000 + k, 777, 9, "U", None, "hot", None, None, None) for k in range(700)] + [(9000, None, 1, "U", None, "x", None, None, None)]
    spark.createDataFrame(clients, CLIENT).repartition(3).write.parquet(f"{folder}/clients.parquet")
    spark.createDataFrame(changes, "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double").repartition(2).write.parquet(f"{folder}/client_changes.parquet")
    return str(folder), clients, changes


def _upserted(clients, changes):
    """first_id, n_rows, cents, rows_crc, ids_sha256, rewritten and the rows of each file."""
    crc = lambda x: zlib.crc32(str(x).encode())
    m = 1 + len(clients) // 1500
    base = sorted((c for c in clients if crc(c[0]) % 7 > 3), key=lambda c: c[0])
    start = [base[k : k + m] for k in range(0, len(base), m)]
    home = lambda i: max([k for k, f in enumerate(start) if f[0][0] <= i], default=0)
    best = {}
    for c in changes:
        if c[1] is not None and (c[1] not in best or (c[2], c[0]) > (best[c[1]][2], best[c[1]][0])):
            best[c[1]] = c
    now = [{r[0]: r for r in f} for f in start]
    for i, c in best.items():
        k = home(i)
        h = crc(start[k][0][0]) % 10
        if h > 7:
            continue
        if c[3] == "D" or crc(c[0]) % 8 < h:
            now[k].pop(i, None)
        else:
            old = now[k].get(i, (i, *[None] * 9))
            now[k][i] = (*old[:2], c[5], *old[3:6], c[7], old[7], c[6], c[8])
    files = []
    for old, rows in zip(start, now, strict=True):
        rows = [rows[i] for i in sorted(rows)]
        if rows == old:
            files.append((False, rows))
            continue
        n, at = -(-len(rows) // m), 0
        for k in range(n):
            size = len(rows) // n + (k < len(rows) % n)
            files.append((True, rows[at : at + size]))
            at += size
    out = []
    for rewritten, rows in files:
        if rewritten and out and out[-1][0] and len(out[-1][1]) + len(rows) <= m:
            out[-1] = (True, out[-1][1] + rows)
        else:
            out.append((rewritten, rows))
    text = lambda r: "|".join(x or "" for x in (r[2], r[8], r[6]))
    return [(f[0][0], len(f), sum(0 if r[9] is None else math.floor(100 * r[9] + 0.5) for r in f), sum(crc(text(r)) for r in f), sha(",".join(str(r[0]) for r in f)), w, f) for w, f in out]


def test_op12(spark, shop):
    folder, clients, changes = shop
    want = _upserted(clients, changes)
    got = sorted(queries.op12_vector_upsert(spark, folder).collect(), key=lambda r: r["first_id"])
    assert [(r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in got] == [w[:6] for w in want]
    assert {w[5] for w in want} == {True, False} and any(w[1] < 3 and w[5] for w in want)
    assert {r["columns"] for r in got} == {",".join(c.split()[0] for c in CLIENT.split(", "))}
    paths = [r["path"].removeprefix("file:").replace("///", "/") for r in got]
    assert sorted(paths) == sorted(glob.glob(f"{os.path.dirname(paths[0])}/**/*.parquet", recursive=True))
    for path, w in zip(paths, want, strict=True):
        assert [tuple(r.values()) for r in pq.read_table(path).to_pylist()] == w[6]


def test_merge_on_read(spark, shop):
    """The staged table reads as the compacted one, wide columns aren't staged, and untouched files keep their paths."""
    rows = [(k, f"v{k}", k % 5, 1, 2) for k in range(0, 400, 2)]
    schema = T.StructType([T.StructField(n, t) for n, t in (("k", T.LongType()), ("a.b", T.StringType()), ("x", T.IntegerType()), ("__file", T.IntegerType()), ("__all", T.IntegerType()))])
    folder = upsert.new_folder(spark, "t")
    upsert.create(spark.createDataFrame(rows, schema), "k", folder, 16)
    changes = spark.createDataFrame([(4, "v4", 4, "U"), (6, None, 9, "U"), (7, "new", 1, "U"), (8, None, None, "D"), (9, None, None, "D"), (-5, "low", 0, "I"), (1000, "high", 0, "I"), (None, "x", 1, "U")], "k long, `a.b` string, x int, op string")
    staged = upsert.stage(spark, folder, schema, "k", changes, ["a.b", "x"], F.col("op") == "D")
    assert staged.vectors.count() == 1 and staged.deltas.count() == 4  # 4 is as it was, 9 isn't there
    want = {r[0]: r for r in rows} | {6: (6, None, 9, 1, 2), 7: (7, "new", 1, None, None), -5: (-5, "low", 0, None, None), 1000: (1000, "high", 0, None, None)}
    del want[8]
    assert sorted(map(tuple, upsert.merged(staged, spark).collect())) == [want[k] for k in sorted(want)]
    before = {f.path for f in staged.files}
    upsert.compact(staged, spark, 16)
    after = upsert.files(spark, folder, schema, "k")
    assert len(before & {f.path for f in after}) == len(before) - 2
    assert [tuple(r) for r in spark.read.schema(schema).parquet(*[f.path for f in after]).orderBy("k").collect()] == [want[k] for k in sorted(want)]
    assert upsert.compact(upsert.stage(spark, folder, schema, "k", changes.limit(0), ["x"], F.lit(False)), spark, 16) == 0


def test_upsert_into_nothing(spark):
    folder, schema = upsert.new_folder(spark, "t"), T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.IntegerType())])
    upsert.create(spark.createDataFrame([(None, 1)], schema), "k", folder, 4)
    staged = upsert.stage(spark, folder, schema, "k", spark.createDataFrame([(1, 2)], schema), ["x"], F.lit(False))
    assert upsert.compact(staged, spark, 4) == 0 and upsert.merged(staged, spark).count() == 0 and upsert.files(spark, folder, schema, "k") == []


def test_planned():
    assert upsert.pieces(7, 3) == [3, 2, 2] and upsert.pieces(6, 3) == [3, 3] and upsert.pieces(0, 3) == []
    assert upsert.planned({0: 1, 1: 1, 2: 2, 4: 1, 5: 0, 6: 2}, 8, 3) == [2, 2, 3]
    assert upsert.planned({0: 4, 1: 1}, 2, 3) == [2, 3]
