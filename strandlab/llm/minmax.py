"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles of five words (all its words as one shingle if there are fewer). Under
each permutation both the smallest and the largest value are kept, so half the hash evaluations give a signature of
the same length. Bands take values of different permutations, minima and maxima apart, so a band of r values
matches with probability J^r as in plain MinHash. With 80 permutations in 40 bands of 4, a pair at J = 0.75 is
missed by all bands with probability (1 - 0.75^4)^40 < 3e-7.

Documents with equal sets are one class, with its smallest id standing for it; only these go on. In each bucket of
a band every class is compared with the bucket's hub, on full sets. The Jaccard distance is a metric, which settles most
of a bucket at once: if a document is far from the hub (J < 0.4), whatever it is linked with isn't near (J < 0.65). So
the near ones leave, and a far one is the next hub for the rest, for a few rounds. A hub and all that aren't far from it
form a family, and so does what is left of a bucket after the last round: two documents meet in a family only if they
share a bucket. Where a family lies in more than one component, the members outside its largest one are compared with
the whole family, in blocks of bounded size within tasks, so no pair is dropped and no row stands for a pair. Within a
block the rarest quarter of each set is an index: sets with J >= 0.75 share one of these, others are never compared.

Null text and text without words have no shingles, stay alone and are kept. Repeated rows are one class. A null
doc_id never names a component: such a row is kept if no document with an id has the same set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.llm import kernel
from strandlab.llm.components import components
from strandlab.llm.shared import forget, ready, whole, written

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, ROWS = 80, 4
_COLUMNS = 2048
#: Documents with a lower similarity to a hub, in percent, are far from it.
FAR = 40
#: Hubs that each bucket has.
HUBS = 2
#: Shingles of a family compared in one task: of those outside its largest component, and of all members.
BLOCK, CHUNK = 1 << 16, 1 << 18
#: Prefix places matched at once within a task.
_HITS = 1 << 20


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's ascending distinct shingle hashes."""
    data, offsets = kernel.utf8(column)
    for a, b in kernel.blocks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        hashes, _, _, first = kernel.word_hashes(data[offsets[a] : offsets[b]], own, lower=True)
        sums = kernel.prefix_sums(hashes)
        windows = kernel.window_hash(sums, n)
        whole = kernel.span_hash(sums, first[:-1], first[1:])
        for t in range(b - a):
            words = first[t + 1] - first[t]
            yield np.unique(windows[first[t] : first[t + 1] - n + 1]) if words >= n else whole[t : t + 1] if words else whole[:0]


def _family(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(271828)
    return r.integers(0, 2**63, permutations).astype(kernel.U64)[:, None], (r.integers(0, 2**63, permutations).astype(kernel.U64) * kernel.U64(2) + kernel.U64(1))[:, None]


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value under each permutation; one evaluation serves both."""
    flip, odd = _family(permutations)
    low, high = np.full(permutations, np.iinfo(np.uint64).max, kernel.U64), np.zeros(permutations, kernel.U64)
    for first in range(0, len(shingles), _COLUMNS):
        values = (shingles[None, first : first + _COLUMNS] ^ flip) * odd
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return low, high


def bands(low: np.ndarray, high: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of `rows` minima and each band of `rows` maxima; the band's number is part of it."""
    values = np.concatenate([low.reshape(-1, rows), high.reshape(-1, rows)])
    keys = np.arange(len(values), dtype=kernel.U64)
    for r in range(rows):
        keys = kernel.mix(keys * kernel.U64(0x9E3779B97F4A7C15) + values[:, r])
    return keys


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("print1", T.LongType()), T.StructField("print2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _signer(n: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, keys, ends = [], [], [], [], [0]
            for s in _sets(batch.column("text"), n):
                sizes.append(len(s))
                one.append(np.add.reduce(kernel.mix(s)) if len(s) else kernel.U64(0))
                two.append(np.bitwise_xor.reduce(kernel.mix(s * kernel.U64(0xD6E8FEB86659FD93))) if len(s) else kernel.U64(0))
                if len(s):
                    keys.append(bands(*signature(s, permutations), rows))
                ends.append(ends[-1] + (len(keys[-1]) if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, kernel.U64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(np.array(x, kernel.U64).view(np.int64)) for x in (one, two)), lists], _SIGNED.names)
        kernel.release()

    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                sets = list(_sets(part.column("text"), n))
                ends = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=ends[1:])
                flat = np.concatenate(sets) if sets else np.zeros(0, kernel.U64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["doc_id", "shingles"])
        kernel.release()

    return run


def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, far: int = FAR) -> DataFrame:
    """Those of pairs(rep, hub) whose full sets aren't far apart, with their sizes n and m, link and near."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("rep", "hub"))
    both = pairs.join(left, "rep").join(right, "hub").select("rep", "hub", F.size(F.array_intersect("set_rep", "set_hub")).cast("long").alias("common"), (F.size("set_rep") + F.size("set_hub")).cast("long").alias("total"), F.size("set_rep").cast("long").alias("n"), F.size("set_hub").cast("long").alias("m"))
    at_least = lambda p: 100 * F.col("common") >= p * (F.col("total") - F.col("common"))
    return both.filter(at_least(far)).select("rep", "hub", "n", "m", at_least(percent).alias("link"), at_least(far + 100 - percent).alias("near"))


def _prefixes(sets: list[np.ndarray], rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of rank that are each set's rarest, one more than it may lack, and whose they are."""
    tokens, owners, first = [], [], 0
    for k, x in enumerate(sets):
        n = len(x) - -(-percent * len(x) // 100) + 1
        own = rank[first : first + len(x)]
        tokens.append(np.partition(own, n - 1)[:n] if n < len(x) else own)
        owners.append(np.full(len(tokens[-1]), k))
        first += len(x)
    return np.concatenate(tokens), np.concatenate(owners)


def links_between(lesser: list[np.ndarray], groups: np.ndarray, members: list[np.ndarray], others: np.ndarray, percent: int = PERCENT) -> tuple[list[tuple[int, int]], int]:
    """Links (member, lesser) that join different groups, as a forest over the groups, and how many pairs were compared.

    Sets are ascending. Shingles are ranked by how many sets have them; linked sets share one of their rarest.
    """
    if not lesser or not members:
        return [], 0
    every = np.concatenate([*lesser, *members])
    _, which, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    rank = rank[which]
    at = sum(map(len, lesser))
    token, owner = _prefixes(lesser, rank[:at], percent)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    asked, asker = _prefixes(members, rank[at:], percent)
    low, high = np.searchsorted(token, asked), np.searchsorted(token, asked, "right")
    n = high - low
    size, sizes = np.array([len(x) for x in lesser]), np.array([len(x) for x in members])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    links, compared = [], 0
    total = np.cumsum(n)
    cuts = np.searchsorted(total, np.arange(_HITS, (total[-1] if len(total) else 0) + _HITS, _HITS), "right")
    first = 0
    for last in np.unique(np.append(cuts, len(n))):
        m = n[first:last]
        hit = np.repeat(low[first:last] - np.cumsum(m) + m, m) + np.arange(m.sum())
        pairs = np.unique(np.repeat(asker[first:last], m) * len(lesser) + owner[hit])
        k, o = pairs // len(lesser), pairs % len(lesser)
        fit = (groups[o] != others[k]) & (100 * np.minimum(size[o], sizes[k]) >= percent * np.maximum(size[o], sizes[k]))
        for x, y in zip(k[fit].tolist(), o[fit].tolist(), strict=True):
            a, b = find(int(groups[y])), find(int(others[x]))
            if a != b:
                compared += 1
                common = len(np.intersect1d(members[x], lesser[y], assume_unique=True))
                if 100 * common >= percent * (len(members[x]) + len(lesser[y]) - common):
                    root[a] = b
                    links.append((x, y))
        first = last
    return links, compared


def _across(percent: int):
    """Links between a block of a family's lesser components and a chunk of the family."""

    def run(table: pa.Table) -> pa.Table:
        lesser = np.asarray(table.column("lesser"), bool)
        ids, groups = np.asarray(table.column("rep")), np.asarray(table.column("component"))
        sets = [np.asarray(x.values) for x in table.column("shingles")]
        ours, theirs = np.flatnonzero(lesser), np.flatnonzero(~lesser)
        links, _ = links_between([sets[i] for i in ours], groups[ours], [sets[i] for i in theirs], groups[theirs], percent)
        return pa.table({"u": pa.array([int(ids[theirs[x]]) for x, _ in links], pa.int64()), "v": pa.array([int(ids[ours[y]]) for _, y in links], pa.int64())})

    return run


def across(families: DataFrame, groups: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links(u, v) within families(family, rep, n) between different groups(node, component), as a table; n is the size of
    rep's set.

    Members with their components are written before they are counted and dealt out: else their joins would stand in the
    plan once for each use, and the driver would hold them all at a time.
    """
    members = families.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = written(members, "members")
    counts = members.groupBy("family", "component").agg(F.sum("n").alias("n"))
    per = counts.groupBy("family").agg(F.max(F.struct("n", -F.col("component"))).alias("m"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    per = per.select("family", (-F.col("m.col2")).alias("main"), F.ceil((F.col("all") - F.col("m.n")) / F.lit(BLOCK)).cast("int").alias("blocks"), F.ceil(F.col("all") / F.lit(CHUNK)).cast("int").alias("chunks"))
    rows = members.drop("n").join(per, "family").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    every = lambda n, place: F.transform(F.sequence(F.lit(0), F.col(n) - 1), place)
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    of = lambda lesser, block, chunk: F.struct(F.lit(lesser).alias("lesser"), block.alias("block"), chunk.alias("chunk"))
    member = every("blocks", lambda block: of(False, block, mine("chunks")))
    lesser = every("chunks", lambda chunk: of(True, mine("blocks"), chunk))
    places = F.flatten(F.array_compact(F.array(member, F.when(F.col("component") != F.col("main"), lesser))))
    dealt = rows.select("family", "rep", "component", "shingles", F.inline(places))
    out = written(dealt.groupBy("family", "block", "chunk").applyInArrow(_across(percent), "u long, v long"), "across")
    forget(members)
    return out


def _left_over(active: DataFrame) -> DataFrame:
    """Families(family, rep, n) of what is left of buckets(key, rep, n); buckets that hold the same are one."""
    h = F.xxhash64("rep")
    same = active.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s"))
    one = same.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    return active.join(one, "key").select(F.xxhash64(F.lit("bucket"), "key").alias("family"), "rep", "n")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(texts.mapInArrow(_signer(shingle, permutations, rows), _SIGNED), "signed")
    prints = ["print1", "print2", "n_shingles"]
    classes = signed.filter("n_shingles > 0").groupBy(*prints).agg(F.min("doc_id").alias("rep"))
    classes = written(classes.filter("rep is not null"), "classes")
    of_rep = signed.select("doc_id", *prints, "bands").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *prints], "left_semi")
    dealt = of_rep.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("last")).filter("hub.rep < last").select("key", "hub")
    active = written(dealt.join(shared, "key"), "buckets")
    in_bucket = active.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(texts.join(in_bucket, "doc_id", "left_semi").mapInArrow(_setter(shingle), "doc_id long, shingles array<long>"), "sets")
    tables = []
    for _ in range(HUBS):
        others = active.filter("rep <> hub.rep")
        pairs = others.filter(100 * F.least("n", "hub.n") >= FAR * F.greatest("n", "hub.n")).select("rep", F.col("hub.rep").alias("hub")).distinct()
        near = written(compared(pairs, sets, percent), "near")
        tables.append(near)
        others = others.select("key", "rep", "n", F.col("hub.rep").alias("hub"))
        left = others.join(near.select("rep", "hub", "near"), ["rep", "hub"], "left").filter("near is null or not near").withColumn("far", F.col("near").isNull())
        following = left.groupBy("key").agg(F.min(F.when(F.col("far"), F.struct("rep", "n"))).alias("hub"), F.count("*").alias("k")).filter("hub is not null and k > 1").select("key", "hub")
        earlier, active = active, written(left.select("key", "rep", "n").join(following, "key"), "buckets")
        forget(earlier)
    seen = reduce(DataFrame.unionByName, tables)
    groups = written(components(seen.filter("link").select(F.col("rep").alias("u"), F.col("hub").alias("v"))), "groups")
    # A family is open if some member isn't in its hub's component: of two members apart, one is such.
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    apart = seen.join(of("rep"), "rep", "left").join(of("hub"), "hub", "left").filter(F.coalesce("of_rep", "rep") != F.coalesce("of_hub", "hub"))
    hubs = written(apart.select("hub", "m").distinct(), "hubs")
    family = F.xxhash64(F.lit("hub"), "hub").alias("family")
    families = seen.join(hubs, "hub", "left_semi").select(family, "rep", "n").unionByName(hubs.select(family, F.col("hub").alias("rep"), F.col("m").alias("n")))
    more = across(families.unionByName(_left_over(active)).distinct(), groups, sets, percent)
    if not more.isEmpty():
        # Only components that a new link joins are looked at again.
        name = lambda c: F.coalesce(F.col(f"of_{c}"), F.col(c)).alias(c)
        joined = components(more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(name("u"), name("v")))
        joined = written(joined.withColumnRenamed("component", "other"), "joined")
        all_groups = groups.unionByName(joined.select("node", F.col("node").alias("component"))).distinct()
        earlier, groups = groups, written(all_groups.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("other", "component").alias("component")), "groups")
        forget(earlier, joined)
    forget(active, sets, more, hubs, *tables)
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*prints, F.coalesce("component", "rep").alias("component_id"))
    signed = signed.drop("bands")
    out = signed.filter("n_shingles > 0").join(named, prints, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without the near copies: one row of each component stays, one with its smallest id (an id goes before none).

    Every row is judged by a key of its own, so rows that share an id, or have none, are told apart. Rows without
    shingles stay alone as documents: one row of each id stays, and all of those that have no id either.
    """
    keyed = written(docs.select(whole(docs.columns).alias("row"), F.monotonically_increasing_id().alias("__key")), "keyed")
    verdict = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), F.col("row.text").alias("text")), **how)
    verdict = verdict.select(F.col("doc_id").alias("__key"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("__component"))
    ids = keyed.select("__key", F.col("row.doc_id").alias("__id"), F.xxhash64("row.text").alias("__print"))
    alone = F.col("__component").isNull()
    group = [F.col("__component"), F.when(alone, F.col("__id")).alias("__alone"), F.when(alone & F.col("__id").isNull(), F.col("__key")).alias("__own")]
    best = verdict.join(ids, "__key").groupBy(*group).agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__print", "__key")).alias("best"))
    kept = keyed.join(best.select(F.col("best.__key").alias("__key")), "__key", "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
