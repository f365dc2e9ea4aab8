"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source gets a target: a share of all tokens by weight, at most `most_repeats` times the source's own size,
what is cut off being shared again by weight. Its documents come in a shuffled order that is fixed by a hash,
as often as the target asks for. A copy's virtual finish time is the source's tokens up to and including it,
divided by the target. The copies of all sources, ordered by that time, are taken until the total budget is met.

The running sums need no group in one task: documents are dealt to buckets by the hash's leading digits, sums of
buckets are added up first, and rows only within a bucket. The cut through all sources' virtual times is found
the same way, over a bounded number of time slots; the slot that it crosses is range-sorted. Sources are ordered by ranges
too.

Null text has size 0. A null source is a source of its own and comes last. Documents without words are never
taken. Repeated rows are documents of their own; rows that share a doc_id, and so a hash, are ordered by size and a hash
of the text, so only equal rows may change places from run to run. Without a doc_id the text's hash stands for it.
`mixed` returns all columns of its input and no other; `taken` has its own six columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.ordering import numbered, summed_before
from strandlab.llm.shared import forget, n_words, whole, written

#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Slots of virtual time for the global cut.
SLOTS = 1 << 16
#: Documents in one bucket of the shuffled order.
BUCKET_ROWS = 1 << 18


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target and budget for each source of sizes(source, size).

    In order of limit / weight the sources held at their limit come first, so one pass over the sources (one row
    each) finds the level that the others share: that of the first source which isn't held. Both orders are dealt out by
    ranges, as a corpus by domain has as many sources as domains; two rows of totals go through the driver.
    """
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    absent = F.col("source").isNull()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = numbered(per, absent, "source").withColumns({"weight": weight.cast("double"), "limit": (most_repeats * F.col("source_size")).cast("double")})
    totals = per.agg(F.sum("source_size").alias("budget"), F.sum("weight").alias("weight")).first()
    ratio = F.col("limit") / F.col("weight")
    per = summed_before(per.drop("place"), ["limit", "weight"], ratio, absent, "source")
    per = per.withColumns({"budget": F.lit(totals["budget"]).cast("long"), "left": F.lit(totals["budget"]) - F.col("before_limit"), "share": F.lit(totals["weight"]) - F.col("before_weight")})
    per = per.withColumn("held", F.col("limit") * F.col("share") <= F.col("left") * F.col("weight"))
    free = per.filter("not held").agg(F.min(F.struct(ratio.alias("ratio"), absent.alias("absent"), "source", "left", "share")).alias("first")).first()["first"]
    level = (F.lit(free["left"]), F.lit(free["share"])) if free else (F.lit(0.0), F.lit(1.0))  # without one all are held
    target = F.when(F.col("held"), F.col("limit")).otherwise(F.col("weight") * level[0] / level[1])
    return per.select("source", "source_size", target.alias("target"), "budget")


def copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, digits: int = 2) -> DataFrame:
    """sizes(uid, doc_id, source, size, print) with source_size, target and how many copies the mix takes.

    sizes must be stable when read again (a written table); print is a hash of the text. `digits`: hexadecimal digits
    of the hash that name a bucket of the shuffled order; 16^digits buckets for each source.
    """
    per = source_targets(sizes, weights, most_repeats)
    rows = sizes.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("print").cast("string"))))
    rows = rows.withColumn("bucket", F.substring("hash", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0))).drop("in_bucket")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = sums.join(per, same(sums, per)).drop(per["source"])
    rows = rows.join(sums, same(rows, sums) & (rows["bucket"] == sums["bucket"])).drop(sums["source"], sums["bucket"])
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size", "print", "uid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("position", F.col("before") + F.sum("size").over(inside))
    rows = written(rows.select("uid", "doc_id", "size", "print", "source_size", "target", "budget", "hash", "position"), "mix-order")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("round")
    dealt = rows.filter("size > 0").select("*", rounds)
    dealt = dealt.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("position")).cast("double") / F.col("target"))
    dealt = dealt.withColumn("slot", F.least(F.floor(F.col("finish") * SLOTS), F.lit(4 * SLOTS)))
    slots = dealt.groupBy("slot").agg(F.sum("size").alias("in_slot"), F.max("budget").alias("budget"))
    up_to = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("until", F.sum("in_slot").over(up_to))
    cut = slots.filter("until > budget").agg(F.min("slot"), F.min_by(F.col("until") - F.col("in_slot"), "slot")).first()
    if cut[0] is None:
        kept = dealt.select("uid")
    else:
        last = summed_before(dealt.filter(F.col("slot") == cut[0]), ["size"], "finish", "hash", "doc_id", "round", "size", "print", "uid")
        last = last.filter(cut[1] + F.col("before_size") + F.col("size") <= F.col("budget"))
        kept = dealt.filter(F.col("slot") < cut[0]).select("uid").unionByName(last.select("uid"))
    kept = kept.groupBy("uid").agg(F.count("*").alias("copies"))
    return rows.join(kept, "uid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def _digits(rows: int) -> int:
    digits = 1
    while 16**digits * BUCKET_ROWS < rows and digits < 8:
        digits += 1
    return digits


def _sizes(rows: DataFrame, uid: str) -> DataFrame:
    return rows.select(F.col(uid).alias("uid"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("print"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size times copies) for each row of docs(doc_id, source, text)."""
    sizes = written(_sizes(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("__uid")), "__uid"), "mix")
    out = copies(sizes, weights, most_repeats, _digits(sizes.count()))
    forget(sizes)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with docs' columns."""
    rows = written(docs.select(whole(docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "mixed")
    sizes = written(_sizes(rows.select("uid", "row.doc_id", "row.source", "row.text"), "uid"), "mix")
    chosen = copies(sizes, weights, most_repeats, _digits(sizes.count())).filter("copies > 0").select("uid", "copies")
    forget(sizes)
    out = rows.join(chosen, "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


TAKEN_SQL = """
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as hash from documents),
s as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][1 + (row_number() over (order by source is null, source) - 1) % 3]::double as weight
  from d group by source),
r as (
  select *, 3.0::double * source_size as lim, row_number() over (order by 3.0::double * source_size / weight, source is null, source) as k from s),
q as (
  select *, (sum(source_size) over ())::bigint as budget,
    (sum(source_size) over ())::double - coalesce(sum(lim) over (order by k rows between unbounded preceding and 1 preceding), 0.0) as rest,
    sum(weight) over (order by k rows between current row and unbounded following) as share from r),
h as (select *, lim * share <= rest * weight as held from q),
t as (
  select source, source_size, budget, case when held then lim else
    weight * (select arg_min(rest, k) from h where not held) / (select arg_min(share, k) from h where not held) end as target from h),
p as (
  select d.*, t.source_size, t.budget, t.target, sum(size) over (partition by d.source order by hash, doc_id, size rows unbounded preceding) as position
  from d join t on d.source is not distinct from t.source),
c as (
  select p.*, e.round, (e.round * source_size + position)::double / target as finish
  from p, (select unnest([0, 1, 2]) as round) e where size > 0),
o as (select *, sum(size) over (order by finish, hash, doc_id, round rows unbounded preceding) as running from c),
n as (select doc_id, count(*) as copies from o where running <= budget group by doc_id)
select p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(n.copies, 0))::bigint as taken
from p left join n on p.doc_id = n.doc_id
"""
