"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Logs often hold a conversation once after every turn. Each turn has a hash with its position; the running exclusive or
of these is the hash of the prefix that ends there (two hashes of 64 bits, and the length). A conversation whose whole
hash is the hash of a proper prefix of another one is a snapshot of it: an anti-join drops it. Of equal conversations
the smallest conv_id stays. What is left is rendered.

Turns are ordered by turn (null first), role and text; a turn row given twice counts once. Null role and text are like
empty ones. Rows without a conv_id belong to no conversation. Extra columns aren't read, whatever their names. Running hashes are windows over narrow rows, sorted on
disk where needed; only rendering brings a conversation's text together, since it makes one string of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is written, with {role} and {text}.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def rendered(role: Column, text: Column, template: str = TEMPLATE) -> Column:
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    return F.concat(F.lit(head), role, F.lit(middle), text, F.lit(tail))


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return conversations.filter("conv_id is not null").select("conv_id", "turn", text("role"), text("text"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no snapshot of another."""
    ids = [F.xxhash64(F.lit(s), "role", "text") for s in ("a", "b")]
    rows = _turns(conversations).select("conv_id", "turn", "role", *(x.alias(n) for x, n in zip(ids, ("h1", "h2"), strict=True)), F.md5("text").alias("print")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "print", "h1", "h2")
    rows = rows.select("conv_id", F.row_number().over(order).alias("n"), F.lead("conv_id").over(order).isNull().alias("last"), "h1", "h2", "turn", "role", "print")
    running = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "print", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("conv_id", "n", "last", *(F.bit_xor(F.xxhash64("n", h)).over(running).alias(p) for h, p in (("h1", "p1"), ("h2", "p2"))))
    whole = placed.filter("last").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = placed.filter("not last").select("n", "p1", "p2").distinct()
    return whole.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns and rendered for each maximal conversation."""
    rows = _turns(conversations).join(maximal(conversations), "conv_id")
    turn = F.struct("turn", "role", F.md5("text").alias("print"), "text")
    own = F.sort_array(F.collect_set(turn))
    body = F.array_join(F.transform(own, lambda t: rendered(t["role"], t["text"], template)), "")
    return rows.groupBy("conv_id", "n_turns").agg(body.alias("rendered"))


FORMATTED_SQL = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
r as (select *, row_number() over o as n, lead(conv_id) over o is null as last,
    string_agg(md5(role || chr(10) || text), '') over (partition by conv_id order by turn nulls first, role, md5(text) rows unbounded preceding) as prefix
  from t window o as (partition by conv_id order by turn nulls first, role, md5(text))),
w as (select n, md5(prefix) as whole, min(conv_id) as conv_id from r where last group by n, md5(prefix)),
m as (select conv_id, n from w where not exists (select 1 from r where not r.last and r.n = w.n and md5(r.prefix) = w.whole))
select m.conv_id, m.n::bigint as n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn nulls first, role, md5(text)) as rendered
from m join t on m.conv_id = t.conv_id group by m.conv_id, m.n
"""
