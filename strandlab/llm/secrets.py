"""Secret scans by a trigram inverted index, in DataFrame operations only.

A rule is a regular expression. What every match must hold is derived from it as a Boolean query over trigrams: an "or" of
"and"s of three-letter strings (Cox, "Regular Expression Matching with a Trigram Index"). The index has a posting (gram,
text) for each gram of the rules that a text has; postings are intersected for each "and", and only the texts left are
verified by the expression. A rule without mandatory trigrams is scanned over all texts. Trigrams are in lower case, so rules
may ignore case.

Texts are known by a digest of 128 bits, so equal texts are indexed and verified as one and no row needs an id. Long texts
are whole; the index has at most as many postings for a text as the rules have grams. The rules and their queries are
constants of the plan and the only thing that is broadcast.

Null text is empty and has no secrets; rows of any doc_id, repeated ones too, come out as they came in, with all columns
of the input and `found`. A column named found is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import quoted, written


@dataclass(frozen=True)
class Rule:
    """kind, its expression (common to Java, Python and RE2, without look-around), and the least length of the group (0: of the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's kinds, in its order.
BASE = ("assign", "access", "hex")
#: Formats in which well-known services print their keys, after the contract's three. Runs of characters of one class are
#: greedy, so a least length within the expression means the same as one after matching.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("pay", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Strings that an expression may stand for are followed one by one up to so many.
MOST_STRINGS = 32

Query = frozenset[frozenset[str]]  # an "or" of "and"s; one empty "and": anything
ANY: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x in a for y in b)
    return _either(out, frozenset()) if len(out) <= MOST_STRINGS else min(a, b, key=len)


def _grams(strings: set[str]) -> Query:
    """What a text must have if it has one of the strings."""
    return _either(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings), frozenset()) if strings else ANY


def _chars(items) -> set[str] | None:
    """The characters of a class in lower case; none if they are too many."""
    out: set[str] = set()
    for op, value in items:
        if op is _c.LITERAL:
            out.add(chr(value).lower())
        elif op is _c.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS else None


def _walk(nodes) -> tuple[list[set[str] | None], Query]:
    """A sequence as parts (the strings that a part may be, None for unknown ones) and the query of what lies within parts."""
    parts: list[set[str] | None] = []
    need = ANY
    for op, value in nodes:
        if op is _c.LITERAL:
            parts.append({chr(value).lower()})
        elif op is _c.IN:
            parts.append(_chars(value))
        elif op is _c.SUBPATTERN:
            inner, query = _walk(value[3])
            parts += inner
            need = _both(need, query)
        elif op is _c.BRANCH:
            strings: set[str] | None = set()
            query: Query = frozenset()
            for branch in value[1]:
                inner, within = _walk(branch)
                whole = _joined(inner)
                strings = None if strings is None or whole is None else strings | whole
                query = _either(query, _both(within, _spelled(inner)))
            parts.append(strings if strings is not None and len(strings) <= MOST_STRINGS else None)
            need = _both(need, query)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = value
            within, query = _walk(inner)
            whole = _joined(within)
            if (low, high) == (0, 1) and whole is not None:
                parts.append(whole | {""})
            else:
                parts += within * min(low, 4) if low else []
                if low:
                    need = _both(need, query)
                if (low, high) != (high, low) or low > 4:
                    parts.append(None)
        else:
            parts.append(None)
    return parts, need


def _joined(parts: list[set[str] | None]) -> set[str] | None:
    """All strings that parts in a row may be."""
    out = {""}
    for p in parts:
        if p is None or len(out) * len(p) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in p}
    return out


def _spelled(parts: list[set[str] | None]) -> Query:
    """What runs of known parts need. A run that has too many strings is cut, and goes on with its last part."""
    need, run = ANY, []
    for p in [*parts, None]:
        if p is not None and _joined([*run, p]) is not None:
            run.append(p)
            continue
        if run:
            need = _both(need, _grams(_joined(run) or set()))
        run = [x for x in [*run[-2:], p] if x is not None] if p is not None else []
        while run and _joined(run) is None:
            run.pop(0)
    return need


def trigrams(pattern: str) -> Query:
    """The Boolean query of an expression: a text without any of its "and"s has no match. ANY where none is mandatory."""
    parts, need = _walk(_parser.parse(pattern))
    out = _both(need, _spelled(parts))
    return ANY if frozenset() in out else out


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def postings(texts: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: gram and key of each text that has it, as a written table whose files are sorted by gram."""
    low = texts.select(_key(F.col(text)).alias("key"), F.lower(text).alias("low"))
    there = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    return written(low.select("key", F.explode(there).alias("gram")).distinct().sortWithinPartitions("gram"), "postings")


def candidates(index: DataFrame, rules: dict[int, Query]) -> DataFrame:
    """key and the numbers of the rules whose query a text meets: the postings of each "and" are intersected, by counting."""
    spark = index.sparkSession
    terms = [(rule, k, gram, len(grams)) for rule, query in rules.items() for k, grams in enumerate(sorted(map(sorted, query))) for gram in grams]
    wanted = spark.createDataFrame(terms, "rule int, term int, gram string, size long")  # as many rows as the rules have grams
    met = index.join(F.broadcast(wanted), "gram").groupBy("key", "rule", "term").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return met.filter("n = size").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Matches, leftmost first and without overlaps, as (start, number, end, kind) in characters.

    The pieces between the matches and the matches themselves, put end to end, are the text: their lengths are the places.
    """
    pattern, length = F.lit(rule.pattern), lambda x: F.length(x)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    own = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    pieces = F.split(text, rule.pattern, -1)
    each = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("p"), matches.alias("m"), own.alias("g"))
    span = "struct<start: int, number: int, end: int, kind: string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        low = state["at"] + length(x["p"])
        high = low + length(x["m"])
        found = F.struct(low.alias("start"), F.lit(number).alias("number"), high.alias("end"), F.lit(rule.kind).alias("kind")).cast(span)
        return F.struct(high.alias("at"), F.when(length(x["g"]) >= rule.least, F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    return F.when(F.rlike(text, pattern), F.aggregate(each, start, step, lambda s: s["out"])).otherwise(F.array().cast(f"array<{span}>"))


def joined(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with found: the spans of all rules, by start and then in the order of the rules."""
    queries = {k: trigrams(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    whole = F.struct(*(F.col(quoted(c)) for c in docs.columns))
    rows = docs.select(whole.alias("row"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    if indexed:
        index = postings(rows, sorted({g for q in indexed.values() for grams in q for g in grams}))
        rows = rows.withColumn("key", _key(F.col("text"))).join(candidates(index, indexed), "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    empty = F.array().cast("array<struct<start: int, number: int, end: int, kind: string>>")
    each = [spans(F.col("text"), r, k) if k not in indexed else F.when(F.array_contains("rules", k), spans(F.col("text"), r, k)).otherwise(empty) for k, r in enumerate(rules)]
    out = rows.select("row", F.array_sort(F.concat(*each)).alias("found"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "found"), "found")


def _sql(rules: tuple[Rule, ...]) -> str:
    """The same by expressions alone, in DuckDB."""
    parts = []
    for k, r in enumerate(rules):
        # In RE2 letters without case also have other code points, so the class is spelled out.
        p = re.sub(r"\(\?i:\((.*?)\)\)", lambda m: "(" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", r.pattern).replace("'", "''")
        parts.append(f"""m{k} as (select row, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{p}', {r.group}) as g, string_split_regex(text, '{p}') as p from d),
s{k} as (select row, unnest(range(1, len(m) + 1)) as i, m, g, p from m{k}),
f{k} as (select row, (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::bigint as start, length(m[i]) as n, {k} as k, '{r.kind}' as kind from s{k} where length(g[i]) >= {r.least})""")
    union = " union all ".join(f"select * from f{k}" for k in range(len(rules)))
    count = ", ".join(f"count(*) filter (where kind = '{kind}') as n_{kind}" for kind in BASE)
    one = "kind || ':' || start || ':' || (start + n)"
    return f"""with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents), {", ".join(parts)}, u as ({union})
select any_value(doc_id) as doc_id, {count}, sha256(coalesce(string_agg({one}, ',' order by start, k) filter (where k < {len(BASE)}), '')) as base_sha256, coalesce(string_agg({one}, ',' order by start, k), '') as spans
from d left join u using (row) group by row"""


SQL = _sql(RULES)
