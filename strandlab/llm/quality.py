"""Quality rules as a learned decision list, in DataFrame operations only.

Base statistics of every whole text come from built-in functions. A sequential covering learner, on the driver, reads
the statistics of a bounded sample of labelled rows (numbers only): it grows a conjunction of thresholds for poor texts
on two thirds of the rows by information gain, prunes it on the rest, keeps it if it is precise enough there, removes
what it covers and goes on. The list comes out as one ordered conditional expression that Spark applies.

Null text is empty. Rows that fail the base rules aren't learned from. Without labels of both kinds the list is empty,
and what passes the base rules is kept. Labels that are null or have no document are ignored; a document labelled more
than once counts with its lowest label. Repeated rows are judged alike; extra columns don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import WORD, whole

#: Labelled rows read for learning, by hash of doc_id; rules, conditions in a rule, and thresholds tried for a feature.
MOST_ROWS, MOST_RULES, MOST_CONDITIONS, CUTS = 20_000, 12, 3, 40
#: Share of poor texts among those a rule covers, on the rows it was pruned on, and rows it must cover there.
PRECISION, LEAST_COVERED = 0.95, 5

#: What statistics() counts; columns of these names, and of base_failed and kept, are replaced.
_COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_exclaim", "n_digits", "n_distinct")
STATISTICS = (*_COUNTED, "base_failed", "kept")
FEATURES = {
    "symbol_share": "n_symbols / n_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_word_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "word_length": "word_chars / n_words",
    "upper_share": "n_upper / n_chars",
    "exclaim_share": "n_exclaim / n_words",
    "digit_share": "n_digits / n_chars",
    "line_words": "n_words / n_lines",
}


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that come twice or more: windows' hashes are sorted with their places, equal neighbours
    give the places, and each place adds the words that the one before it didn't cover."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(
            F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda x: x.isNotNull()
        )
        places = F.sort_array(_let(pairs, again))
        start = F.struct(F.lit(0).alias("c"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["c"] + F.least(F.lit(3), p - a["last"])).alias("c"), p.alias("last")))["c"]

    each = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 3, F.lit(0)).otherwise(each)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """docs without text, with the base statistics, base_failed and the counts that the features need."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    squeezed = F.translate(raw, " \t\n\x0b\f\r", "")
    without = lambda s: (F.length(raw) - F.length(F.translate(raw, s, ""))).cast("long")
    lines = F.filter(F.split(raw, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    of_words = _let(F.regexp_extract_all(raw, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), _repeated(w).alias("r")))
    keep = [c for c in docs.columns if c not in ("text", *STATISTICS)]
    out = docs.select(whole(keep).alias("row"), of_words.alias("__w"), of_lines.alias("__l"), F.length(squeezed).cast("long").alias("word_chars"), F.length(raw).cast("long").alias("n_chars"), without("#*$%&|<>").alias("n_symbols"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), without("!").alias("n_exclaim"), without("0123456789").alias("n_digits"))
    long = {"n_words": "__w.n", "n_distinct": "__w.d", "n_repeat_words": "__w.r", "n_lines": "__l.n"}
    out = out.withColumns({k: F.col(v).cast("long") for k, v in long.items()} | {"n_dup_lines": (F.col("__l.n") - F.col("__l.d")).cast("long")})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), *_COUNTED, failed.alias("base_failed"))


def features() -> dict[str, Column]:
    out = {}
    for name, ratio in FEATURES.items():
        over, under = ratio.split(" / ")
        out[name] = F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")
    return out


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.value if self.at_least else row[self.feature] <= self.value

    def expression(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= self.value if self.at_least else columns[self.feature] <= self.value


Rule = tuple[Condition, ...]


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    if not after[0]:
        return -1.0
    return after[0] * (math.log2(after[0] / sum(after)) - math.log2(before[0] / sum(before)))


def _best(rows: list[tuple[dict[str, float], bool]]) -> tuple[float, Condition | None]:
    """The condition with the largest gain; thresholds lie halfway between neighbouring values at evenly spread ranks."""
    poor = sum(y for _, y in rows)
    before, best = (poor, len(rows) - poor), (0.0, None)
    for name in FEATURES:
        order = sorted((x[name], y) for x, y in rows)
        below, at = [0, 0], 0
        step, nearest = max(1, len(order) // CUTS), 0
        for k in range(1, len(order)):
            below[not order[k - 1][1]] += 1
            if order[k][0] == order[k - 1][0] or k < nearest:
                continue
            nearest, at = k + step, (order[k][0] + order[k - 1][0]) / 2
            for at_least, after in ((False, tuple(below)), (True, (before[0] - below[0], before[1] - below[1]))):
                gain = _gain(before, after)
                if gain > best[0] + 1e-9:
                    best = (gain, Condition(name, at_least, at))
    return best


def learn(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """Rules for poor rows (true), in order."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < MOST_RULES:
        grow, prune = [r for k, r in enumerate(left) if k % 3], left[::3]
        own, rule = grow, []
        while len(rule) < MOST_CONDITIONS and any(y for _, y in own) and not all(y for _, y in own):
            gain, condition = _best(own)
            if condition is None:
                break
            rule.append(condition)
            own = [r for r in own if condition.holds(r[0])]
        scores = []
        for n in range(1, len(rule) + 1):
            hit = [y for x, y in prune if all(c.holds(x) for c in rule[:n])]
            scores.append((sum(hit) / len(hit) if hit else 0.0, len(hit), n))
        fit = [(round(p, 2), m, -n) for p, m, n in scores if p >= PRECISION and m >= LEAST_COVERED]
        if not fit:
            break
        rule = rule[: -max(fit)[2]]
        rules.append(tuple(rule))
        left = [r for r in left if not all(c.holds(r[0]) for c in rule)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> list[Rule]:
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # of a fixed size: it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    columns = features()
    numbers = statistics(sample).filter("not base_failed").select("doc_id", "y", *(c.alias(n) for n, c in columns.items()))
    got = numbers.orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(most_rows).collect()
    return learn([({n: r[n] for n in columns}, r["y"] == 0) for r in got])


def verdict(rules: list[Rule]) -> Column:
    """Whether a row with the statistics is kept: the first rule that holds decides, and rows of no rule stay."""
    columns, out = features(), F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.expression(columns)
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs without text, with the base statistics, base_failed and kept."""
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))
