"""Structure tasks: balanced brackets, their corruption, and agreement over a distance, generated by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions.scalars import BRACKETS, pick, unit_hash, well_formed

#: The vocabulary of the agreement task.
SG_NOUNS = ("scientist", "engineer", "author", "teacher", "doctor", "artist", "pilot", "manager", "student", "farmer", "lawyer", "nurse", "chef", "worker", "player")
PL_NOUNS = ("scientists", "engineers", "authors", "teachers", "doctors", "artists", "pilots", "managers", "students", "farmers", "lawyers", "nurses", "chefs", "workers", "players")
SG_VERBS = ("runs", "writes", "speaks", "works", "reads", "walks", "sings", "wins", "leads")
PL_VERBS = ("run", "write", "speak", "work", "read", "walk", "sing", "win", "lead")
PREPS = ("near", "beside", "behind", "beyond", "under", "above", "against")
ADJS = ("tall", "quiet", "famous", "clever", "young", "serious", "curious", "brave")

ATTEMPTS = 10


def _u(seed: int, key: Column, what: str, *more: Column) -> Column:
    return unit_hash(F.lit(str(seed)), key.cast("string"), F.lit(what), *(m.cast("string") for m in more))


def bracket_word(key: Column, length: int, n_types: int, seed: int) -> Column:
    """A balanced word of exactly `length` tokens (even): opens while nothing is open, or by a coin if there is room to close all."""
    opening, closing = [b[0] for b in BRACKETS[:n_types]], [b[1] for b in BRACKETS[:n_types]]
    partner = F.create_map(*(F.lit(x) for pair in zip(opening, closing, strict=True) for x in pair))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("stack"))
    u = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    def step(state: Column, draw: Column) -> Column:
        out, stack = state["out"], state["stack"]
        room = length - F.length(out) > F.length(stack)
        close = (stack != "") & (~room | (draw["coin"] < 0.5))
        new = pick(opening, draw["kind"])
        token = F.when(close, partner[F.substring(stack, 1, 1)]).otherwise(new)
        return F.struct(F.concat(out, token).alias("out"), F.when(close, F.substring(stack, 2, length)).otherwise(F.concat(new, stack)).alias("stack"))

    # One md5 a step: its first eight digits are the coin, the next the type. The fold goes over the draws themselves: an
    # expression named within a fold is computed anew at each step.
    hashes = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit("step"), i.cast("string"))))
    draws = F.transform(hashes, lambda h: F.struct(u(h, 1).alias("coin"), u(h, 9).alias("kind")))
    return F.split(F.aggregate(draws, start, step)["out"], "")


def corrupted(word: Column, key: Column, n_types: int, seed: int) -> Column:
    """The first of ten single substitutions that isn't balanced any more; if none is, two places swapped (which may stay balanced)."""
    tokens = [t for b in BRACKETS[:n_types] for t in b]
    n = F.size(word)
    place = lambda what, *more: F.floor(_u(seed, key, what, *more) * n).cast("int")
    put = lambda w, at, t: F.transform(w, lambda c, i: F.when(i == at, t).otherwise(c))
    tries = F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda a: put(word, place("place", a), pick(tokens, _u(seed, key, "token", a))))
    broken = F.get(F.filter(tries, lambda w: ~well_formed(w, n_types)), F.lit(0))
    i = place("swap")
    j = (i + 1 + F.floor(_u(seed, key, "other") * (n - 1)).cast("int")) % n
    return F.coalesce(broken, put(put(word, i, F.get(word, j)), j, F.get(word, i)))


def spread(ids: DataFrame, *keys: str) -> DataFrame:
    """ids dealt over all cores, by keys if given: they are a few bytes each, and what is made from them takes far longer than
    to move them. What is made by keys can be joined and grouped by them where it is."""
    return ids.repartition(max(ids.sparkSession.sparkContext.defaultParallelism, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def bracket_task(ids: DataFrame, key: str = "id", length: int = 40, n_types: int = 3, seed: int = 0) -> DataFrame:
    """sentence and label, half of them corrupted (label 0)."""
    name = F.col(key)
    rows = spread(ids).withColumn("word", bracket_word(name, length, n_types, seed)).withColumn("label", (_u(seed, name, "label") < 0.5).cast("int"))
    word = F.when(F.col("label") == 1, F.col("word")).otherwise(corrupted(F.col("word"), name, n_types, seed))
    return rows.select(key, F.array_join(word, " ").alias("sentence"), "label")


def agreement_task(ids: DataFrame, key: str = "id", n_distract: int = 12, seed: int = 0) -> DataFrame:
    """Sentences whose head noun and verb agree (label 1) or not, over a distractor of nouns of the other number.

    The distractor grows by four words until it has n_distract, so it has 4 * ceil(n_distract / 4).
    """
    name = F.col(key)
    singular, label = _u(seed, name, "number") < 0.5, (_u(seed, name, "label") < 0.5).cast("int")
    rows = ids.select(key, singular.alias("sg"), label.alias("label"))
    either = lambda a, b, u, flag: F.when(flag, pick(a, u)).otherwise(pick(b, u))
    sg = F.col("sg")
    head = either(SG_NOUNS, PL_NOUNS, _u(seed, name, "head"), sg)
    verb = either(SG_VERBS, PL_VERBS, _u(seed, name, "verb"), sg == (F.col("label") == 1))
    chunk = lambda k: F.concat_ws(" ", pick(PREPS, _u(seed, name, "prep", k)), F.lit("the"), pick(ADJS, _u(seed, name, "adj", k)), either(PL_NOUNS, SG_NOUNS, _u(seed, name, "noun", k), sg))
    chunks = F.transform(F.sequence(F.lit(1), F.lit(-(-n_distract // 4))), chunk) if n_distract > 0 else F.array().cast("array<string>")
    sentence = F.concat_ws(" ", F.lit("The"), head, F.array_join(chunks, " "), verb, F.lit("."))
    return rows.select(key, sentence.alias("sentence"), "label")
