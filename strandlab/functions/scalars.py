"""Scalar functions over text, sequences and pairs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bracket types of the structure tasks, in order.
BRACKETS = ("()", "[]", "{}", "<>")


def letters(seq: Column) -> Column:
    """Characters; none for an empty text."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def protein_line(seq: Column) -> Column:
    return F.concat(F.lit("<protein> "), F.array_join(letters(seq), " "), F.lit(" </protein>"))


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]+", "_")


def path_tag(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def tokenizer(name: str = "words") -> Callable[[Column], Column]:
    """text -> its tokens: words (between white space), letters, words_and_marks (letters or digits, and each other sign),
    residues (with special tokens), the pieces of a vocabulary (a text file of a piece a line, .txt) by longest match, or
    those of a local SentencePiece file, whose path ends in .model."""
    if name.endswith(".model"):
        return lambda text: _pieces(name)(text)
    if name.endswith(".txt") or name == "residues":
        from pyspark.sql import SparkSession

        from strandlab.functions.tokenize import residue_tokens, word_pieces

        if name == "residues":
            return residue_tokens("ACDEFGHIKLMNPQRSTVWYBXZUO")
        return word_pieces(r[0] for r in SparkSession.getActiveSession().read.text(name).collect())
    patterns = {"words": r"\S+", "words_and_marks": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"}
    if name == "letters":
        return letters
    if name not in patterns:
        raise ValueError(f"unknown tokenizer {name!r}")
    return lambda text: F.regexp_extract_all(text, F.lit(patterns[name]), F.lit(0))


def _pieces(path: str):
    """Arrow batches through the library: no built-in function encodes."""
    loaded = []

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        import sentencepiece

        if not loaded:
            loaded.append(sentencepiece.SentencePieceProcessor(model_file=path))
        return texts.map(lambda t: None if t is None else loaded[0].encode(t, out_type=str))

    return pieces


def diff_positions(a: Column, b: Column) -> Column:
    """Places, from 0, where two token arrays differ, as far as the shorter one goes."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    return F.filter(places, lambda i: F.get(a, i) != F.get(b, i))


def matched_positions(diff: Column, length: Column) -> Column:
    """Places below length that aren't among the differing ones."""
    places = F.when(length < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), length - 1))
    return F.array_except(places, diff)


def usable_difference(diff: Column, bound: Column) -> Column:
    """Whether some but not all places differ; bound is where "all" begins (the shorter length, L or L - 1)."""
    return (F.size(diff) > 0) & (F.size(diff) < bound)


def well_formed(word: Column, n_types: int = 4) -> Column:
    """Whether an array of brackets of the first n_types types is balanced; other tokens make it false.

    The stack is a string: an opening bracket is put in front, a closing one must meet its partner there; "!" marks
    failure and stays.
    """
    kinds = BRACKETS[:n_types]

    def step(stack: Column, token: Column) -> Column:
        out = F.lit("!")
        for opening, closing in kinds:
            out = F.when(token == opening, F.concat(F.lit(opening), stack)).when((token == closing) & F.startswith(stack, F.lit(opening)), F.substring(stack, 2, 1 << 30)).otherwise(out)
        return F.when(stack == "!", stack).when(F.startswith(stack, F.lit("!")), F.lit("!")).otherwise(out)

    return F.coalesce(F.aggregate(word, F.lit(""), step) == "", F.lit(False))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(values: tuple[str, ...] | list[str], u: Column) -> Column:
    """The value at u in [0, 1)."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def signed(x: Column, places: int = 3) -> Column:
    return F.format_string(f"%+.{places}f", x)


def fixed(x: Column, places: int = 3) -> Column:
    """Fixed decimals; what is missing prints as nan."""
    return F.coalesce(F.format_string(f"%.{places}f", x), F.lit("nan"))


def last_true(states: Column, mask: Column) -> Column:
    """The state of the last place that the mask counts; null for an empty mask."""
    n = F.size(F.filter(mask, lambda x: x == 1))
    return F.when(n > 0, F.get(states, n - 1))
