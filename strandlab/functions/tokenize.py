"""Tokenizers over a vocabulary table: greedy longest match within words, and residues with their special tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions.scalars import letters

#: Special tokens of text and of residue vocabularies: first, last, unknown.
TEXT_SPECIALS = ("[CLS]", "[SEP]", "[UNK]")
RESIDUE_SPECIALS = ("<cls>", "<eos>", "<unk>")
#: A word of more letters is unknown as a whole.
MOST_LETTERS = 100


def longest_matches(word: str, vocabulary: frozenset[str], longest: int, unknown: str, mark: str = "##") -> list[str]:
    """The word's pieces, each the longest of the vocabulary that goes on from there; later ones carry the mark. A word with
    a place where none goes on is unknown as a whole."""
    out, at = [], 0
    if len(word) > MOST_LETTERS:
        return [unknown]
    while at < len(word):
        lead = mark if at else ""
        for end in range(min(len(word), at + longest), at, -1):
            if lead + word[at:end] in vocabulary:
                out.append(lead + word[at:end])
                at = end
                break
        else:
            return [unknown]
    return out


def bounded(tokens: Column, specials: tuple[str, str, str], most: int | None) -> Column:
    """Tokens between the first and last special one, at most `most` with them."""
    own = F.slice(tokens, 1, max(0, most - 2)) if most else tokens
    return F.concat(F.array(F.lit(specials[0])), own, F.array(F.lit(specials[1])))


def word_pieces(vocabulary: Iterable[str], lower: bool = True, specials: tuple[str, str, str] = TEXT_SPECIALS, most: int | None = None) -> Callable[[Column], Column]:
    """text -> pieces of its words and marks, in special tokens; null for null. The vocabulary (tens of thousands of
    pieces) goes to the tasks with the function; a task matches each different word of a batch once."""
    own = frozenset(vocabulary)
    longest = max(map(len, own), default=0)

    @F.pandas_udf("array<string>")
    def pieces(words: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def of(word: str) -> list[str]:
            if word not in known:
                known[word] = longest_matches(word, own, longest, specials[2])
            return known[word]

        return words.map(lambda ws: None if ws is None else [p for w in ws for p in of(w)])

    def run(text: Column) -> Column:
        cased = F.lower(text) if lower else text
        return bounded(pieces(F.regexp_extract_all(cased, F.lit(r"[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]"), F.lit(0))), specials, most)

    return run


def residue_tokens(alphabet: str, specials: tuple[str, str, str] = RESIDUE_SPECIALS, most: int | None = None) -> Callable[[Column], Column]:
    """sequence -> its letters, unknown ones as such, in special tokens; a column expression. White space separates only."""

    def run(seq: Column) -> Column:
        own = F.transform(letters(F.regexp_replace(seq, r"\s+", "")), lambda c: F.when(F.contains(F.lit(alphabet), c), c).otherwise(F.lit(specials[2])))
        return bounded(own, specials, most)

    return run


def unknown_fraction(rows: DataFrame, tokens: str, unknown: str, order: str, *keys: str, most_rows: int = 200) -> DataFrame:
    """keys and unk_frac, to 4 places: the share of unknown ones among all tokens, special ones too, of the first rows of each
    key by `order` (a column of different values); 0 for no tokens."""
    if keys:
        first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__r") <= most_rows)
    else:
        first = rows.orderBy(order).limit(most_rows)
    share = F.sum(F.size(F.filter(tokens, lambda t: t == unknown))) / F.greatest(F.sum(F.size(tokens)), F.lit(1))
    return first.groupBy(*keys).agg(F.round(F.coalesce(share, F.lit(0.0)), 4).alias("unk_frac"))
