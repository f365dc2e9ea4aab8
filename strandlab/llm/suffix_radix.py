"""Suffix-array dedup: removes passages of bytes that also stand in an earlier document.

Method: suffixes are ordered only through `threshold` tokens (bytes) by most-significant-digit radix passes. Each pass
sorts on the next eight bytes within the groups left by the passes before; a suffix that is alone in its group is
settled and leaves. The groups left after the last pass are exactly the repeated windows. The first digit is the
window's anchor (see repeats.py): it deals suffixes to buckets and settles most of them before any text travels.

Every byte covered by a window that also starts in a document with a smaller id is removed; overlaps count, and
windows are judged on the input. Documents shorter than the threshold lose nothing. Null text is empty. A null doc_id
neither removes nor loses anything; rows that share a doc_id remove nothing from each other, and each has its own result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm import repeats

THRESHOLD, GRAM, HOT = 50, 20, 2048
#: Suffixes sorted at once; an anchor's stay together.
PASS_WINDOWS = 1 << 18


def equal_windows(contents: np.ndarray, positions: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the suffixes at positions repeat through n bytes within their group, and the number of their class."""
    low, high = (int(positions.min()), int(positions.max()) + n) if len(positions) else (0, 0)
    padded = np.concatenate([contents[low:high], np.zeros(8, np.uint8)])
    digits, positions = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,)), positions - low
    alive = np.arange(len(positions))
    for depth in range(0, n, 8):
        digit = digits[positions[alive] + depth].astype(np.uint64)
        if n - depth < 8:
            digit >>= np.uint64(8 * (8 - (n - depth)))
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        last = np.append(new[1:], True)
        more = ~(new & last)
        alive, group = alive[more], (np.cumsum(new) - 1)[more]
        if not len(alive):
            break
    return alive, group


def radix(contents: np.ndarray, ends: np.ndarray, anchors: np.ndarray, documents: np.ndarray, n: int) -> np.ndarray:
    """For each window of each content the smallest document that has it."""
    count = np.diff(ends) - (n - 1)
    least, start = np.repeat(documents, count), np.append(0, np.cumsum(count))
    _, which, size = np.unique(anchors, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(size[which] > 1)  # a stretch alone under its anchor equals no other
    shared = shared[np.argsort(which[shared], kind="stable")]
    first = np.flatnonzero(np.diff(which[shared], prepend=-1))
    before = np.append(0, np.cumsum(count[shared]))[first]
    for some in np.split(shared, first[np.flatnonzero(np.diff(before // PASS_WINDOWS, prepend=0))]):
        m = count[some]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at = np.repeat(start[some], m) + step
        alive, group = equal_windows(contents, np.repeat(ends[some], m) + step, np.repeat(which[some], m), n)
        if len(alive):
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            low = np.minimum.reduceat(least[at[alive]], cut)
            least[at[alive]] = np.repeat(low, np.diff(np.append(cut, len(group))))
    return least


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) for each row of docs(doc_id, text)."""
    p = repeats.plan(docs, words=False, n=threshold, k=gram, hot=hot)
    return repeats.without_repeats(docs, p, radix).withColumnRenamed("n_tokens", "n_bytes")


def cleaned(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with what is left of their texts (a character that lost a byte goes), and n_chars after them if there is one.

    Row by row: all columns, repeated rows and texts without a repeat stay as they were.
    """
    p = repeats.plan(docs, words=False, n=threshold, k=gram, hot=hot)
    left = repeats.without_repeats(docs, p, radix, carry=True)
    own = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in own:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(own["n_chars"])
    return left.select(*(own[c].alias(c) for c in docs.columns))
