"""Windows of n tokens that start in more than one document: how documents, pieces of them and verdicts travel.

Which windows repeat is decided by a resolver (a radix sort or a suffix automaton) that must see all equal windows at
once. Sending every window would multiply the corpus, so windows travel in stretches: the smallest hash among a
window's k-token grams is its anchor, equal windows have equal anchors, and neighbours mostly share one.

1. Each group of documents sends its distinct anchors, compressed; those found in one document only are settled.
2. For the anchors sent back the group sends the stretches of tokens around them, equal ones once. All stretches of
   an anchor meet in one bucket, where the resolver finds for each window the smallest document that has it.
3. Each group gets back the spans of its documents whose windows also start in a document with a smaller id.

An anchor in more than `hot` documents would gather in one bucket without bound. Its windows travel one by one
instead, dealt by a hash of the whole window, with the smallest and largest document of the group; a window costs a row
for each group of documents and not for each document. Windows of bytes travel whole, so these too are settled by the
resolver, and nothing is taken for equal that isn't, byte by byte. Words are 64-bit hashes themselves; their windows
travel as a second, independent hash, and of n of them two different ones are taken for equal with probability below
n^2 / 2^129.

Groups and buckets follow the bytes of all texts, which are measured; nothing else goes to the driver. All work is in
shuffles, which Spark repeats if an executor is lost. Every row has spans of its own: rows that share a doc_id never
remove anything from each other, whatever their texts. Rows of a group are told apart by their place in the order of
doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.llm import kernel
from strandlab.llm.kernel import U64
from strandlab.llm.shared import ready, text_bytes, whole

MESSAGE = "dest int, src int, kind int, n long, m long, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["dest", "src", "kind", "n", "m", "a", "b", "c", "d", "e"]
_SCHEMA = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), *((x, pa.binary()) for x in "abcde")])
_CHUNK = 1 << 18
_SHIFT = U64(24)
#: Bits of an anchor that travel. More than a corpus has anchors; a chance match only costs a needless comparison.
_BITS = 48

#: resolver(contents, ends, anchors, documents, n): for each window of each content the smallest document that has it.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Plan:
    words: bool  # tokens are words, else bytes
    n: int  # tokens of a window
    k: int  # tokens of a gram
    hot: int
    groups: int
    buckets: int

    @property
    def name(self) -> np.dtype:
        """What tells windows with one hash apart: all bytes of the window, or a second hash of its words."""
        return np.dtype("V8" if self.words else f"V{self.n}")


def plan(docs: DataFrame, words: bool, n: int, k: int, hot: int, group_bytes: int = 7 << 19, bucket_bytes: int = 6 << 20) -> Plan:
    """Groups and buckets of a few MB of text, growing to 64 MB where there are thousands of them."""
    size = text_bytes(docs)
    groups, buckets = (-(-size // max(least, min(64 << 20, size // 4096))) for least in (group_bytes, bucket_bytes))
    return Plan(words, n, k, hot, min(max(48, groups), 1 << 30), min(max(32, buckets), 1 << 30))


class Tokens:
    """The tokens of a group's documents, one after another."""

    def __init__(self, text: pa.ChunkedArray, words: bool):
        self.data, self.offsets = kernel.utf8(text)
        if words:
            parts, starts, ends, firsts = [], [], [], [np.zeros(1, np.int64)]
            for a, b in kernel.blocks(self.offsets):
                own = self.offsets[a : b + 1] - self.offsets[a]
                h, s, e, first = kernel.word_hashes(self.data[self.offsets[a] : self.offsets[b]], own, lower=False)
                parts.append(h)
                firsts.append(first[1:] + firsts[-1][-1])
            self.values = np.concatenate(parts) if parts else np.zeros(0, U64)
            self.ends = np.concatenate(firsts)
        else:
            self.values, self.ends = self.data, self.offsets

    def windows(self, n: int) -> np.ndarray:
        """All windows of n bytes, each as one value; a view, so nothing is copied before some of them are taken."""
        return np.ndarray(max(0, len(self.values) - n + 1), f"V{n}", self.values, 0, (1,)) if len(self.values) else np.zeros(0, f"V{n}")

    def sums(self, a: int, b: int, second: bool = False) -> np.ndarray:
        return kernel.prefix_sums(kernel.hash_values(self.values[a:b], second))


def stretches(tokens: Tokens, n: int, k: int):
    """Runs of windows that share an anchor: first window, number of windows, anchor and prefix sums (with their start) by chunk."""
    ends, total = tokens.ends, len(tokens.values)
    width = n - k + 1
    for a in range(0, max(0, total - n + 1), _CHUNK):
        b = min(a + _CHUNK, total - n + 1)  # windows a to b
        sums = tokens.sums(a, b + n - 1)
        grams = kernel.window_hash(sums, k)
        key = grams >> _SHIFT
        key <<= _SHIFT
        key |= np.arange(len(key), dtype=U64)
        step = 1
        while 2 * step <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if step < width:
            key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
        late = np.zeros(b - a + 1, np.int32)
        inner = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b + n, "left") + 1]
        before = ends[np.searchsorted(ends, inner, "left") - 1] if len(inner) else inner
        np.add.at(late, np.clip(np.maximum(before, inner - n + 1) - a, 0, b - a), 1)
        np.add.at(late, np.clip(inner - a, 0, b - a), -1)
        valid = np.cumsum(late[:-1]) == 0
        change = np.ones(b - a, bool)
        change[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
        change &= valid
        first = np.flatnonzero(change)
        if len(first):
            count = np.bincount((np.cumsum(change) - 1)[valid], minlength=len(first))
            place = (key[first] & U64((1 << 24) - 1)).astype(np.int64)
            yield a, sums, first, count, kernel.mix(grams[place]) >> U64(64 - _BITS)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], _SCHEMA.field(i).type) for i in range(10)], schema=_SCHEMA)


def _zip(x: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers cost little."""
    x = np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(blob, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(-1)


def _press(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _loose(blob: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * dtype.itemsize, codec="zstd", asbytes=True), dtype)


def _same_spans(values: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of size values from a and from b agree, value by value."""
    out = np.zeros(len(a), bool)
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(size) // _CHUNK)) + 1):
        if len(part):
            n = size[part]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = values[np.repeat(a[part], n) + step] == values[np.repeat(b[part], n) + step]
            out[part] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").to_numpy().astype(np.int64)


def _ordered(table: pa.Table) -> pa.Table:
    """Always the same order, up to rows with equal texts; rows without a doc_id come last."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _named(table: pa.Table) -> pa.Table:
    return table.slice(0, len(table) - table.column("doc_id").null_count)


def _bucket(h: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return ((h >> U64(bits - 32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _cuts(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(sorted_buckets):
        return []
    at = np.flatnonzero(np.diff(sorted_buckets, prepend=-1))
    return list(zip(sorted_buckets[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_buckets)], strict=True))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_keys], 0)
    return np.flatnonzero(new)


def _ask(p: Plan):
    def run(table: pa.Table) -> pa.Table:
        group, table = table.column("grp")[0].as_py(), _named(_ordered(table))
        tokens, ids, found, owners = Tokens(table.column("text"), p.words), _ids(table), [], []
        codes = np.unique(ids, return_inverse=True)[1]
        for a, _, first, _, anchor in stretches(tokens, p.n, p.k):
            found.append(anchor)
            owners.append(codes[np.searchsorted(tokens.ends, first + a, "right") - 1])
        if not found:
            return _table([])
        anchor, owner = np.concatenate(found), np.concatenate(owners)
        order = np.lexsort((owner, anchor))
        anchor, owner = anchor[order], owner[order]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        other = new.copy()
        other[1:] |= owner[1:] != owner[:-1]
        at = np.flatnonzero(new)
        count, anchor = np.add.reduceat(other.astype(np.uint32), at).astype(np.uint32), anchor[at]
        return _table([(b, group, 0, j - i, 0, kernel.pack(anchor[i:j]), _zip(count[i:j]), None, None, None) for b, i, j in _cuts(_bucket(anchor, _BITS, p.buckets))])

    return run


def _answer(p: Plan):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        anchor = np.concatenate([kernel.unpack(r["a"], r["n"]) for r in rows])
        count = np.concatenate([_unzip(r["b"], r["n"], np.uint32) for r in rows])
        group = np.repeat(np.array([r["src"] for r in rows]), [r["n"] for r in rows])
        order = np.argsort(anchor, kind="stable")
        anchor, count, group = anchor[order], count[order], group[order]
        at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        total = np.repeat(np.add.reduceat(count.astype(np.int64), at), np.diff(np.append(at, len(anchor))))
        keep = total > 1
        anchor, total, group = anchor[keep], total[keep], group[keep]
        order = np.argsort(group, kind="stable")
        anchor, total, group = anchor[order], total[order], group[order]
        bucket = rows[0]["dest"]
        return _table([(g, bucket, 0, j - i, 0, kernel.pack(anchor[i:j]), np.packbits(total[i:j] > p.hot).tobytes(), None, None, None) for g, i, j in _cuts(group)])

    return run


def _send(p: Plan):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _table([])
        group, table = table.column("grp")[0].as_py(), _named(_ordered(table))
        rows = replies.to_pylist()
        known = np.concatenate([kernel.unpack(r["a"], r["n"]) for r in rows])
        hot = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        tokens, ids = Tokens(table.column("text"), p.words), _ids(table)
        parts, single = [], []
        for a, sums, first, count, anchor in stretches(tokens, p.n, p.k):
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            mine = known[at] == anchor
            first, count, anchor, warm = first[mine], count[mine], anchor[mine], hot[at[mine]]
            doc = np.searchsorted(tokens.ends, first + a, "right") - 1
            cold = ~warm
            parts.append((anchor[cold], kernel.span_hash(sums, first[cold], first[cold] + count[cold] + p.n - 1), first[cold] + a, count[cold], doc[cold]))
            if warm.any():
                n, f = count[warm], first[warm]
                starts = np.repeat(f - np.cumsum(n) + n, n) + np.arange(n.sum())
                second = kernel.span_hash(tokens.sums(a, a + len(sums) - 1, second=True), starts, starts + p.n) if p.words else None
                single.append((kernel.span_hash(sums, starts, starts + p.n), starts + a if second is None else second, np.repeat(ids[doc[warm]], n)))
        out = []
        anchor, content, first, count, doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)] * 3
        if len(anchor):
            order = np.lexsort((content, anchor))
            anchor, content, first, count, doc = (x[order] for x in (anchor, content, first, count, doc))
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (count[1:] != count[:-1])
            like = np.flatnonzero(~new)
            new[like] = ~_same_spans(tokens.values, first[like], first[like - 1], count[like] + p.n - 1)
            which, at = np.cumsum(new) - 1, np.flatnonzero(new)
            bucket = _bucket(anchor, _BITS, p.buckets)
            for b, i, j in _cuts(bucket):
                u = at[np.searchsorted(at, i) : np.searchsorted(at, j)]
                size = count[u] + p.n - 1
                starts = np.repeat(first[u] - np.cumsum(size) + size, size) + np.arange(size.sum())
                place = np.stack([doc[i:j], ids[doc[i:j]], first[i:j] - tokens.ends[doc[i:j]], which[i:j] - which[i]])
                text = tokens.values[starts]
                blob = pa.compress(text.tobytes(), codec="zstd", asbytes=True) if text.dtype == np.uint8 else _zip(text)
                out.append((b, group, 0, j - i, len(u), kernel.pack(anchor[u]), _zip(count[u].astype(np.uint16)), blob, _zip(place.astype(np.int64).T), None))
        if single:
            h, key, owner = (np.concatenate(x) for x in zip(*single, strict=True))
            single.clear()
            order = np.lexsort((owner, h))
            h, key, owner = h[order], key[order], owner[order]
            named = (lambda x: x.view(p.name)) if p.words else (lambda x: tokens.windows(p.n)[x])
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            like = np.flatnonzero(~new)
            for x in np.array_split(like, -(-len(like) // _CHUNK) or 1):
                new[x] = named(key[x]) != named(key[x - 1])
            at = np.flatnonzero(new)
            low, high, h, key = owner[at], owner[np.append(at[1:], len(owner)) - 1], h[at], key[at]
            out += [(b, group, 1, j - i, 0, kernel.pack(h[i:j]), _zip(low[i:j]), _zip(high[i:j]), _press(named(key[i:j])), None) for b, i, j in _cuts(_bucket(h, 64, p.buckets))]
        return _table(out)

    return run


def _resolve(p: Plan, resolver: Resolver):
    kind = np.uint64 if p.words else np.uint8

    def cold(rows: list[dict]) -> list[tuple]:
        anchors, counts, contents, places, groups, base = [], [], [], [], [], 0
        for r in rows:
            anchors.append(kernel.unpack(r["a"], r["m"]))
            counts.append(_unzip(r["b"], r["m"], np.uint16).astype(np.int64))
            size = int(counts[-1].sum()) + r["m"] * (p.n - 1)
            contents.append(np.frombuffer(pa.decompress(r["c"], size, codec="zstd", asbytes=True), np.uint8) if kind is np.uint8 else _unzip(r["c"], size, np.uint64))
            place = _unzip(r["d"], r["n"], np.dtype((np.void, 32))).view(np.int64).reshape(-1, 4).copy()
            place[:, 3] += base
            places.append(place)
            groups.append(np.full(r["n"], r["src"]))
            base += r["m"]
        anchor, count, content, place, group = (np.concatenate(x) for x in (anchors, counts, contents, places, groups))
        owner = np.full(len(anchor), np.iinfo(np.int64).max)
        np.minimum.at(owner, place[:, 3], place[:, 1])
        ends = np.append(0, np.cumsum(count + p.n - 1))
        least = resolver(content, ends, anchor, owner, p.n)
        at = np.append(0, np.cumsum(count))
        lowest, highest = np.minimum.reduceat(least, at[:-1]), np.maximum.reduceat(least, at[:-1])
        row, doc, start, which = place.T
        full, none = highest[which] < doc, lowest[which] >= doc
        spans = [(group[full], row[full], start[full], start[full] + count[which[full]])]
        some = np.flatnonzero(~full & ~none)
        n = count[which[some]]
        if len(some):  # some of the windows only: runs of them
            window = np.repeat(at[which[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            of = np.repeat(some, n)
            gone = least[window] < doc[of]
            edge = np.ones(len(of), bool)
            edge[1:] = (gone[1:] != gone[:-1]) | (of[1:] != of[:-1])
            b = np.flatnonzero(edge)
            e = np.append(b[1:], len(of))
            b, e = b[gone[b]], e[gone[b]]
            o = of[b]
            shift = start[o] - at[which[o]]
            spans.append((group[o], row[o], window[b] + shift, window[e - 1] + 1 + shift))
        group, row, first, last = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(group, kind="stable")
        group, row, first, last = (x[order] for x in (group, row, first, last))
        return [(g, 0, 0, j - i, 0, _zip(row[i:j]), _zip(first[i:j]), _zip(last[i:j]), None, None) for g, i, j in _cuts(group)]

    def warm(rows: list[dict]) -> list[tuple]:
        h = np.concatenate([kernel.unpack(r["a"], r["n"]) for r in rows])
        low, high = (np.concatenate([_unzip(r[x], r["n"], np.int64) for r in rows]) for x in "bc")
        name = np.concatenate([_loose(r["d"], r["n"], p.name) for r in rows])
        group = np.repeat(np.array([r["src"] for r in rows]), [r["n"] for r in rows])
        order = np.lexsort((name.view(U64), h)) if p.words else np.argsort(h, kind="stable")
        h, name, low, high, group = (x[order] for x in (h, name, low, high, group))
        if p.words:
            at = _starts(h, name.view(U64))
            low = np.repeat(np.minimum.reduceat(low, at), np.diff(np.append(at, len(h))))
        else:
            low = resolver(name.view(np.uint8), np.arange(len(h) + 1) * p.n, h, low, p.n)
        keep = low < high  # some document of the group comes after the first that has the window
        h, name, low, group = h[keep], name[keep], low[keep], group[keep]
        order = np.argsort(group, kind="stable")
        h, name, low, group = h[order], name[order], low[order], group[order]
        return [(g, 0, 1, j - i, 0, kernel.pack(h[i:j]), _zip(low[i:j]), _press(name[i:j]), None, None) for g, i, j in _cuts(group)]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kinds = [[r for r in rows if r["kind"] == x] for x in (0, 1)]
        return _table((cold(kinds[0]) if kinds[0] else []) + (warm(kinds[1]) if kinds[1] else []))

    return run


def _finish(p: Plan, carry: bool):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _ordered(table)
        tokens, rows = Tokens(table.column("text"), p.words), replies.to_pylist()
        named = len(_named(table))
        ids, ends = _ids(table.slice(0, named)), tokens.ends
        edges = np.zeros(len(tokens.values) + 1, np.int32)
        cold, warm = ([r for r in rows if r["kind"] == x] for x in (0, 1))
        if cold:
            row, first, last = (np.concatenate([_unzip(r[x], r["n"], np.int64) for r in cold]) for x in "abc")
            np.add.at(edges, ends[row] + first, 1)
            np.add.at(edges, ends[row] + last + p.n - 1, -1)
        if warm:
            h = np.concatenate([kernel.unpack(r["a"], r["n"]) for r in warm])
            low, name = np.concatenate([_unzip(r["b"], r["n"], np.int64) for r in warm]), np.concatenate([_loose(r["c"], r["n"], p.name) for r in warm])
            order = np.argsort(h, kind="stable")
            h, name, low = h[order], name[order], low[order]
            maybe = np.zeros(1 << 20, bool)
            maybe[h >> U64(44)] = True
            for a in range(0, max(0, len(tokens.values) - p.n + 1), _CHUNK):
                b = min(a + _CHUNK, len(tokens.values) - p.n + 1)
                windows = kernel.window_hash(tokens.sums(a, b + p.n - 1), p.n)
                hit = np.flatnonzero(maybe[windows >> U64(44)])
                at = np.searchsorted(h, windows[hit])
                hit, at = hit[at < len(h)], at[at < len(h)]
                good = h[at] == windows[hit]
                hit, at = hit[good], at[good]
                if not len(hit):
                    continue
                own = kernel.span_hash(tokens.sums(a, b + p.n - 1, second=True), hit, hit + p.n).view(p.name) if p.words else tokens.windows(p.n)[hit + a]
                while (wrong := (name[at] != own) & (np.append(h, ~h[-1:])[at + 1] == windows[hit])).any():
                    at[wrong] += 1  # windows that agree in the first hash only stand side by side
                good = name[at] == own
                hit, at = hit[good] + a, at[good]
                row = np.searchsorted(ends, hit, "right") - 1
                good = (hit + p.n <= ends[row + 1]) & (row < named)
                hit, at, row = hit[good], at[good], row[good]
                hit = hit[low[at] < ids[row]]
                edges[: len(edges) - p.n][hit] += 1
                edges[p.n :][hit] -= 1
        np.cumsum(edges, out=edges)  # a group has far fewer than 2^31 tokens
        return removed(table, tokens, edges[:-1] > 0, p.words, carry)

    return run


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> bytes:
    """What is left of UTF-8 text; a character that lost a byte goes."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
    lost = np.repeat(np.logical_or.reduceat(gone, starts), np.diff(np.append(starts, len(raw))))
    return raw[~lost].tobytes()


def removed(table: pa.Table, tokens: Tokens, gone: np.ndarray, words: bool, carry: bool) -> pa.Table:
    """One row for each document: its tokens, those removed, the runs of them, and what is kept.

    With carry, kept is a text in whole characters (null text stays null) and the row's other columns come along.
    """
    ends = tokens.ends
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    inner = ends[:-1][ends[:-1] < len(gone)]
    starts[inner] = gone[inner]

    def of_each(marks: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(marks)
        return np.searchsorted(places, ends[1:]) - np.searchsorted(places, ends[:-1])

    count, runs = of_each(gone), of_each(starts)
    kept: list = []
    for t in range(len(table)):
        raw, own = tokens.data[tokens.offsets[t] : tokens.offsets[t + 1]], gone[ends[t] : ends[t + 1]]
        if carry and not count[t]:
            kept.append(table.column("text")[t].as_py())
        elif words:
            left = raw.tobytes().split()
            if count[t]:
                left = [w for w, g in zip(left, own.tolist(), strict=True) if not g]
            kept.append(b" ".join(left))
        elif carry:
            kept.append(whole_characters(raw, own).decode("utf-8", "replace"))
        else:
            kept.append((raw[~own] if count[t] else raw).tobytes())
    out = {"doc_id": table.column("doc_id"), "n_tokens": pa.array(np.diff(ends)), "n_removed": pa.array(count.astype(np.int64)), "n_spans": pa.array(runs.astype(np.int64))}
    out["kept"] = pa.array([x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in kept], pa.string()) if carry else pa.array(kept, pa.binary())
    return pa.table(out | ({"row": table.column("row")} if carry else {}))


def without_repeats(docs: DataFrame, p: Plan, resolver: Resolver, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans and kept (bytes) for each row of docs(doc_id, text).

    With carry, kept is a text and row holds all columns of docs but text.
    """
    ready(docs.sparkSession)
    # Rows that share an id, or lack one, are dealt out by their texts; only equal rows always share a group.
    grp = F.pmod(F.hash(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(p.groups)).cast("int")
    own = [whole([c for c in docs.columns if c != "text"]).alias("row")] if carry else []
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", grp.alias("grp"), *own)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_tokens", "n_removed", "n_spans")])
    schema = schema.add("kept", T.StringType() if carry else T.BinaryType())
    schema = schema.add(dealt.schema["row"]) if carry else schema
    dealt = dealt.groupBy("grp")
    asked = dealt.applyInArrow(kernel.lean(_ask(p)), MESSAGE)
    answered = asked.groupBy("dest").applyInArrow(kernel.lean(_answer(p)), MESSAGE)
    sent = dealt.cogroup(answered.groupBy("dest")).applyInArrow(kernel.lean(_send(p)), MESSAGE)
    resolved = sent.groupBy("dest").applyInArrow(kernel.lean(_resolve(p, resolver)), MESSAGE)
    return dealt.cogroup(resolved.groupBy("dest")).applyInArrow(kernel.lean(_finish(p, carry)), schema)
