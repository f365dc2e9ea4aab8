"""SentencePiece encoding and decoding with merge-type (BPE) models, exactly as the library does it.

Method: Aho-Corasick finds every piece that starts at each position; the encoder takes the longest, keeps it if
it is compatible with the piece before (re-merging the two pieces' text from characters gives just these two),
else tries the next shorter, and backs up where none is left. A bitfield remembers positions that led nowhere,
so each is tried once. Text is cut before runs of the space mark and around line ends first: no piece crosses
those cuts, so chunks encode alone, and each worker keeps the results of frequent chunks in a bounded table.

Models must be of the kind that this holds for, which is checked when one is loaded: no piece has a space mark or line end
within, none is unused or defined by a user, a space is put in front, and nothing else is normalised.

Null text is empty, and empty text has no ids. Rows with a null doc_id, repeated rows and extra columns pass
through unchanged; an existing column named like an output is replaced. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.llm.shared import quoted, ready, whole

MARK = "▁"
#: Chunks kept by each worker, and the longest one kept, in characters.
KEPT_CHUNKS, KEPT_LENGTH = 250_000, 48
KEPT_PAIRS = 1_000_000
#: Bytes of text turned into one output batch.
BATCH_BYTES = 1 << 21

_UNKNOWN = "<unk>"
#: What models of other kinds encode otherwise: spaces, line ends, letters that are often normalised, unknown characters.
_PROBES = ("", " ", "a", "  a  b ", "Hello world,\n\nnext line 1999\n", "ﬁ ½ Ａ e\u0301 ① ™", "\t\x00\r x", "漢字🙂ß", "<s> </s> <unk> <0x41>", "▁a▁▁b")


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_at = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.special = special
        #: All special and byte pieces have ids up to this one.
        self.last_odd = max([-1, *special, *self.byte_of])
        plain = [i for i in range(size) if i not in special and i not in self.byte_of]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.letters = {p for p in self.id_of if len(p) == 1}
        self.length = [len(p) for p in self.pieces]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        # Only pieces that merging their own characters ends in; others never occur in an encoding.
        whole = {i for i in plain if self.merged(self.pieces[i]) == [self.pieces[i]]}
        self.automaton = ahocorasick.Automaton()
        for i in whole:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        #: For each piece the longest other piece that it starts with, or -1.
        self.shorter = [-1] * size
        for i in whole:
            piece = self.pieces[i]
            self.shorter[i] = next((k for n in range(len(piece) - 1, 0, -1) if (k := self.id_of.get(piece[:n])) in whole), -1)
        odd = [p for p in self.id_of if re.search(f"[^{MARK}]{MARK}", p) or len(p) > 1 and "\n" in p]
        if odd or any(model.is_unused(i) for i in range(size)):
            raise ValueError(f"{model_file}: pieces that aren't supported, such as {odd[:3]}")
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.kept_text: dict[str, str] = {}
        self.aged: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        for text in _PROBES:
            ids = model.encode(text)
            if self.encode(text) != ids or self.decode(ids) != model.decode(ids):
                raise ValueError(f"{model_file}: a model of another kind, as {text!r} shows")

    def merged(self, text: str) -> list[str]:
        """Merges from characters: always the best pair, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            got = self.fits[key] = self.merged(self.pieces[left] + self.pieces[right]) == [self.pieces[left], self.pieces[right]]
        return got

    def backtracked(self, text: str) -> list[int]:
        """Ids of a text made of known characters only."""
        n, length, shorter, fits = len(text), self.length, self.shorter, self.fits
        longest = [-1] * n
        for last, piece in self.automaton.iter(text):
            longest[last + 1 - length[piece]] = piece  # ends ascend, so the longest comes last
        failed = bytearray(n + 1)
        path: list[int] = []
        at, piece, before = 0, longest[0], -1
        while True:
            while piece >= 0:
                if not failed[at + length[piece]]:
                    if before < 0:
                        break
                    fit = fits.get(before << 32 | piece)
                    if fit or fit is None and self.compatible(before, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                at += length[piece]
                if at == n:
                    return path
                before, piece = piece, longest[at]
            else:
                failed[at] = 1
                if not path:  # never so for models that passed the checks; merging is right for any
                    return [self.id_of[p] for p in self.merged(text)]
                piece = path.pop()
                at -= length[piece]
                before = path[-1] if path else -1
                piece = shorter[piece]

    def chunk(self, text: str) -> list[int]:
        """Ids of one chunk; characters without a piece become their bytes and stop all merges across them."""
        letters, ids, first = self.letters, [], 0
        if letters.issuperset(text):
            return self.backtracked(text)
        for k, c in enumerate(text):
            if c not in letters:
                if first < k:
                    ids += self.backtracked(text[first:k])
                ids += [self.bytes_at[b] for b in c.encode("utf-8", "replace")]
                first = k + 1
        return ids + self.backtracked(text[first:]) if first < len(text) else ids

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, with the space that encoding put in front still there."""
        out, run = [], bytearray()
        if not ids or min(ids) > self.last_odd:
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_text_of_bytes(bytes(run)))
                run.clear()
            if i not in self.special:
                out.append(self.pieces[i].replace(MARK, " "))
            elif self.pieces[i] == _UNKNOWN:
                out.append(" ⁇ ")
        if run:
            out.append(_text_of_bytes(bytes(run)))
        return "".join(out)

    def chunks(self, text: str) -> list[str]:
        """Where no piece can cross: before space marks and around line ends."""
        if not text:
            return []
        return self.cut.findall(MARK + text.replace(" ", MARK))

    def learn(self, chunks: set[str]) -> None:
        """Puts chunks into the table; a full table ages, and goes if it isn't asked for again."""
        if len(self.kept) > KEPT_CHUNKS:
            self.aged, self.kept, self.kept_text = (self.kept, self.kept_text), {}, {}
        kept, texts, (old, old_texts) = self.kept, self.kept_text, self.aged
        for c in chunks.difference(kept):
            if c in old:
                kept[c], texts[c] = old[c], old_texts[c]
            else:
                ids = self.chunk(c)
                kept[c] = b"".join([self.packed[i] for i in ids])
                texts[c] = self.decoded(ids)

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and what they decode to."""
        parts = self.chunks(text)
        ids, back, first = [], [], 0
        while first < len(parts):  # no text overflows the table
            some = parts[first : first + KEPT_CHUNKS]
            own = set(some)
            long = [c for c in own if len(c) > KEPT_LENGTH] if len(text) > KEPT_LENGTH else []
            self.learn(own)
            ids += map(self.kept.__getitem__, some)
            back += map(self.kept_text.__getitem__, some)
            for c in long:
                del self.kept[c], self.kept_text[c]
            first += KEPT_CHUNKS
        out = "".join(back)
        return b"".join(ids), out[1:] if out[:1] == " " else out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.both(text)[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        back = self.decoded(ids)
        return back[1:] if ids and self.pieces[ids[0]].startswith(MARK) else back


def _text_of_bytes(run: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is not part of a character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(run):
        width = 1 if run[k] < 0x80 else 2 if 0xC2 <= run[k] < 0xE0 else 3 if 0xE0 <= run[k] < 0xF0 else 4 if 0xF0 <= run[k] < 0xF5 else 0
        try:
            out.append(run[k : k + width].decode() if width else "�")
        except UnicodeDecodeError:
            width = 0
            out.append("�")
        k += width or 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each model and worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def _encoder(model_file: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            column, rows, first = batch.column("text"), batch.column("row"), 0
            while first < len(batch):
                ids, texts, size, last = [], [], 0, first
                while last < len(batch) and size < BATCH_BYTES:
                    text = column[last].as_py() or ""
                    one, back = own.both(text)
                    ids.append(one)
                    texts.append(back)
                    size += len(text)
                    last += 1
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.slice(first, last - first).flatten()[: len(keep)], lists, pa.array(texts, pa.string())], [*keep, "ids", "decoded"])
                first = last

    return run


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs without its text, with ids array<int> and decoded string (the text that the ids give back)."""
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(whole(keep).alias("row"), F.col(quoted(text)).alias("text")).mapInArrow(_encoder(model_file, keep), schema)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; null ids give null."""
    ready(encoded.sparkSession)
    keep = [c for c in encoded.columns if c not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.column("row").flatten()[: len(keep)], batch.column("ids"), pa.array(texts, pa.string())], [*keep, ids, out])

    schema = T.StructType([*(encoded.schema[c] for c in (*keep, ids)), T.StructField(out, T.StringType())])
    return encoded.select(whole(keep).alias("row"), F.col(quoted(ids)).alias("ids")).mapInArrow(run, schema)
