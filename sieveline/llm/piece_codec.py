"""Subword encoding and decoding with a merge-type SentencePiece vocabulary.

Every prefix of a text has one last token: the token that ends the encoding of that prefix. An automaton
over the pieces gives the candidates that end at a position; a candidate is right if it is compatible with
the last token of the prefix before it, that is, if encoding the two pieces together gives those two.
The table holds one token for each position; the ids come from walking it backwards.

Defined results: null and empty texts have no ids and decode to the empty text; a character without a piece
becomes byte pieces; texts of any length are encoded whole in linear time; repeated rows give equal rows; an
empty table gives an empty table; columns other than the text pass through, and columns that clash with an
output name are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct segments a worker remembers before it starts afresh; it bounds memory, not results.
REMEMBERED = 400_000
#: Longer segments are encoded each time.
LONGEST_REMEMBERED = 48
SPACE = "▁"


class PieceCodec:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(size):
            if i not in self.byte_of and i not in self.silent and i != self.unknown:
                self.rank[self.pieces[i]] = model.get_score(i)
                self.id[self.pieces[i]] = i
                self.automaton.add_word(self.pieces[i], self.pieces[i])
        self.automaton.make_automaton()
        self.split = self._splitter()
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def _splitter(self):
        """A function that cuts a text where no piece of the vocabulary spans the cut, so that no merge crosses it; None if there is none."""
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            return None
        newline = "" if any("\n" in p for p in self.rank) else "\n"
        letter = re.compile(r"[^\W\d_]").fullmatch
        mixed = any(SPACE not in (a, b) and bool(letter(a)) != bool(letter(b)) for p in self.rank for a, b in zip(p, p[1:]))
        words = f"{SPACE}+[^{SPACE}{newline}]*|[^{SPACE}{newline}]+" if mixed else f"{SPACE}*[^\\W\\d_]+|{SPACE}*(?:[\\d_]|[^\\w{SPACE}{newline}])+|{SPACE}+"
        return re.compile(words + ("|\n" if newline else "")).findall

    def _merge(self, text: str) -> list[str]:
        """The merges themselves, best piece first and leftmost among equals; for texts of two pieces at most."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 2 * REMEMBERED:
                self.fits.clear()
            found = self.fits[key] = self._merge(left + right) == [left, right]
        return found

    def _reachable(self, piece: str) -> bool:
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = self._merge(piece) == [piece]
        return found

    def _tokens(self, text: str) -> list[str]:
        """text with its spaces replaced, as pieces; a character that has none stands for itself."""
        last: list[str | None] = [None] * (len(text) + 1)
        fits, compatible = self.fits, self._compatible
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - len(piece)
            before = last[start]
            if start and before is None:  # an unknown character ends there, and nothing merges with it
                if not self._reachable(piece):
                    continue
            elif start:
                fit = fits.get((before, piece))
                if not (compatible(before, piece) if fit is None else fit):
                    continue
            elif not self._reachable(piece):
                continue
            last[end] = piece
        out, at = [], len(text)
        while at:
            piece = last[at] or text[at - 1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self._tokens(text):
            found = self.id.get(piece)
            if found is not None:
                out.append(found)
            elif self.id_of_byte:
                out.extend(self.id_of_byte[b] for b in piece.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return out

    def _raw(self, ids: list[int]) -> str:
        """The text of ids with a space still at its front."""
        out: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.silent:
                out.append(self.pieces[i])
        return "".join(out).replace(SPACE, " ")

    def _segment(self, text: str) -> tuple[bytes, str]:
        ids = self._ids(text)
        found = array("i", ids).tobytes(), self._raw(ids)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = found
        return found

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """The ids as 32-bit words, and the text that those ids decode to."""
        if not text:
            return b"", ""
        text = SPACE + text.replace(" ", SPACE)
        known, segment = self.known, self._segment
        parts = [known.get(s) or segment(s) for s in (self.split(text) if self.split else [text])]
        decoded = "".join([p[1] for p in parts])
        return b"".join([p[0] for p in parts]), decoded[1:] if decoded[:1] == " " else decoded

    def encode(self, text: str) -> list[int]:
        return array("i", self.round_trip(text)[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        text = self._raw(ids)
        return text[1:] if text[:1] == " " and self.pieces[next((i for i in ids if i not in self.silent), 0)].startswith(SPACE) else text


def _utf8(raw: bytes) -> str:
    """UTF-8 text; each byte that is part of no character gives one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + _utf8(raw[e.start + 1 :])


_loaded: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The codec of a model file; a worker loads each once."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceCodec(model_path)
    return _loaded[model_path]


def encode_documents(df: DataFrame, model_path: str, text: str = "text", decoded: str | None = "decoded", ids: str = "ids") -> DataFrame:
    """df with the ids of each whole text, and with the text that these ids decode to, in place of the text column."""
    made = [ids] + [decoded] * bool(decoded)
    kept = [f for f in df.schema.fields if f.name not in (text, *made)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else []))
    names = [f.name for f in kept]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                found = [own.round_trip(x or "") for x in batch.column(text).to_pylist()]
                ends = [0]
                for raw, _ in found:
                    ends.append(ends[-1] + len(raw) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join([x[0] for x in found]))])
                arrays = [batch.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)] + [pa.array([x[1] for x in found], pa.string())] * bool(decoded)
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *made])

    return df.select(*names, text).mapInArrow(encode, schema)


def decode_documents(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that its ids decode to; null ids give the empty text."""
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([own.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())], names=[*names, out])

    return df.select(*names).mapInArrow(decode, T.StructType([*kept, T.StructField(out, T.StringType(), False)]))
