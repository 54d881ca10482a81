"""SentencePiece (BPE) encoding and decoding with a merge-type prefix table.

A BPE encoding is fixed by its neighbours: a row of pieces is the encoding of its text exactly
when every adjacent pair of pieces is the encoding of its own concatenation. So each prefix of a
text has one last piece, and a table of these is filled from left to right: an Aho-Corasick
automaton over the vocabulary lists the pieces that end at a position, and the one that is
compatible with the last piece of what stands before it is stored. The ids are then read off the
table backwards. No merge queue is run over the text.

Pieces hold the white-space mark only at their start, and no piece holds a line feed, so a text is
cut in front of each run of marks and around line feeds without changing the result; encodings of
these short strings are kept, packed, in a bounded table per Python worker. A new string whose last two
characters stand together in no piece is that without its last character, and that character.

Defined results: null is the empty text; the empty text has no ids but the end id and decodes to
the empty text; repeated rows are encoded each; other columns pass through untouched (an existing
column that has an output's name is replaced); texts of any length are taken whole, and only the
distinct strings between white space are held in memory besides the text itself.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmill.llm.common import releasing, slices

MARK = "▁"
#: Stands for the piece before the first one.
NONE = 1 << 28
#: Strings and pairs that one worker keeps in its tables while a task runs (about 40 and 15 MB).
KEPT_WORDS, KEPT_PAIRS = 300_000, 250_000


class PieceModel:
    """The pieces, scores and byte pieces of a SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("a", "ﬁ", "a  b "):
            if model.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError("only models with identity normalisation and a leading mark are supported")
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.eos, self.unk = model.eos_id(), model.unk_id()
        special = [model.is_unknown(i) or model.is_control(i) or model.is_unused(i) for i in range(size)]
        self.byte_id = {int(self.pieces[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in self.byte_of}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.control = {i for i in range(size) if model.is_control(i)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces that span white space are not supported")
        self.unk_text = " ⁇ "

    def merge(self, text: str, halves: dict | None = None) -> list[str]:
        """BPE by its definition: the pair that makes the best-scored piece merges first, the leftmost on ties.

        ``halves`` gets the last merge if one piece comes out.
        """
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(((rank.get(a + b, 1e18), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1e18, 0))
            if best[0] >= 1e18:
                break
            if len(parts) == 2 and halves is not None:
                halves[text] = (parts[0], parts[1])
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts


class PrefixTableEncoder:
    """Encodes and decodes as the model's own library does, by the prefix table."""

    def __init__(self, path: str):
        self.model = m = PieceModel(path)
        self.halves: dict[str, tuple[str, str]] = {}  # what each piece is merged from at last
        # a piece that BPE never ends on is in no encoding
        self.alone = {p: i for p, i in m.ids.items() if m.merge(p, self.halves) == [p]}
        self.together = {p[k : k + 2] for p in m.ids for k in range(len(p) - 1)}
        self.length, self.code = list(map(len, m.pieces)), [array("i", [i]).tobytes() for i in range(len(m.pieces))]
        self.lefts = {i: _Lefts(self, i) for i in self.alone.values()}
        self.pairs = 0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.alone.items():
            self.automaton.add_word(p, (len(p), i, self.lefts[i]))
        self.automaton.make_automaton()
        known = "".join(re.escape(p) for p in m.ids if len(p) == 1)
        self.unknown = re.compile(f"([^{known}])")
        self.edge: dict[tuple[int, int], list[tuple[str, float]]] = {}
        self.plain = [None if m.byte_of.get(i, 0) > 127 else chr(m.byte_of[i]) if i in m.byte_of else "" if i in m.control else m.unk_text if i == m.unk else p.replace(MARK, " ") for i, p in enumerate(m.pieces)]
        self.words = _Words(self)

    def _edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The pieces that stand at one edge while the piece is merged, each with the rank of the merge that takes it."""
        out, text, taken = [], self.model.pieces[piece], float("inf")
        while True:
            out.append((text, taken))
            if text not in self.halves:
                return out
            taken, text = self.model.rank[text], self.halves[text][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces are the encoding of their concatenation.

        They aren't if some merge across their border would have come before the merges that take
        the two strings it joins; on equal ranks the one further left comes first.
        """
        edges, rank, pieces = self.edge, self.model.rank, self.model.pieces
        if pieces[left][-1] + pieces[right][0] not in self.together:
            return True
        if (a := edges.get((left, 1))) is None:
            a = edges[left, 1] = self._edge(left, 1)
        if (b := edges.get((right, 0))) is None:
            b = edges[right, 0] = self._edge(right, 0)
        for x, x_taken in a:
            for y, y_taken in b:
                if (r := rank.get(x + y)) is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    def forget_pairs(self) -> None:
        self.pairs = 0
        self.edge.clear()
        for lefts in self.lefts.values():
            lefts.clear()

    def _known(self, text: str) -> bytes:
        """Packed ids of a text all of whose characters are pieces."""
        code = self.code
        if (i := self.alone.get(text)) is not None:
            return code[i]
        last = [-1] * len(text)
        last.append(NONE)  # the last piece of the empty prefix, which ends at -1
        for end, (n, i, lefts) in self.automaton.iter(text):
            if last[end] < 0 and (before := last[end - n]) >= 0 and lefts[before]:
                last[end] = i
        at, out, length = len(text) - 1, [], self.length
        while at >= 0:
            out.append(code[i := last[at]])
            at -= length[i]
        out.reverse()
        return b"".join(out)

    def word(self, text: str) -> bytes:
        """Packed ids of one string between cuts; characters without a piece become byte pieces."""
        m, code = self.model, self.code
        text = text.replace(" ", MARK)
        if not self.unknown.search(text):
            return self._known(text)
        out = []
        for k, part in enumerate(self.unknown.split(text)):
            if k % 2 == 0:
                if part:
                    out.append(self._known(part))
            elif m.byte_id:
                out += [code[m.byte_id[b]] for b in part.encode("utf-8", "surrogatepass")]
            else:
                out.append(code[m.unk])
        return b"".join(out)

    def packed(self, text: str, end: bool = True) -> bytes:
        """The ids of a text, four bytes each."""
        out = b"".join(map(self.words.__getitem__, CUT.findall(" " + text))) if text else b""
        return out + self.code[self.model.eos] if end else out

    def encode(self, text: str, end: bool = True) -> list[int]:
        return unpacked(self.packed(text, end))

    def decode(self, ids: list[int]) -> str:
        """Pieces to text: marks become spaces, the leading one goes, byte runs are read as UTF-8 (bad bytes: U+FFFD)."""
        m = self.model
        try:
            text = "".join(map(self.plain.__getitem__, ids))
            first = next((i for i in ids if i not in m.control), None)
            return text[1:] if first is not None and m.pieces[first].startswith(MARK) else text
        except TypeError:  # bytes beyond ASCII, which need their neighbours
            pass
        out, run, strip = [], bytearray(), None
        for i in ids:
            if strip is None and i not in m.control:
                strip = m.pieces[i].startswith(MARK)
            if (b := m.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i in m.control:
                continue
            out.append(m.unk_text if i == m.unk else m.pieces[i])
        if run:
            out.append(_utf8(run))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if strip else text


#: A run of spaces with the string that follows it, or a line feed. The mark counts as a space.
CUT = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")


def _utf8(run: bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that starts no whole character."""
    out, at = [], 0
    while at < len(run):
        b = run[at]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            out.append(run[at : at + n].decode("utf-8") if n else "�")
            at += max(n, 1)
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()


class _Lefts(dict):
    """Pieces that may stand before one piece -> whether the two are compatible; when there are too many pairs all start anew."""

    __slots__ = ("encoder", "piece")

    def __init__(self, encoder: PrefixTableEncoder, piece: int):
        super().__init__()
        self.encoder, self.piece = encoder, piece

    def __missing__(self, left: int) -> bool:
        enc = self.encoder
        ok = left == NONE or enc.compatible(left, self.piece)
        if enc.pairs >= KEPT_PAIRS:
            enc.forget_pairs()
        enc.pairs += 1
        self[left] = ok
        return ok


class _Words(dict):
    """String between cuts -> packed ids; full tables start anew."""

    def __init__(self, encoder: PrefixTableEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        enc = self.encoder
        if len(word) > 64:
            return enc.word(word)
        split = word[-2:-1] not in ("", " ", MARK) and word[-2:] not in enc.together
        ids = self[word[:-1]] + self[word[-1]] if split else enc.word(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixTableEncoder:
    """One encoder per worker and model."""
    return PrefixTableEncoder(path)


def forget(path: str) -> None:
    """Empty the tables that the worker's encoder has filled; the vocabulary and its automaton stay."""
    enc = encoder(path)
    enc.words.clear()
    enc.forget_pairs()


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of its text (end id last) and, if ``decoded`` names a column, those ids decoded again."""
    out = T.StructType([f for f in df.schema.fields if f.name not in (ids, decoded)])
    keep = [f.name for f in out.fields]
    out = out.add(ids, T.ArrayType(T.IntegerType(), False))
    if decoded:
        out = out.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in slices(batches):
            got = [enc.packed(t or "") for t in batch.column(text).to_pylist()]
            flat = np.frombuffer(b"".join(got), np.int32)
            ends = np.cumsum([0, *(len(x) >> 2 for x in got)], dtype=np.int32)
            cols = [batch.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), pa.list_(pa.field("element", pa.int32(), False)))]
            if decoded:
                cols.append(pa.array([enc.decode(unpacked(x)) for x in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=keep + [ids] + ([decoded] if decoded else []))

    return df.mapInArrow(lambda batches: releasing(run(batches), lambda: forget(model_path)), out)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give the empty text."""
    out = T.StructType([f for f in df.schema.fields if f.name != text])
    keep = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in slices(batches):
            got = pa.array([enc.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [got], names=[*keep, text])

    return df.mapInArrow(lambda batches: releasing(run(batches), lambda: forget(model_path)), out.add(text, T.StringType()))
