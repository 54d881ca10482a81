"""Token ids in fixed-width bit-packed files.

Each id takes the fewest bits that hold the vocabulary. Ids are packed in blocks of ``BLOCK_IDS``;
the footer holds the byte offset of each block and the place of each document, so a reader unpacks
any block alone with numpy and finds the ids of any document without reading others.

File: ``QTOK`` + version, bits (two bytes) + ids per block (4) | blocks | block offsets (8 each) |
document ids, first positions, lengths (8 each) | counts of blocks and documents and ids (8 each) +
``QTOK``. Integers are little-endian; bits fill a byte from its lowest.

Texts are encoded by the tokenizers library. A lone space between other characters always starts a
new pre-token of a byte-level BPE with the usual split pattern, and so does what follows a run of
letters, so texts are cut there and each distinct string is encoded once per worker while a bounded table holds it; texts that hold a special
token, and tokenizers of another build, are encoded whole.

Defined results: null is the empty text; an empty text holds the end id alone; rows with equal ids
are ordered by text; rows with a null document id come first, and are stored under the smallest
64-bit integer and read back as null; an empty table gives no files; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import shards
from quillmill.llm.common import filesystem, fresh, releasing, text_of

BLOCK_IDS = 8192
MAGIC = b"QTOK"
NO_ID = -(2**63)
KEPT_STRINGS = 550_000
#: Shards whose sizes are summed up in one task.
GROUP = 4096

_SPACE = "\t-\r \x85\xa0  -     　"  # White_Space in Unicode
#: Letters up to a mark, digit, space or the end (which always end a pre-token), other strings without white space, white space.
_CUT = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\\x00-@\\[-`{{-\\x7f]|\\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


# ---- packing


def width(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, the last byte filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    as_bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(as_bits[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a packed block as ``uint32``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    as_bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = as_bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file to an open stream; holds one block and the document index."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.at = stream.write(MAGIC + bytes((1, bits)) + BLOCK_IDS.to_bytes(4, "little")) or 10
        self.offsets, self.doc, self.first, self.count = [], [], [], []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc.append(doc_id)
        self.first.append(self.total)
        self.count.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= 16 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for k in range(0, stop, BLOCK_IDS):
            data = pack(ids[k : min(k + BLOCK_IDS, stop)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> int:
        """Ends the file; returns its size."""
        self._flush(True)
        tail = b"".join(np.array(x, "<i8").tobytes() for x in (self.offsets, self.doc, self.first, self.count, (len(self.offsets), len(self.doc), self.total))) + MAGIC
        self.stream.write(tail)
        self.stream.close()
        return self.at + len(tail)


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        head, tail = self._read(0, 10), self._read(size - 28, 28)
        if head[:4] != MAGIC or tail[24:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.per_block = head[5], int.from_bytes(head[6:10], "little")
        blocks, docs, self.total = (int(x) for x in np.frombuffer(tail[:24], "<i8"))
        index = np.frombuffer(self._read(size - 28 - 8 * (blocks + 3 * docs), 8 * (blocks + 3 * docs)), "<i8")
        self.offsets, (self.doc, self.first, self.count) = index[:blocks], index[blocks:].reshape(3, docs)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start``; reads only the blocks that hold them."""
        if not count:
            return np.empty(0, np.uint32)
        a, b = start // self.per_block, (start + count - 1) // self.per_block
        ids = min((b + 1) * self.per_block, self.total) - a * self.per_block
        at = int(self.offsets[a])
        data = self._read(at, -(-ids * self.bits // 8) if self.per_block * self.bits % 8 == 0 else 0)
        return unpack(data, self.bits, ids)[start - a * self.per_block :][:count]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.count[k]))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, some blocks at a time."""
        k, held, base = 0, np.empty(0, np.uint32), 0
        step = 64 * self.per_block
        for at in range(0, max(self.total, 1), step):
            held = np.concatenate([held, self.ids(at, min(step, self.total - at))])
            while k < len(self.doc) and self.first[k] + self.count[k] <= at + step:
                s = int(self.first[k]) - base
                yield int(self.doc[k]), held[s : s + int(self.count[k])]
                k += 1
            cut = (int(self.first[k]) if k < len(self.doc) else self.total) - base
            held, base = held[cut:], base + cut


# ---- encoding


class Encoder:
    """Ids of a text as little-endian ``uint32`` bytes, as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec["normalizer"] and not spec["post_processor"]
        self.line = self.whole("\n")
        self.cuts = self.cuts and len(self.line) == 4
        self.table: dict[str, bytes] = {}

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, strings: list[str]) -> None:
        """Encodes strings without white space inside, joined by line feeds, which are pre-tokens of their own."""
        groups = [strings[at : at + 256] for at in range(0, len(strings), 256)]
        line = int.from_bytes(self.line, "little")
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = (4 * np.append(np.flatnonzero(ids == line), len(ids))).tolist()
            data, start = ids.tobytes(), 0
            for s, end in zip(group, ends, strict=True):
                self.table[s] = data[start:end]
                start = end + 4

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [self.whole(t) for t in texts]
        parts = [None if any(x in t for x in self.special) else _CUT.findall(t) for t in texts]
        if len(self.table) > KEPT_STRINGS:
            self.table.clear()
        new = set().union(*(p for p in parts if p)).difference(self.table)
        spaces = [w for w in new if not w.strip(" ") or w[-1].isspace()]
        for w in spaces:
            self.table[w] = self.whole(w)
        words = list(new.difference(spaces))
        self._learn(words)
        get = self.table.__getitem__
        return [self.whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---- DataFrames


def write(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", target_bytes: int = 64 << 20) -> DataFrame:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending document order; returns the manifest.

    A shard's file holds about ``target_bytes`` of text. Files in the order of their names hold the
    documents in order.
    """
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    shard, n = shards.borders(source, "doc_id", F.octet_length("text") + 16, target_bytes)
    dealt = shards.dealt(source.withColumn("shard", shard), n, F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, files, writer, end = encoder(tokenizer_path), None, None, np.array([end_id], "<u4").tobytes()
        bits = width(max(enc.vocabulary(), end_id + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if writer is None:
                    files = shards.Files(folder, ".qtok")
                    writer = Writer(files.open(part.column("shard")[0].as_py(), 0), bits)
                for d, ids in zip(part.column("doc_id").to_pylist(), enc.encode_batch(part.column("text").to_pylist()), strict=True):
                    writer.add(NO_ID if d is None else d, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            size = writer.close()
            files.done(len(writer.doc), writer.total, size)
            yield files.batch()

    return shards.commit(dealt.mapInArrow(lambda batches: releasing(run(batches)), shards.MANIFEST), folder)


READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def read(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """One row for each document of the files: where its ids start among all, their number, checksum and, if wanted, the ids."""
    out = READ if ids else T.StructType(READ.fields[:-1])
    # sums of the files before: in groups of shards, so that no task sees all files
    rows = manifest.select("path", "shard", "file", "units", F.floor(F.col("shard") / GROUP).alias("g"))
    groups = rows.groupBy("g").agg(F.sum("units").alias("units"))
    before = W.partitionBy(F.lit(0)).orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("g", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("g").orderBy("shard", "file").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("units").over(inside), F.lit(0))).join(F.broadcast(groups), "g")
    files = rows.select("path", (F.col("_start") + F.col("_own")).cast("long").alias("base")).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as f:
                    r, held, n = Reader(f), [], 0
                    for k, (d, x) in enumerate(r.documents()):
                        held.append((None if d == NO_ID else d, base + int(r.first[k]), len(x), zlib.crc32(x.tobytes()), x.astype(np.int32) if ids else None))
                        n += len(x)
                        if n > 1 << 20 or len(held) >= 4096:
                            yield _rows(held, ids)
                            held, n = [], 0
                    if held:
                        yield _rows(held, ids)

    return files.mapInArrow(run, out)


def _rows(held: list, ids: bool) -> pa.RecordBatch:
    cols = list(zip(*held, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int32()))] if ids else [])
    return pa.RecordBatch.from_arrays(arrays, names=READ.names[: len(arrays)])


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write to a fresh folder of the shared one and read the facts back."""
    return read(write(df, tokenizer_path, end_id, fresh(df.sparkSession, "tokens")), ids=False)
