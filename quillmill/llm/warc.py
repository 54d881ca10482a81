"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page id into shards whose borders come from the data alone; each shard
is written as a stream of gzip members, and a new file is begun when the compressed size reaches
the limit. Headers (lengths, record ids, digests) are made anew from the payload. Files get
temporary names, and are renamed after the manifest that lists them is safe.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is
the response and the others are revisits that name it. The group of each payload is found by
aggregating digests, which combines on the map side, and a group that many pages share is broadcast to
its rows, so a payload that a third of all pages share moves a row for each task. Payloads move once, for the range sort; the decisions travel as rows of
their own and are merged into the sorted stream just before the records they are for.

Defined results: null html is the empty payload; an empty payload counts as a payload. Null page ids
sort before all others and never are a response while an equal payload has an id; of rows with equal
id and payload the first written is the response and the rest are revisits to the same id. Repeated
ids with different payloads are records of their own. An empty table gives no files. Line breaks in
urls are percent-encoded; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import shards
from quillmill.llm.common import filesystem, fresh, written

DATE = "1970-01-01T00:00:00Z"  # input has no times; a fixed one keeps files equal between runs
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{payload_digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed. A revisit holds no payload; its length is in its headers."""
    sha = digest(payload)
    url = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url or "")
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    block = "\r\n".join(head).encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id, sha)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to, sha)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class RollingWriter:
    """Gzip members into files of at most about ``roll_bytes`` compressed bytes."""

    def __init__(self, folder: str, roll_bytes: int):
        self.files, self.roll_bytes = shards.Files(folder, ".warc.gz"), roll_bytes
        self.stream, self.shard, self.number = None, None, 0
        self.rows = self.units = self.size = 0

    def _put(self, data: bytes) -> None:
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = member.compress(data) + member.flush()
        self.stream.write(data)
        self.size += len(data)

    def add(self, shard: int, data: bytes) -> None:
        if self.stream is not None and (shard != self.shard or self.size >= self.roll_bytes):
            self.close()
        if self.stream is None:
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard = shard
            self.stream = self.files.open(shard, self.number)
            info = f"software: quillmill\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\nfile: {self.number}\r\n".encode()
            self._put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{shard}:{self.number}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
        self._put(data)
        self.rows += 1
        self.units += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.files.done(self.rows, self.units, self.size)
            self.stream, self.rows, self.units, self.size = None, 0, 0, 0


#: Payload groups that may be broadcast; a group larger than its share of all rows is one of at most so many.
HOT_GROUPS = 10_000


def _decisions(slim: DataFrame) -> DataFrame:
    """id, sha and keep (the largest id of the payload) of all rows whose payload occurs more than once.

    Groups with more than a ten-thousandth of all rows, of which there can't be more than ten thousand, are
    broadcast to where their rows are; the others, each of which is small, are joined by a shuffle.
    """
    groups = written(slim.groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    rows = groups.agg(F.sum("copies")).first()[0] or 0
    large = max(1000, -(-rows // HOT_GROUPS))
    hot, rest = groups.where(F.col("copies") > large).drop("copies"), groups.where(F.col("copies") <= large).drop("copies")
    near = slim.join(F.broadcast(hot), "sha").select("id", "sha", "keep")
    far = slim.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(rest.hint("merge"), "sha").select("id", "sha", "keep")
    return near.unionByName(far).groupBy("id", "sha").agg(F.first("keep").alias("keep"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, roll_bytes: int = 64 << 20, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives to ``folder``; returns the manifest."""
    source = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    slim = written(source.select("id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").alias("n")), "payloads")
    decisions = _decisions(slim.where(F.col("n") >= min_bytes).select("id", "sha"))
    both = source.select("id", "url", "html", F.lit(None).cast("binary").alias("sha"), F.lit(None).cast("long").alias("keep"), F.lit(1).alias("kind")).unionByName(
        decisions.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "keep", F.lit(0).alias("kind"))
    )
    # the borders come from the slim table; the same expression is put on the rows
    shard, n = shards.borders(slim, "id", F.col("n") + 256, shard_bytes)
    both = both.withColumn("shard", shard)
    dealt = shards.dealt(both, n, F.col("id").asc_nulls_first(), "kind", "html", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, keep, done = RollingWriter(folder, roll_bytes), (), {}, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for shard, i, u, h, sha, k, kind in zip(*(part.column(c).to_pylist() for c in ("shard", "id", "url", "html", "sha", "keep", "kind")), strict=True):
                    if now != (i,):
                        now, keep, done = (i,), {}, set()
                    if kind == 0:
                        keep[sha] = k
                        continue
                    payload = h.encode("utf-8", "surrogatepass")
                    key = hashlib.sha1(payload).digest()
                    revisit = key in keep and (keep[key] != i or key in done)
                    done.add(key)
                    out.add(shard, record(i, u, payload, keep.get(key), revisit))
        out.close()
        if out.files.rows:
            yield out.files.batch()

    return shards.commit(dealt.mapInArrow(run, shards.MANIFEST), folder)


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream; digests of blocks are checked."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each response or revisit of the manifest's files."""
    out = RECORD if payloads else T.StructType(RECORD.fields[:-1])
    names = out.names
    count = max(1, manifest.count())
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = filesystem(path)
                with fs.open_input_stream(place, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    held, size = [], 0
                    for h, block in records(stream):
                        if h["WARC-Type"] not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (len(body) != length or digest(body) != sha):
                            raise ValueError(f"damaged payload of {h['WARC-Record-ID']}")
                        i, r = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        held.append((None if i is None else int(i), length, sha, h["WARC-Type"], None if r is None else int(r), h["WARC-Target-URI"], body)[: len(names)])
                        size += len(body)
                        if len(held) >= 2048 or size > 16 << 20:
                            yield rows(held)
                            held, size = [], 0
                    if held:
                        yield rows(held)

    return manifest.select("path").repartition(count).mapInArrow(run, out)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write to a fresh folder of the shared one and read the records back, without payloads."""
    return read(write(pages, fresh(pages.sparkSession, "warc"), **options), payloads=False)
