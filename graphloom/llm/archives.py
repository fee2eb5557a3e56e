"""WARC archives: written as one gzip member per record, read back in byte ranges by Spark's own file splits.

The reader lets Spark cut files at any byte. The text source takes gzip's magic as its line separator, so each task
scans its range for the magic and owns what starts inside, reading past its end to finish the last piece. A piece
counts as a member only if its header is sound and its first bytes inflate to a WARC header. While a member is not
complete, further pieces belong to it, whatever they hold, so a magic inside compressed data is harmless; only pieces
that such a magic separates across two ranges are handed on, and joined per file afterwards.

The writer deduplicates payloads: of equal payloads of at least ``least`` bytes the one of the smallest page id is a
``response`` record, the others are ``revisit`` records that refer to it and hold no payload. Members are written by
Spark's text writer, whose separator is the zero byte that ends each member anyway (the highest byte of its length);
a record of 16 MiB or more, whose last byte is another, is followed by one byte of zero padding. Archives to be read
must not be named ``.gz``: Spark's text source would inflate them itself, whole.

Defined results: null html is an empty payload; a null url leaves the target out; a page without id is a ``response``;
rows that repeat the smallest page id of a payload are all ``response``. A damaged record stops the reader, and so does
an archive stored uncompressed inside a record if a range ends between the two's beginnings.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, shared_path
from .words import pieces

MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response or, if it refers to another page, a revisit record."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = b"\r\n".join(head) + b"\r\n\r\n" + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha1:{_sha1(payload)}",
             f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    text = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text) + squeeze.flush()


def parse(text: bytes) -> tuple:
    """The columns of one inflated record."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    number = lambda name: int(m) if (m := fields.get(name, "").rpartition(":")[2].rstrip(">")) else None
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest, size = fields["WARC-Payload-Digest"].partition(":")[2], int(fields["X-Payload-Length"])
    if payload is not None and (_sha1(payload), len(payload)) != (digest, size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("WARC-Refers-To"), size, digest, payload)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive ``pages(page_id, url, html)`` under ``path``."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("same", F.sha2(F.encode("html", "UTF-8"), 256))
    first = cut(p.filter(F.octet_length("html") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select("same", "first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            yield pa.RecordBatch.from_arrays([pa.array([_member(*x) for x in zip(
                *(part.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True)], pa.binary())], ["member"])

    p.join(first, "same", "left").select("page_id", "url", "html", "first").mapInArrow(build, "member binary").select(
        F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


def _member(page_id, url, html, first) -> bytes:
    m = record(page_id, url, html.encode(), None if page_id is None or first is None or first == page_id else first)
    return m[:-1] if m[-1:] == b"\0" else m


class _Range:
    """The pieces of one byte range in order: what they complete, and what has to be joined with other ranges."""

    def __init__(self):
        self.open = None
        self.raw = self.text = b""

    def feed(self, piece: bytes) -> tuple[bytes | None, list[bytes]]:
        """The record that the piece completes, if any, and pieces that turn out to begin no member.

        Until a member's first five bytes are inflated it is a candidate, which a piece that does not continue it ends.
        """
        loose = []
        fresh = zlib.decompressobj(31)
        try:
            text = fresh.decompress(piece)
            sound = _begins(text, fresh) and (piece[3:4] or b"\0")[0] & 0xE0 == 0
        except zlib.error:
            text, sound = b"", False
        if self.open is not None:
            sure, go_on = len(self.text) >= 5, self.open.copy()
            try:
                more = self.text + go_on.decompress(piece)
            except zlib.error:
                if sure:
                    raise ValueError("a member is damaged") from None
                more = None
            if sure or more is not None and _begins(more, go_on) and (len(more) >= 5 or not (sound and len(text) >= 5)):
                self.open, self.text, self.raw = go_on, more, self.raw + piece
                return self._complete(), loose
            loose, self.open = [self.raw], None
        if not sound:
            return None, [*loose, piece]
        self.open, self.raw, self.text = fresh, piece, text
        return self._complete(), loose

    def _complete(self) -> bytes | None:
        if not self.open.eof:
            return None
        text, self.open, self.raw, self.text = self.text, None, b"", b""
        return text


def _begins(text: bytes, inflate) -> bool:
    return b"WARC/".startswith(text[:5]) and not (inflate.eof and len(text) < 5)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, at, seq = None, None, 0
    for batch in batches:
        done, loose = [], []
        for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
            if (file, start) != here:
                if at is not None and at.open is not None:
                    loose.append((*here, seq, at.raw))
                here, at, seq = (file, start), _Range(), 0
                if start == 0:
                    continue  # what stands before the first magic of the file
            text, free = at.feed(MAGIC + value)
            if text is not None:
                done.append(parse(text))
            for raw in free:
                loose.append((*here, seq, raw))
                seq += 1
        yield _rows(done, loose)
    if at is not None and at.open is not None:
        yield _rows([], [(*here, seq, at.raw)])


_LOOSE = "file string, start long, seq long, raw binary"


def _rows(done: list[tuple], loose: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
             pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in (_SCHEMA + ", " + _LOOSE).split(", ")]
    rows = [(*d, None, None, None, None) for d in done] + [(*[None] * 7, *x) for x in loose]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _join_loose(rows: pd.DataFrame) -> pd.DataFrame:
    """Members of one file that a magic inside their data separated at the end of a range."""
    out, at = [], _Range()
    for r in rows.sort_values(["start", "seq"]).itertuples():
        text, _ = at.feed(r.raw)
        if text is not None:
            out.append(parse(text))
    if at.open is not None and len(at.text) >= 5:
        raise ValueError(f"the last member of {rows.file.iloc[0]} is damaged")
    return pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``; ``payload`` is null for revisits."""
    raw = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    rows = raw.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("start")).mapInArrow(_read, f"{_SCHEMA}, {_LOOSE}")
    columns = [x.split()[0] for x in _SCHEMA.split(", ")]
    joined = rows.filter("file is not null").select(*[x.split()[0] for x in _LOOSE.split(", ")]).groupBy("file").applyInPandas(_join_loose, _SCHEMA)
    return rows.filter("file is null").select(*columns).unionByName(joined)


def archive(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write(pages, path, least)
    return read(spark, path)
