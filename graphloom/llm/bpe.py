"""Byte-pair encoding with reuse of content-defined chunks, and decoding.

* Texts are cut where a rolling hash of the last 16 bytes meets a pattern (1 KiB apart on average), so a passage is cut
  alike wherever it stands. Only digests of chunks are shuffled; those that more than one row holds are *shared*.
* The owner of a shared chunk, the smallest holder, encodes it once; every holder receives its ids. A text's stretches
  between shared chunks are encoded with it. Bounded bitmaps of owners and holders preselect the texts that are shuffled
  for this (a false hit only costs its row); a text without shared chunks is encoded where it is read.
* Joins are repaired: a window from a boundary in the left ids to one in the right ids is encoded again and put
  between. A space or line feed after a character that is no white space always starts a new pre-token, whatever
  surrounds it, so a window between two such places agrees with the encoding of the whole text; the repair goes on to
  the next place until both sides also have a token bound exactly there.

Encoding is the library's own for the given file, added tokens included, without special tokens, truncation or padding.
Decoding joins the bytes of the tokens and reads them as UTF-8 with U+FFFD for invalid ones, as the byte-level decoder does.

Defined results: a null text is encoded as the empty one; rows that repeat an id are encoded each for itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import bitmap, cut, in_bitmap

MASK_BITS, ROLL = 10, 16
LEAST_CHUNK = 64
_SAFE = re.compile(rb"(?<=[A-Za-z0-9.,;:!?)\"'])(?=[ \n])")
_RARE = re.compile(rb"[\xc9-\xff]")
#: How a byte-level vocabulary of this family splits text before merging. Fixed value.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TABLE = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_CODERS: dict[str, Coder] = {}


class Coder:
    """One tokenizer file in one process: ids of texts, and the bytes of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in _byte_letters().items()}
        self.bytes = [b""] * (max(names) + 1)
        for i, t in names.items():
            self.bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.plain = self._plain(spec)

    def _plain(self, spec: dict):
        """A faster coder of the same vocabulary for texts without rare letters, if the file is of the kind it knows."""
        levels, model, added = spec["pre_tokenizer"], spec["model"], spec["added_tokens"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if (not levels or levels["type"] != "ByteLevel" or levels["add_prefix_space"] or not levels.get("use_regex", True) or spec["normalizer"]
                or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or merged != sorted(merged)):
            return None
        import tiktoken

        special = {t["content"]: t["id"] for t in added}
        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The library's ids. Texts of letters below U+0240, on whose classes all Unicode versions agree, take the faster way."""
        out = [None if self.plain is None or _RARE.search(t) else self._faster(t.decode()) for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        found = self.tokenizer.encode_batch_fast([texts[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def _faster(self, text: str) -> np.ndarray | None:
        """The faster coder's ids; none for a text that it refuses, as one with a run of a million spaces."""
        try:
            return self.plain.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return None

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk ends of each text within ``data``, the text's own end last; never inside a character."""
    n = int(offsets[-1])
    h = _TABLE[data[:n]]
    span = 1
    while span < ROLL:
        far = h[:-span] * np.uint32(pow(0x9E3779B1, span, 1 << 32))
        h = h.copy()
        h[span:] += far
        span *= 2
    hit = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    for _ in range(3):
        hit = np.where((data[hit] & 0xC0) == 0x80, hit + 1, hit)
    hit = np.unique(hit)
    edges = np.searchsorted(hit, offsets)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        own, last = [], a
        for x in hit[edges[i]:edges[i + 1]].tolist():
            if x - last >= LEAST_CHUNK and b - x >= LEAST_CHUNK:
                own.append(x)
                last = x
        out.append(np.array([*own, b], np.int64))
    return out


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.pieces(batches, "text"):
        data, offsets = W.text_bytes(part.column("text"))
        raw, digests, owners, places = memoryview(data), [], [], []
        for i, ends in enumerate(cuts(data, offsets)):
            a = int(offsets[i])
            for k, b in enumerate(ends.tolist()):
                if b > a:
                    digests.append(_digest(raw[a:b]))
                    owners.append(i)
                    places.append(k)
                a = b
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column("key").take(pa.array(owners, pa.int64())),
                                          pa.array(places, pa.int32())], ["digest", "key", "at"])


def _chosen(held, wanted: bool):
    """Rows whose key is (or is not) in the broadcast bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(held.value, batch.column("spot").to_numpy()) == wanted))

    return run


def _padded(text: bytes) -> np.ndarray:
    data = np.zeros(len(text) + 8, np.uint8)
    data[:-8] = np.frombuffer(text, np.uint8)
    return data


def _encode_owned(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for part in W.unpacked(batches):
            digests, ids = [], []
            for text, at in zip(part.column("text").to_pylist(), part.column("owned").to_pylist(), strict=True):
                text = text.encode()
                ends = cuts(_padded(text), np.array([0, len(text)]))[0]
                begins = np.r_[0, ends[:-1]]
                own = [text[begins[k]:ends[k]] for k in at]
                digests += [_digest(x) for x in own]
                ids += [x.tobytes() for x in c.encode(own)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.binary())], ["digest", "ids"])

    return run


def assemble(c: Coder, text: bytes, given: dict[int, np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Ids of ``text``, of whose chunks (ending at ``ends``) some are encoded already: ``given`` by chunk number."""
    if not given:
        return c.encode([text])[0]
    spans, a, k = [], 0, 0
    while k < len(ends):
        j = k + 1
        if k not in given:
            while j < len(ends) and j not in given:
                j += 1
        spans.append((a, int(ends[j - 1]), given.get(k)))
        a, k = int(ends[j - 1]), j
    todo = iter(c.encode([text[x:y] for x, y, ids in spans if ids is None]))
    spans = [(x, y, next(todo) if ids is None else ids) for x, y, ids in spans]
    done: list[np.ndarray] = []  # settled ids of text[:reach]
    open_ids, open_from, reach = spans[0][2], 0, spans[0][1]
    for x, y, ids in spans[1:]:
        left, right = np.r_[0, np.cumsum(c.length[open_ids])] + open_from, np.r_[0, np.cumsum(c.length[ids])] + x
        p, i = _bound(text, left, max(open_from, x - 256), x, True) or _bound(text, left, open_from, x, True) or (open_from, 0)
        if i == 0 and open_from and p == open_from:
            open_ids, done = np.concatenate([*done, open_ids]), []
            open_from = 0
            left = np.r_[0, np.cumsum(c.length[open_ids])]
            p, i = _bound(text, left, 0, x, True) or (0, 0)
        q, j = _bound(text, right, x, min(y, x + 256), False) or _bound(text, right, x, y, False) or (y, len(ids))
        done += [open_ids[:i], c.encode([text[p:q]])[0]]
        open_ids, open_from, reach = ids[j:], q, y
    return np.concatenate([*done, open_ids])


def _bound(text: bytes, bounds: np.ndarray, a: int, b: int, last: bool) -> tuple[int, int] | None:
    """The last or first place in ``[a, b]`` where a pre-token always starts and the ids have a bound, with its number."""
    places = [m.start() for m in _SAFE.finditer(text, max(0, a), min(len(text), b + 1)) if a <= m.start() <= b and m.start() > 0]
    for p in reversed(places) if last else places:
        i = int(np.searchsorted(bounds, p))
        if i < len(bounds) and bounds[i] == p:
            return p, i
    return None


def _finish(path: str, keep_ids: bool, parts):
    """Ids and digests of the texts in the slices that ``parts`` makes of the batches; ``given`` holds ready chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for part in parts(batches):
            n, sha, back, kept = [], [], [], []
            ready = part.column("given").to_pylist() if "given" in part.schema.names else [None] * part.num_rows
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            plain = iter(c.encode([t for t, given in zip(texts, ready, strict=True) if not given]))
            for text, given in zip(texts, ready, strict=True):
                if given:
                    ends = cuts(_padded(text), np.array([0, len(text)]))[0]
                    ids = assemble(c, text, {g["at"]: np.frombuffer(g["ids"], np.uint32) for g in given}, ends)
                else:
                    ids = next(plain)
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
            arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])``, one row per row.

    ``path`` names the tokenizer file, at the same place on every executor.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text).cast("binary"))).alias("key"), text.alias("text"))
    chunks = cut(rows.mapInArrow(_list_chunks, "digest binary, key binary, at int"))
    shared = cut(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("owner"))
                 .filter("n > 1").select("digest", "owner"))
    holders = cut(chunks.join(shared, "digest").select("digest", "key", "at", (F.struct("key", "at") == F.col("owner")).alias("own")))
    owners = cut(holders.filter("own").groupBy("key").agg(F.collect_list("at").alias("owned")))
    spots = rows.withColumn("spot", F.xxhash64("key"))
    owning, holding = (spots.sparkSession.sparkContext.broadcast(bitmap(x.select("key").distinct(), "key")) for x in (owners, holders))

    def packed(held) -> DataFrame:
        return spots.mapInArrow(_chosen(held, True), spots.schema).drop("spot").mapInArrow(W.pack, "doc_id long, key binary, packed binary")

    coded = cut(packed(owning).join(owners, "key").mapInArrow(_encode_owned(path), "digest binary, ids binary").dropDuplicates(["digest"]))
    given = holders.join(coded, "digest").groupBy("key").agg(F.collect_list(F.struct("at", "ids")).alias("given"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids
    repaired = packed(holding).join(given, "key", "left").mapInArrow(_finish(path, keep_ids, W.unpacked), schema)
    alone = spots.mapInArrow(_chosen(holding, False), spots.schema).mapInArrow(
        _finish(path, keep_ids, lambda batches: W.pieces(batches, "text", 1 << 20)), schema)
    return alone.unionByName(repaired)


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array([i for i in x if i is not None], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` -> ``(doc_id, text)``; null ids give a null text, null elements are passed over."""
    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_decode_rows(path), "doc_id long, text string")
