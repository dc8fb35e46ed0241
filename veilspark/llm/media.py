"""Media columns with content-defined chunks.

A payload is stored as 8-bit mono samples (WAVE). A rolling gear hash cuts it into
chunks by content, so edits move few cuts. Chunks that occur more than once are
found by a join of digests alone; the first owner's row gives their bytes, all
other rows refer to them. A row keeps its private chunks in one compressed
segment with a digest of its own. Reading back fetches referred chunks by digest, verifies them, and
rebuilds the media from its ordered chunk list.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.work import keep
from veilspark.llm.words import mix

ALIGN, LEAST, USUAL_BITS, MOST = 64, 512, 12, 32_768
RATE = 8000
LEVEL = 9
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

_REF = pa.struct([("digest", pa.binary()), ("size", pa.int32())])
_GIVE = pa.struct([("digest", pa.binary()), ("z", pa.binary())])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, padded with zeros to a positive multiple of ALIGN, and their number unpadded."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0")


def wave(payload: bytes) -> bytes:
    """The payload as samples of an 8-bit mono WAVE file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    size = struct.unpack_from("<I", media, 40)[0]
    return media[44 : 44 + size]


def cuts(payload: bytes) -> list[int]:
    """Ends of chunks. The gear hash at a byte sums the last 32 bytes' gears, each
    shifted by its distance; doubling the span builds it for all bytes at once."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        h[span:] = h[span:] + (h[:-span] << np.uint32(span)) if len(h) > span else h[span:]
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - USUAL_BITS) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while len(payload) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(payload):
        ends.append(len(payload))
    return ends


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[digest(c) for c in chunks(payload_of(t.as_py())[1])] for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(rows, pa.list_(pa.binary()))], names=["k", "digests"])


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        z = [press.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("doc_id"), pa.array(z, pa.binary())], names=["k", "doc_id", "z"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    for b in batches:
        sizes, lists, own, seals, gives = [], [], [], [], []
        for z, marks in zip(b.column("z"), b.column("marks")):
            n, payload = payload_of(unpack.decompress(z.as_py()).decode("utf-8", "surrogatepass"))
            known = {m["digest"]: m["mine"] for m in marks.as_py() or []}
            order, private, given = [], [], {}
            for c in chunks(payload):
                d = digest(c) if known else None
                if d in known:
                    order.append({"digest": d, "size": len(c)})
                    if known[d] and d not in given:
                        given[d] = press.compress(c)
                else:
                    order.append({"digest": None, "size": len(c)})
                    private.append(c)
            sizes.append(n)
            lists.append(order)
            mine = b"".join(private)
            own.append(press.compress(mine))
            seals.append(digest(mine))
            gives.append([{"digest": d, "z": c} for d, c in given.items()])
        yield pa.RecordBatch.from_arrays(
            [b.column("k"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(_REF)), pa.array(own, pa.binary()), pa.array(seals, pa.binary()), pa.array(gives, pa.list_(_GIVE))],
            names=["k", "doc_id", "n_bytes", "chunks", "own", "seal", "gives"],
        )


def feature(payload: bytes) -> str:
    """Mean, root mean square about it, and crossings of the mean of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    centred = x - x.mean()
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    return f"{x.mean():.6f}:{np.sqrt((centred**2).mean()):.6f}:{crossings}"


def rebuild(order: list[dict], own: bytes, seal: bytes, fetched: dict[bytes, bytes]) -> bytes:
    """Samples from an ordered chunk list; a shared chunk or private segment that is missing or altered raises."""
    if digest(own) != seal:
        raise ValueError("a private segment does not have its digest")
    parts, at = [], 0
    for c in order:
        if c["digest"] is None:
            parts.append(own[at : at + c["size"]])
            at += c["size"]
        else:
            part = fetched[c["digest"]]
            if digest(part) != c["digest"]:
                raise ValueError("a stored chunk does not have its digest")
            parts.append(part)
    return b"".join(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            fetched = {f["digest"]: unpack.decompress(f["z"]) for f in b.column("fetched")[i].as_py() or []}
            media = wave(rebuild(b.column("chunks")[i].as_py(), unpack.decompress(b.column("own")[i].as_py()), b.column("seal")[i].as_py(), fetched))
            p = samples(media)
            rows.append((b.column("doc_id")[i].as_py(), b.column("n_bytes")[i].as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def store(docs: DataFrame) -> DataFrame:
    """The media table: per row the ordered chunk list, the private segment and the shared chunks it gives."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    lists = keep(texts.mapInArrow(_digests, "k long, digests array<binary>"), "digests")
    each = lists.select("k", F.explode("digests").alias("digest"))
    shared = each.groupBy("digest").agg(F.min("k").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    marks = each.join(shared, "digest").groupBy("k").agg(F.collect_set(F.struct("digest", (F.col("k") == F.col("owner")).alias("mine"))).alias("marks"))
    packed = texts.mapInArrow(_press, "k long, doc_id long, z binary")
    return keep(
        packed.join(marks, "k", "left").select("k", "doc_id", "z", "marks").mapInArrow(_segments, "k long, doc_id long, n_bytes long, chunks array<struct<digest: binary, size: int>>, own binary, seal binary, gives array<struct<digest: binary, z: binary>>"),
        "media",
    )


def read_back(media: DataFrame) -> DataFrame:
    """What the stored bytes say, a row for each row of the media table."""
    given = media.select(F.explode("gives").alias("g")).select("g.digest", "g.z").groupBy("digest").agg(F.first("z").alias("z"))
    refers = F.exists("chunks", lambda c: c["digest"].isNotNull())
    wanted = media.where(refers).select("k", F.explode("chunks.digest").alias("digest")).where("digest is not null").distinct()
    fetched = wanted.join(given, "digest").groupBy("k").agg(F.collect_list(F.struct("digest", "z")).alias("fetched"))
    rows = media.select("k", "doc_id", "n_bytes", "chunks", "own", "seal")
    alone = rows.where(~refers).withColumn("fetched", F.lit(None).cast("array<struct<digest: binary, z: binary>>"))
    mixed = rows.where(refers).join(fetched, "k")
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return alone.unionByName(mixed).select("doc_id", "n_bytes", "chunks", "own", "seal", "fetched").mapInArrow(_read, ddl)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every whole text as media, read it back and describe it.

    Null counts as empty; an empty text is 64 zero samples. Equal texts give equal
    values. Repeated rows and null ids are stored as they come; an empty table
    gives an empty result; other columns are ignored.
    """
    return read_back(store(docs))
