"""Best-fit packing by the sum-of-squares rule.

Every document becomes its token ids plus an end id; only documents longer than
a sequence are cut, into whole-sequence pieces preceded by one shorter piece.
Pieces are dealt into shards of bounded expected size by a hash of the document
and each shard is packed on its own: taking pieces from long to short, a piece
goes where the sum, over residual gaps, of the squared number of open bins with
that gap becomes smallest. A new bin is opened only when no open one has room:
from long to short that packed 1.0002 times the bound on the test documents,
while letting a new bin compete on the sum packed 1.005 times. A shard ends with a handful of
open bins, so the loss against one global packing is a few sequences per shard.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.work import arrow_rows, keep

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CACHE = 1_000_000


class _Cut(Exception):
    """A unit that cannot be encoded apart from its neighbours."""


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the rest as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitEncoder(dict):
    """Token ids, as little-endian uint32 bytes, of whole texts.

    The vocabulary's splitting rule never joins a non-space character with a
    following space, so a text can be cut before each space that follows a
    non-space and its units encoded apart. The mapping remembers units (at most
    CACHE of them); new ones go through the same vocabulary in tiktoken, which
    applies the same merges (a merge's rank is its token's id) without the cost of
    a tokenizers call. A text where white space runs meet a cut, or that may hold
    a special token, is encoded whole by tokenizers.
    """

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte = _byte_alphabet()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        encoding = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.units, self.single = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self.marks = {m: array("I", self.units(m)).tobytes() for m in ".,"}

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit[-1].isspace() or "<|" in unit:
            raise _Cut
        if len(self) >= CACHE:
            self.clear()
        mark = self.marks.get(unit[-1])
        word = unit[:-1] if mark else unit
        if word.isalpha():  # letters are one piece, so the splitting pattern need not run
            out = array("I", self.single(b" " + word.encode())).tobytes() + (mark or b"")
        else:
            out = array("I", self.units(" " + unit)).tobytes()
        self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        head, *units = text.split(" ")
        try:
            if not head or head[-1].isspace():
                raise _Cut
            return self.encode(head) + b"".join(map(self.__getitem__, units))
        except _Cut:
            return self.encode(text)


def pieces_of(path: str, end_id: int = 2, size: int = 1024):
    """Row maker: (doc_id, text) to the document's pieces."""

    def setup():
        encode = UnitEncoder(path)
        end = array("I", [end_id]).tobytes()

        def each(doc_id: int, text: str | None) -> Iterator[tuple]:
            raw = encode(text) + end
            total = len(raw) // 4
            first = total % size or size if total > size else total
            for piece, stop in enumerate(range(first, total + 1, size)):
                start = 0 if piece == 0 else stop - size
                yield doc_id, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])

        return each

    setup.setup = setup
    return setup


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the order given.

    open_[g] counts open bins with gap g. Moving a bin from gap g to g - n
    changes the sum of squares by 2 * (open_[g - n] - open_[g]) + 2, and a full
    bin leaves the sum. Ties go to the smallest gap.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_ = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    never, made = np.iinfo(np.int64).max, 0
    for i, n in enumerate(lengths.tolist()):
        gap = size
        if n < size:
            have = open_[n:size]
            change = np.where(have > 0, 2 * (open_[: size - n] - have) + 2, never)
            change[0] = -2 * have[0] + 1 if have[0] else never
            best = int(change.argmin())
            if have[best]:
                gap = n + best
        if gap == size:
            b, made = made, made + 1
        else:
            b = stacks[gap].pop()
            open_[gap] -= 1
        bins[i], offsets[i] = b, size - gap
        if left := gap - n:
            stacks[left].append(b)
            open_[left] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, shard_pieces: int = 60_000) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    Null or empty text is a document of the end id alone. An empty table gives
    an empty result. Repeated doc_ids are packed as documents of their own.
    Other columns are ignored. ``tokenizer`` is a tokenizers JSON file that
    every executor can read; ``shard_pieces`` bounds, in expectation, what one
    task holds.
    """
    rows = docs.select("doc_id", "text").mapInArrow(arrow_rows(pieces_of(tokenizer, end_id, size), PIECES, ["doc_id", "text"]), _ddl(PIECES))
    rows = keep(rows, "pieces")
    shards = max(1, -(-rows.count() // shard_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), size)
        return pdf.assign(sequence_id=bins * shards + pdf["shard"].iloc[0], offset=offsets).drop(columns="shard")

    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(place, _ddl(PIECES) + ", sequence_id long, offset long")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)
