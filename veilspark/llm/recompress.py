"""Substring de-duplication by recompression.

Words get global names (hashes). Rounds of recompression then shorten each
document: runs of one symbol become one named symbol, and after a fixed coin
toss per symbol every neighbouring (tails, heads) pair becomes one. A name
depends only on the words it stands for, so equal passages get equal symbols
inside. Each symbol carries the extent of words that fixed it: within any window
that holds the extent, the same symbol arises in every document.

So two equal windows share the symbols whose extents they hold. Each window takes
as anchor one short phrase of such symbols, of the highest round that offers one,
by a rule that looks at the window alone. Anchors of one document only prove their windows
unrepeated; for the others the windows themselves are compared, by 128 bits of their words.
A name is a function of the words below it, so it is the same in every task without a table
of names: such a table would shuffle every symbol in every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.work import drop, join_counted, keep
from veilspark.llm.words import mix, split_words, windows, word_ids

ROUNDS, PHRASE = 4, 3
#: A window is named by 128 bits: two hashes of its words with different bases.
BASES = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)


def recompress(ids: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols after each round as (name, start, lo, hi): a symbol starts at word
    ``start`` and words lo..hi-1 fix it. lo is -1 or hi is len(ids) + 1 where the
    document's edge had a say, which no window holds."""
    n = len(ids)
    name, start = ids, np.arange(n)
    lo, hi = start.copy(), start + 1
    out = [(name, start, lo, hi)]
    for r in range(1, rounds + 1):
        # runs: fixed by the differing neighbours on both sides
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(name)))
        last = first + size - 1
        before = np.where(first > 0, lo[np.maximum(first - 1, 0)], -1)
        after = np.where(last < len(name) - 1, hi[np.minimum(last + 1, len(name) - 1)], n + 1) if len(name) else last
        many = size > 1
        with np.errstate(over="ignore"):
            run = mix(name[first] ^ mix(size.astype(np.uint64) * np.uint64(2 * r + 1)))
        name, start = np.where(many, run, name[first]), start[first]
        lo = np.where(many, np.minimum(before, lo[first]), lo[first])
        hi = np.where(many, np.maximum(after, hi[last]), hi[last])
        lo, hi = np.minimum(lo, before), np.maximum(hi, after)
        # pairs: a symbol that tosses 0 takes a right neighbour that tosses 1
        k = len(name)
        coin = (mix(name ^ np.uint64(r)) & np.uint64(1)).astype(bool)
        pair = np.zeros(k, bool)
        pair[:-1] = ~coin[:-1] & coin[1:]
        taken = np.zeros(k, bool)
        taken[1:] = pair[:-1]
        head = np.flatnonzero(~taken)
        joined = pair[head]
        nxt, prv = np.minimum(head + 1, k - 1), np.maximum(head - 1, 0)
        with np.errstate(over="ignore"):
            both = mix(mix(name[head]) * np.uint64(3) + name[nxt] + np.uint64(r))
        right = np.where(head + 1 < k, hi[nxt], n + 1)
        left = np.where(head > 0, lo[prv], -1)
        alone = ~joined
        new_lo = np.where(alone & coin[head], np.minimum(left, lo[head]), lo[head])
        new_hi = np.where(joined, np.maximum(hi[nxt], hi[head]), np.where(alone & ~coin[head], np.maximum(right, hi[head]), hi[head]))
        name, start, lo, hi = np.where(joined, both, name[head]), start[head], new_lo, new_hi
        out.append((name, start, lo, hi))
    return out


def anchors(ids: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` words, by start: its anchor's name.

    Phrases are PHRASE symbols in a row. Of those whose extents a window holds, it
    takes one of the highest round, the one with the least scrambled name. Extents
    move right with their symbols, so a window holds a range of them and the least
    comes from two overlapping power-of-two ranges. Single symbols of the rounds
    used here are a few words long and recur by chance; phrases hardly do.
    """
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, todo = np.zeros(n, np.uint64), np.arange(n)
    for r, (sym, _, lo, hi) in reversed(list(enumerate(recompress(ids)))):
        if len(sym) < PHRASE:
            continue
        sym, lo, hi = windows(sym, PHRASE), lo[: len(sym) - PHRASE + 1], hi[PHRASE - 1 :]
        first, stop = np.searchsorted(lo, todo), np.searchsorted(hi, todo + width, side="right")
        size = stop - first
        have = size > 0
        if have.any():
            rank = mix(sym ^ np.uint64(r))
            at, first, stop = todo[have], first[have], stop[have]
            step = np.frexp(size[have])[1] - 1
            for k in range(int(step.max()) + 1):
                now = step == k
                out[at[now]] = np.minimum(rank[first[now]], rank[stop[now] - (1 << k)])
                rank = np.minimum(rank, np.append(rank[1 << k :], np.full(min(1 << k, len(rank)), rank[-1])))
        todo = todo[~have]
        if not len(todo):
            break
    return out


def batch_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word names of documents laid end to end, each followed by a separator, and
    where each starts. No window that counts holds a separator, so a separator's
    effect on symbols stays outside of what such a window can see."""
    sizes = np.array([len(w) + 1 for w in texts])
    start = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), np.uint64)
    inside = np.ones(len(ids), bool)
    inside[start + sizes - 1] = False
    ids[inside] = word_ids([w for d in texts for w in d])
    ids[~inside] = mix(np.arange(len(texts), dtype=np.uint64))
    return ids, start


def _groups(sizes: list[int], most: int = 200_000) -> Iterator[slice]:
    """Slices of consecutive documents of about ``most`` bytes together."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(width: int):
    """doc_id, text to doc_id, n_words, sha and distinct anchors of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, shas, found = b.column("text"), [], [], []
            for part in _groups([len(t.as_py() or "") for t in texts]):
                words = [split_words(t.as_py()) for t in texts[part]]
                ids, start = batch_ids(words)
                anchor = anchors(ids, width).view(np.int64)
                counts += map(len, words)
                shas += map(_sha, words)
                found += [np.unique(anchor[s : s + max(0, len(w) - width + 1)]) for s, w in zip(start.tolist(), words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n_words", "sha", "anchors"])

    return run


def _windows(width: int):
    """doc_id, z and shared anchors of the document to the windows under them: two hashes and start of each.
    A start carries a tag of its text, as several may have one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            packed, marks = b.column("z"), b.column("marks")
            out: list[list] = [[], [], []]
            for part in _groups([4 * len(z.as_py()) for z in packed]):
                words = [unpack.decompress(z.as_py()).split() for z in packed[part]]
                ids, start = batch_ids(words)
                anchor = anchors(ids, width).view(np.int64)
                names = [windows(ids, width, base).view(np.int64) for base in BASES]
                for s, w, own in zip(start.tolist(), words, marks[part]):
                    n = max(0, len(w) - width + 1)
                    at = np.flatnonzero(np.isin(anchor[s : s + n], own.values.to_numpy(zero_copy_only=False)))
                    for column, name in zip(out, names):
                        column.append(name[s : s + n][at])
                    out[2].append(at | text_tag(w))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.list_(pa.int64())) for x in out]], names=["doc_id", "h", "g", "p"])

    return run


def text_tag(words: list[bytes]) -> int:
    """31 bits of a text, above the 32 bits of a word's place."""
    return (xxhash.xxh32_intdigest(b" ".join(words)) >> 1) << 32


def _cut(width: int):
    """doc_id, text, starts of repeated windows to n_removed, the hashes of its words and of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            gone, before, sha, kept = [], [], [], []
            for z, starts in zip(b.column("z"), b.column("starts")):
                words = unpack.decompress(z.as_py()).split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                at = at[at >> 32 == text_tag(words) >> 32] & 0xFFFFFFFF
                edge[at] += 1
                edge[at + width] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                left = [w for w, s in zip(words, stay.tolist()) if s]
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
                before.append(_sha(words))
                sha.append(_sha(left))
            columns = [b.column("doc_id"), pa.array(gone, pa.int64()), *[pa.array(x, pa.string()) for x in (before, sha, kept)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_removed", "sha", "cut_sha", "kept_text"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        z = [press.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(z, pa.binary())], names=["doc_id", "z"])


def cut_repeats(docs: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame]:
    """(all, cut). ``all`` has doc_id, n_words, sha of the words of every
    document; ``cut`` has doc_id, n_removed, sha, cut_sha, kept_text of documents
    that lose words: those inside a window of ``width`` words that also starts in
    a document with a smaller doc_id, all windows being judged on the input.

    Null and empty texts have no words. Rows with a null doc_id provide and lose
    nothing. Rows that repeat a doc_id are one document with several texts: each
    provides windows for it, each is cut by smaller ids, and ``all`` has a row
    for each, ``cut`` one for each distinct text. Other columns are ignored. An
    empty table gives empty results.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    seen = keep(texts.mapInArrow(_scan(width), "doc_id long, n_words long, sha string, anchors array<long>"), "symbols")
    posts = seen.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = posts.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("anchor", "c")
    shared = keep(shared, "anchors")
    hot = F.col("c") > max(1000, (shared.agg(F.sum("c")).first()[0] or 0) // 4096)
    own = lambda which: F.collect_set(F.when(which, F.col("anchor")))
    marked = join_counted(posts, shared, "anchor").groupBy("doc_id").agg(own(~hot).alias("cold"), own(hot).alias("hot"))
    packed = texts.mapInArrow(_pack, "doc_id long, z binary")
    found = keep(packed.join(marked, "doc_id"), "shared-texts")
    drop(shared)

    def rows(which: str) -> DataFrame:
        own = found.where(F.size(which) > 0).select("doc_id", "z", F.col(which).alias("marks"))
        made = own.mapInArrow(_windows(width), "doc_id long, h array<long>, g array<long>, p array<long>")
        return made.select("doc_id", F.explode(F.arrays_zip("h", "g", "p")).alias("w")).select("doc_id", "w.h", "w.g", "w.p")

    # a window's smallest document: one sorted pass where anchors are rare, counts first where windows may be very common
    first = F.min("doc_id").over(Window.partitionBy("h", "g").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    repeated = rows("cold").withColumn("lo", first).where("doc_id > lo").select("doc_id", "p")
    common = rows("hot")
    owners = keep(common.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("h", "g", "lo", "c"), "owners")
    repeated = repeated.unionByName(join_counted(common, owners, ["h", "g"]).where("doc_id > lo").select("doc_id", "p"))
    starts = repeated.groupBy("doc_id").agg(F.collect_list("p").alias("starts"))
    cut = found.select("doc_id", "z").join(starts, "doc_id").mapInArrow(_cut(width), "doc_id long, n_removed long, sha string, cut_sha string, kept_text string")
    return seen.drop("anchors"), cut.dropDuplicates(["doc_id", "sha"])


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs; see cut_repeats."""
    every, cut = cut_repeats(docs, width)
    joined = every.join(cut.drop("kept_text"), ["doc_id", "sha"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))
