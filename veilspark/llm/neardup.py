"""Near-duplicates by a signature-coordinate inverted join.

1. One pass makes each document's shingle set, a MinHash signature and a key of
   the set. Documents with equal sets become one class at once; from here on a
   class is its smallest doc_id.
2. Classes are posted under each (coordinate, value). Coordinates are ordered by
   how many classes share them; two classes that agree on at least MATCHES
   coordinates still agree on one after each skips its MATCHES - 1 commonest, so
   those are not posted. What a common passage puts into thousands of signatures
   falls away here.
3. Postings with the same members are merged. Members of a posting meet in one
   task, where collisions are counted: on how many coordinates two signatures
   agree. Pairs with MATCHES or more, and set sizes that allow the threshold, are
   retained. What leaves the task is not the pairs but the pieces they connect: a
   row for each member.
4. Full sets of a piece's members meet once, and retained pairs are confirmed in
   the order of their counts. A pair whose ends are connected by then is not
   needed, so a piece of m members yields m - 1 links at most.
5. A posting of more than BLOCK members is first dealt into blocks, by another
   hash in each posting. Only if its members are in several components after that
   do its blocks meet pairwise, and then only pairs of different components count.

With COORDS = 32 and MATCHES = 12 a pair at similarity 0.75 agrees on fewer than
MATCHES coordinates with probability below 1e-5 (binomial tail).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.graph import components
from veilspark.llm.work import by_group, drop, join_counted, keep
from veilspark.llm.words import mix, shingles

COORDS, MATCHES = 32, 12
BLOCK = 1024
MERGE = 64
#: Up to so many ids of texts to fetch (8 bytes each) are sent to every task; more are joined by a shuffle.
FEW = 1_000_000
_SALT = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64))
_XOR, _ODD = _SALT[:COORDS], _SALT[COORDS:] | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """Posting keys: coordinate and its minimum mixed to one signed 64-bit number."""
    low = np.fromiter((((s ^ x) * a).min() for x, a in zip(_XOR, _ODD)), np.uint64, COORDS)
    return mix(low ^ mix(_SALT[:COORDS])).view(np.int64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), key (a digest of the set) and signature of every row; wordless texts have n 0 and no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sig = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, key binary, sig array<long>")


def collisions(sig: np.ndarray) -> np.ndarray:
    """On how many coordinates each two rows of a signature matrix agree."""
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for column in sig.T:
        out += column[:, None] == column[None, :]
    return out


def retained(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> np.ndarray:
    """Collision counts of pairs that may link: MATCHES at least, set sizes near enough, different components; 0 elsewhere."""
    count = collisions(sig)
    near = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    return np.where((count >= MATCHES) & near & (comp[:, None] != comp[None, :]), count, 0)


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a small dense graph."""
    label = np.arange(len(adjacent))
    while True:
        near = np.where(adjacent, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pieces(percent: int):
    """A posting's members to (piece, doc_id, comp): the parts that retained pairs connect. Equal parts of several postings get one name."""

    def work(t: pa.Table):
        if len(t) < 2:
            return None
        ids, comp = t["doc_id"].to_numpy(), t["comp"].to_numpy()
        label = _labels(retained(_matrix(t["sig"]), t["n"].to_numpy(), comp, percent) > 0)
        order = np.lexsort((ids, label))
        ids, comp, label = ids[order], comp[order], label[order]
        names, members = [], []
        for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(label)) + 1):
            if len(part) > 1:
                name = xxhash.xxh3_64_intdigest(np.concatenate([ids[part], comp[part]]).tobytes())
                names.append(np.full(len(part), name, np.uint64).view(np.int64))
                members.append(part)
        if not members:
            return None
        at = np.concatenate(members)
        return [np.concatenate(names), ids[at], comp[at]]

    return work


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of each two of many sets: products of 0/1 columns, a slab of shared elements at a time."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    use = shared[column]
    row, column = row[use], (np.cumsum(shared) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        slab = np.zeros((len(sets), 4096), np.float32)
        slab[row[a:b], column[a:b] - start] = 1
        out += slab @ slab.T
    return out.astype(np.int64)


def _links(percent: int):
    """A piece's members with their full sets to confirmed links, as a forest over what ``comp`` connects already.

    Pairs are tried one by one while that succeeds; after many failures all intersections are computed together.
    """

    def work(t: pa.Table):
        ids, comp = t["doc_id"].to_numpy(), t["comp"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in t["s"].chunks for x in chunk]
        n = np.array([len(s) for s in sets])
        count = retained(_matrix(t["sig"]), n, comp, percent)
        _, first = np.unique(comp, return_inverse=True)
        root = list(range(first.max() + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = np.nonzero(np.triu(count, 1))
        order = np.argsort(-count[a, b].astype(int), kind="stable")
        a, b = a[order], b[order]
        group, out, inter, failed = first.tolist(), [], None, 0
        for at, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = find(group[i]), find(group[j])
            if x != y:
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * same >= percent * (n[i] + n[j] - same):
                    root[y] = x
                    out.append((i, j))
                else:
                    failed += 1
                    if failed > 200 + 4 * len(ids):
                        inter = overlaps(sets)
                        break
        if inter is not None:
            a, b = a[at:], b[at:]
            good = 100 * inter[a, b] >= percent * (n[a] + n[b] - inter[a, b])
            for i, j in zip(a[good].tolist(), b[good].tolist()):
                x, y = find(group[i]), find(group[j])
                if x != y:
                    root[y] = x
                    out.append((i, j))
        if not out:
            return None
        i, j = np.array(out).T
        return [ids[i], ids[j]]

    return work


def _postings(reps: DataFrame) -> DataFrame:
    """(k, doc_id, c): the postings classes do not skip, with two members at least; c is the number of members."""
    posted = reps.select("doc_id", F.explode("sig").alias("k"))
    shared = keep(posted.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), F.desc("k")))
    kept = keep(join_counted(posted, shared, "k").withColumn("r", rank).where(F.col("r") >= MATCHES).select("doc_id", "k"), "kept")
    drop(shared)
    sizes = keep(kept.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    out = keep(join_counted(kept, sizes, "k"), "postings")
    drop(kept)
    drop(sizes)
    return out


def _groups(postings: DataFrame) -> DataFrame:
    """(gid, doc_id): small postings once for each set of members, large ones dealt into blocks."""
    small = postings.where(F.col("c") <= MERGE).groupBy("k").agg(F.sort_array(F.collect_set("doc_id")).alias("m")).select("m").distinct()
    small = small.select(F.xxhash64(F.lit("m"), "m").alias("gid"), F.explode("m").alias("doc_id"))
    large = postings.where(F.col("c") > MERGE).select(F.xxhash64("k", _block(F.xxhash64("doc_id", "k"))).alias("gid"), "doc_id")
    return small.unionByName(large)


def _block(h):
    return F.pmod(h, F.ceil(F.col("c") / BLOCK).cast("int")).cast("int")


def _block_pairs(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """(gid, doc_id, comp) of postings of several blocks whose members are not in one component yet, for each two of their blocks."""
    wide = postings.where(F.col("c") > BLOCK).join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("k", "c", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    apart = wide.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("k", "c")
    rows = join_counted(wide.drop("c"), keep(apart, "apart"), "k").withColumn("own", _block(F.xxhash64("doc_id", "k")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / BLOCK).cast("int") - 1)))
    return rows.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("gid"), "doc_id", "comp")


def _confirmed(docs: DataFrame, pieces: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among the members of each piece."""
    ddl = "piece long, doc_id long, comp long, sig array<long>, s binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["piece", "doc_id", "comp", "sig", "s"])
            out.clear()
            return done

        for b in batches:
            for i, text, at in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("at").to_pylist()):
                s = shingles(text.as_py(), width)
                if not len(s):
                    continue
                sig, raw = signature(s), s.tobytes()
                for x in at:
                    out.append((x["piece"], i, x["comp"], sig, raw))
                    size += len(raw) + 300
                if size > 8_000_000:
                    yield flush()
                    size = 0
        if out:
            yield flush()

    by_doc = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("piece", "comp")).alias("at"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    need = keep(pieces.select("doc_id").distinct(), "need")
    if need.count() <= FEW:  # other texts stay where they are
        texts = texts.join(F.broadcast(need), "doc_id", "left_semi")
    rows = texts.join(by_doc, "doc_id").mapInArrow(sets, ddl)
    out = keep(by_group(rows, "piece", _links(percent), "a long, b long").distinct(), "links")
    drop(need)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Linked documents share 100 * intersection >= percent * union of their
    shingle sets; a component is named by its smallest doc_id. Null, empty and
    wordless texts have no shingles, link with nothing and are kept. Equal sets
    are linked. Repeated rows get the same component and the same kept; rows
    that repeat a doc_id with other texts are judged each by its own text, and
    what one of them links is linked for the id. A row without a doc_id joins
    the component of equal sets, or none, and links nothing. An empty table
    gives an empty result; other columns are ignored.
    """
    made = keep(describe(docs, width), "described")
    worded = made.where("n > 0")
    best = worded.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "sig")).alias("r"))
    reps = keep(best.select("key", "r.doc_id", "r.n", "r.sig"), "reps")
    postings = _postings(reps)
    marks = reps.select("doc_id", "n", "sig")

    def links(members: DataFrame) -> DataFrame:
        rows = members.join(marks, "doc_id").select("gid", "doc_id", "comp", "n", "sig")
        pieces = keep(by_group(rows, "gid", _pieces(percent), "piece long, doc_id long, comp long").distinct(), "pieces")
        found = _confirmed(docs, pieces, width, percent)
        drop(pieces)
        return found

    first = links(_groups(postings).withColumn("comp", F.col("doc_id")))
    comps = keep(components(first), "components")
    if not postings.where(F.col("c") > BLOCK).isEmpty():
        second = links(_block_pairs(postings, comps))
        drop(comps)
        comps = keep(components(first.unionByName(second)), "components")
        drop(second)
    drop(first)
    drop(postings)

    by_class = reps.select("key", "doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", F.coalesce("component", "doc_id").alias("c"))
    out = worded.select("doc_id", "n", "key").join(by_class, "key", "left").select("doc_id", "n", "c")
    out = out.unionByName(made.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("c")))
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
