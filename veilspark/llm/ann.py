"""Nearest neighbours by inner product with balanced posting lists.

Vectors are scaled by the largest norm and given one more component that fills
them up to the unit sphere, so the largest inner product is the nearest point.
Centroids come from k-means on a bounded sample, clusters of more than UNEVEN times
the mean split in two; their number follows the table, so lists stay near LIST rows
up to MOST centroids, beyond which long lists are read in blocks. A graph over the centroids, small enough to be sent everywhere,
is searched best-first to find the centroids near a vector or query. A vector is
posted to its nearest centroid and, if it lies on a boundary, to others almost as
near that are not behind one already taken. A query's search keeps a beam of lists,
which grows more slowly than their number, and reads those of it whose centroid is
within a ratio of the nearest one's distance: few in dense regions, the whole beam
where distances hardly differ. The nearest FIRST lists are read first; their k-th best
score is what a vector in the others must reach, so those yield few rows however
many lists there are. Scores are computed on the original vectors in double.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.work import keep

LIST, MOST, SAMPLE, FIRST = 200, 2048, 20_000, 4
#: A list holds at most UNEVEN times the mean of the sample's rows, unless they are equal.
UNEVEN = 2
#: Lists a query's search keeps: BEAM times their number to the power SPREAD, 32 at least.
BEAM, SPREAD = 1.3, 0.7


@dataclass
class Graph:
    """Centroids on the sphere, each with edges to its nearest others; entry points spread over them."""

    points: np.ndarray
    edges: np.ndarray
    entry: np.ndarray
    scale: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Table vectors to the unit sphere of one more dimension."""
        x = x / self.scale
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))]

    def ask(self, q: np.ndarray) -> np.ndarray:
        """Queries keep their direction; their length does not change the order."""
        return np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]

    def search(self, v: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids found, and their squared distances."""
        dist = lambda i: ((self.points[i] - v) ** 2).sum(1)
        seen = np.zeros(len(self.points), bool)
        seen[self.entry] = True
        todo = [(d, i) for d, i in zip(dist(self.entry).tolist(), self.entry.tolist())]
        best = [(-d, i) for d, i in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = self.edges[i][~seen[self.edges[i]]]
            if not len(new):
                continue
            seen[new] = True
            for dn, n in zip(dist(new).tolist(), new.tolist()):
                if len(best) < beam or dn < -best[0][0]:
                    heapq.heappush(todo, (dn, n))
                    heapq.heappush(best, (-dn, n))
                    if len(best) > beam:
                        heapq.heappop(best)
        out = sorted((-d, i) for d, i in best)[:k]
        return np.array([i for _, i in out], np.int64), np.array([d for d, _ in out])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(c @ part.T).argmax(0) for part in np.array_split(x, max(1, len(x) // 2048))])  # points on a sphere, centroids of length 1
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        empty = n == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _balanced(x: np.ndarray, c: np.ndarray, most_rows: int, most: int) -> np.ndarray:
    """Centroids of which none is nearest to more than ``most_rows`` rows of x, as far as rows differ and ``most`` allows: larger ones are split in two."""
    settled: set[bytes] = set()
    while len(c) < most:
        near = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 2048))])
        sizes = np.bincount(near, minlength=len(c))
        wide = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i] > most_rows and c[i].tobytes() not in settled][: most - len(c)]
        if not wide:
            break
        for i in wide:
            own = x[near == i]
            if len(np.unique(own, axis=0)) < 2:
                settled.add(c[i].tobytes())
                continue
            pair = _kmeans(own, 2, rounds=4, seed=len(c))
            c[i] = pair[0]
            c = np.r_[c, pair[1:]]
    return c


def _usable(v: str) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(v).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def build(vectors: DataFrame, dim: int, count: int, top_norm: float, list_rows: int = LIST, most: int = MOST, sample: int = SAMPLE, degree: int = 24) -> Graph:
    """Fit centroids on the ``sample`` rows with the smallest hashes of their ids."""
    rows = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    rows = rows.sort_values("vec_id", kind="stable")
    graph = Graph(np.empty((0, dim + 1)), np.empty((0, 0), np.int64), np.empty(0, np.int64), top_norm)
    x = graph.lift(np.stack(rows["v"].to_numpy()).astype(float))
    k = int(np.clip(count // list_rows, 1, min(most, max(1, len(x) // 4))))
    c = _balanced(x, _kmeans(x, k), UNEVEN * max(1, len(x) // k), most)
    k = len(c)
    graph.points = c
    graph.edges = np.argsort(-(c @ c.T), axis=1, kind="stable")[:, 1 : degree + 1]
    rng = np.random.default_rng(5)
    if k > 1:  # a few random edges join far regions
        graph.edges = np.c_[graph.edges, rng.integers(0, k, (k, 4))]
    graph.entry = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int64))
    return graph


def _post(graph: Graph, replicas: int, closure: float):
    """Lists of each vector: the nearest, and others within ``closure`` times its
    distance that are nearer to the vector than to every list taken before. A
    batch of vectors is compared with all centroids at once."""
    points = graph.points
    apart = np.maximum(0, 2 - 2 * points @ points.T)

    def lists_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = min(2 * replicas, len(points))
        d = np.maximum(0, (x * x).sum(1)[:, None] + 1 - 2 * x @ points.T)
        near = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1))), 1)
        d = np.take_along_axis(d, near, 1)
        taken = np.zeros(near.shape, bool)
        for j in range(wide):
            clear = np.ones(len(x), bool)
            for t in range(j):
                clear &= ~taken[:, t] | (apart[near[:, j], near[:, t]] > d[:, j])
            taken[:, j] = clear & (d[:, j] <= closure**2 * d[:, 0] + 1e-12) & (taken.sum(1) < replicas)
        row, at = np.nonzero(taken)
        return row, near[row, at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                b = big.slice(start, 1024)
                row, lists = lists_of(graph.lift(np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, -1)))
                rows = b.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *rows.columns], names=["list", "vec_id", "v"])

    return run


def _probe(graph: Graph, ratio: float, beam: int, sizes: np.ndarray, enough: int):
    """Lists of each query, nearest first: those within ``ratio`` times the
    nearest centroid's distance, and further ones until they have ``enough`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists, turns = [], [], []
            q = graph.ask(np.array(b.column("q").to_pylist(), float).reshape(b.num_rows, -1)) if b.num_rows else np.empty((0, 0))
            for i, v in enumerate(q):
                near, d = graph.search(v, beam, beam)
                use = near[d <= ratio**2 * d[0] + 1e-12]
                if sizes[use].sum() < enough:
                    far = np.argsort(((graph.points - v) ** 2).sum(1), kind="stable")
                    far = far[~np.isin(far, use)]
                    missing = enough - sizes[use].sum()
                    use = np.r_[use, far[: np.searchsorted(np.cumsum(sizes[far]), missing) + 1]]
                ids += [i] * len(use)
                lists += use.tolist()
                turns += range(len(use))
            rows = b.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(turns, pa.int32()), *rows.columns], names=["list", "turn", "query_id", "q"])

    return run


def _scores(k: int):
    """Each query's k best of one block of one list, from its ``floor`` on."""

    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(members):
            members = members.drop_duplicates("vec_id").sort_values("vec_id")
            ids = members["vec_id"].to_numpy()
            m = np.stack(members["v"].to_numpy()).astype(float)
            for part in np.array_split(np.arange(len(queries)), max(1, len(queries) // 512)):
                q = np.stack(queries["q"].iloc[part].to_numpy()).astype(float)
                s = q @ m.T
                for row, qid, floor in zip(s, queries["query_id"].iloc[part].tolist(), queries["floor"].iloc[part].tolist()):
                    use = np.flatnonzero((ids != qid) & (row >= floor - 1e-9))
                    if len(use) > k:
                        cut = np.partition(row[use], len(use) - k)[len(use) - k]
                        use = use[row[use] >= cut - 1e-9]
                    use = use[np.lexsort((ids[use], -row[use]))][:k]
                    out += zip([qid] * len(use), ids[use].tolist(), row[use].tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, ratio: float = 1.24, beam: int | None = None, replicas: int = 4, closure: float = 1.1, block: int = 5000) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id,
    embedding) that satisfies ``queries``, its k nearest found among all others.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; nor do rows of another length than the commonest or without an id. Ties go to
    the smaller vec_id. Of rows that repeat a vec_id one takes part. An empty table gives an empty result. Other
    columns are ignored.
    """
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & _usable("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count, top = sizes
    good = good.where(F.size("v") == dim)
    graph = build(good, dim, count, top)
    kind = dict(good.dtypes)["v"]
    posted = keep(good.mapInArrow(_post(graph, replicas, closure), f"list int, vec_id long, v {kind}"), "postings")
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = good.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"])
    # a vector is in at most ``most`` lists, so lists with most * (k + 1) rows hold k others than the query
    ids = posted.select("list", "vec_id").distinct()
    sizes = np.zeros(len(graph.points), np.int64)
    for r in ids.groupBy("list").agg(F.count("*").alias("n")).collect():  # as many rows as there are centroids
        sizes[r["list"]] = r["n"]
    most = ids.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    asked = asked.mapInArrow(_probe(graph, ratio, beam or max(32, math.ceil(BEAM * len(graph.points) ** SPREAD)), sizes, most * (k + 1)), f"list int, turn int, query_id long, q {kind}")
    asked = keep(asked, "probes")
    members = posted.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("list", "block", "vec_id", "v")

    def read(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "query_id", "q", "floor")
        found = rows.groupBy("list", "block").cogroup(members.groupBy("list", "block")).applyInPandas(_scores(k), "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = keep(read(asked.where(F.col("turn") < FIRST).withColumn("floor", F.lit(float("-inf")))).withColumn("rank", rank).where(F.col("rank") <= k), "first")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = asked.where(F.col("turn") >= FIRST).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    best = first.drop("rank").unionByName(read(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
