"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Boosting cycles over the
features; at each visit a shallow tree on that feature's bins (a few splits of
the binned axis) is fitted to the logistic loss and added to the feature's lookup
table. The strongest pairs, ranked by how much of the residual a coarse grid
explains, get two-dimensional tables the same way. A score is the sigmoid of an
intercept plus one table entry per feature and pair, looked up for whole batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "punct", "symbol", "space", "high", "distinct", "top_word", "repeat_pairs", "line_words", "repeat_lines", "end_marked", "long_words", "capital_words", "max_run")

_CLASS = np.zeros(256, np.int64)  # 0 lower case, 1 upper, 2 digit, 3 sentence mark, 4 other ASCII symbol, 5 white space, 6 non-ASCII
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b".,;:!?'\"()-"]] = 3
_CLASS[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[[*range(33), 127]] = 5
_CLASS[128:] = 6


def features(text: str | None) -> np.ndarray:
    """The FEATURES of a whole text; null counts as empty, whose features are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    codes = np.frombuffer(raw, np.uint8)
    share = np.bincount(_CLASS[codes], minlength=7) / len(raw)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    _, counts = np.unique(ids, return_counts=True)
    with np.errstate(over="ignore"):
        pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(w[-1:] in (b".", b"!", b"?", b",") for w in words)
    edges = np.flatnonzero(np.diff(codes, prepend=-1, append=-1)) if len(codes) else np.zeros(1, int)
    out[:] = (
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), share[1], share[2], share[3], share[4], share[5], share[6],
        len(counts) / len(words), counts.max() / len(words), 1 - len(np.unique(pairs)) / max(1, len(pairs)), np.log1p(len(words) / len(lines)), 1 - len(set(lines)) / len(lines),
        ends / len(words), (sizes > 24).mean(), sum(w[:1].isupper() for w in words) / len(words), np.log1p(np.diff(edges).max(initial=1)),
    )
    return out


@dataclass
class AdditiveModel:
    """Cut points, and tables of log-odds by feature and by pair of features."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, t) in enumerate(zip(self.cuts, self.tables)):
            total += t[np.searchsorted(cut, x[:, j], side="right")]
        coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
        for i, j, t in self.pairs:
            total += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Leaf value of each bin for a tree that splits a binned axis greedily."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                s = np.arange(a + 1, b)
                gain = worth(a, s) + worth(s, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), (a, b), int(s[gain.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Four leaves on a grid: the best first split of one axis, then each side's best of the other."""
    best, value = -1.0, np.zeros(g.shape)
    for turn in (False, True):
        G, H = (g.T, h.T) if turn else (g, h)
        for s in range(1, G.shape[0]):
            gain, out = 0.0, np.zeros(G.shape)
            for rows in (slice(0, s), slice(s, None)):
                leaf = _tree(G[rows].sum(0), H[rows].sum(0), 2, l2)
                gain += float((leaf * G[rows].sum(0)).sum())
                out[rows] = leaf
            if gain > best:
                best, value = gain, out.T if turn else out
    return value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 32, coarse: int = 8, pairs: int = 6, leaves: int = 4, l2: float = 3.0) -> AdditiveModel:
    """Cyclic boosting of main tables, then of pair tables on what they leave.

    Without rows, or with one class only, the model is its prior.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    k = x.shape[1]
    cuts = [_cuts(x[:, j], bins) if len(x) else np.empty(0) for j in range(k)]
    model = AdditiveModel(cuts, float(np.log(prior / (1 - prior))), [np.zeros(len(c) + 1) for c in cuts])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    f = np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), leaves, l2)
            model.tables[j] += step
            f += step[at[j]]
    model.pair_cuts = [_cuts(x[:, j], coarse) for j in range(k)]
    grid = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)
        cell = grid[i] * shape[1] + grid[j]
        g, h = slopes()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    def explained(ij: tuple[int, int]) -> float:
        _, g, h = cells(*ij)
        return float((_grid_tree(g, h, l2) * g).sum())

    chosen = sorted(combinations(range(k), 2), key=explained, reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1))) for i, j in chosen]
    for _ in range(rounds // 4):
        for i, j, t in model.pairs:
            cell, g, h = cells(i, j)
            step = rate * _grid_tree(g, h, l2)
            t += step
            f += step.reshape(-1)[cell]
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()).tolist() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])


def learn(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> AdditiveModel:
    """Fit on labelled documents of the training fold.

    Training rows are those whose crc32(doc_id as text) mod 3 is not 1 and whose
    quality is 0 or 1. At most ``most`` of them are used, the ones with the
    smallest hash of doc_id, so that training fits in the driver; scoring has
    no such limit. Only the text enters the features.
    """
    gold = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    gold = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(gold, "doc_id").select("y", "text")
    got = rows.mapInArrow(_feature_batches, "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(np.c_[got["y"].to_numpy(float), x].T)  # the same model whatever order rows arrive in
    return fit(x[order], got["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """All documents with doc_id, held_out, score, predicted, from whole texts.

    Null and empty texts get the model's score of zero features. Rows with a
    null doc_id are scored too and are not held out. Repeated rows are scored
    alike; an empty table gives an empty result; other columns are dropped.
    """
    ddl = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = model.score(np.array([features(t.as_py()) for t in b.column("text")]))
            held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""

    @F.pandas_udf("double")
    def quality(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

    return docs.where(quality("text") >= least)
