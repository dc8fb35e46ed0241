"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets weight p^a / sum(p^a). The exponent a lies in
[0, 1]: 1 keeps the shares, 0 makes sources equal. It is found by sectioning, each
step one aggregate over the per-source table: first for a target entropy of the
weights, then raised as far as the repetition limit asks. A source's token budget
buys whole epochs and one partial epoch. Every epoch is a permutation of the
source's documents: a hash deals them into blocks, another orders each block, and
the partial epoch stops where the running token count would pass the budget.

Where that is, is one (block, place) for each source: sums of blocks show in which
block the budget ends, and only that block is walked. Documents are then taken or
left where they lie, by comparing hashes with their source's row; no text moves.
DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.work import drop, join_counted, keep

WORD = r"[^\x20\x09-\x0D]+"
SECTIONS = 32


def tokens(text: Column) -> Column:
    """Words of a whole text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _search(shares: DataFrame, reached, low: float, high: float, width: float = 1e-12) -> float:
    """Least a in [low, high] where ``reached`` holds; it holds from some a on, or at high at the latest.

    reached(a, z, s, top) takes the sums z of p^a and s of p^a ln p, and the
    largest p^(a-1) / z. A step asks SECTIONS exponents in one aggregate.
    """
    while high - low > width:
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        sums = [x for i, a in enumerate(grid) for x in (F.sum(F.pow("p", F.lit(a))).alias(f"z{i}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{i}"), F.max(F.pow("p", F.lit(a - 1))).alias(f"t{i}"))]
        r = shares.agg(*sums).first()
        good = [i for i, a in enumerate(grid) if reached(a, r[f"z{i}"], r[f"s{i}"], r[f"t{i}"] / r[f"z{i}"])]
        if not good:
            return high
        if good[0] == 0:
            return low
        low, high = grid[good[0] - 1], grid[good[0]]
    return high


def exponent(shares: DataFrame, entropy: float, repeats: float, budget: float | None) -> float:
    """The exponent for ``entropy`` (as a part of its largest value, ln of the
    number of sources) at which no source repeats more than ``repeats`` times.

    ``shares`` has p. Without a budget, the budget is the least that gives each
    source a whole epoch. If even a = 1 repeats too often, it is 1.
    """
    n, total, largest = shares.agg(F.count("*"), F.sum("t"), F.max("p")).first()
    if n < 2:
        return 1.0
    goal = entropy * math.log(n)
    a = _search(shares, lambda a, z, s, top: math.log(z) - a * s / z <= goal, 0.0, 1.0)
    epochs = (lambda a, z: budget / total) if budget is not None else (lambda a, z: z / largest ** (a - 1))
    return _search(shares, lambda a, z, s, top: epochs(a, z) * top <= repeats * (1 + 1e-12), a, 1.0)


def plan(docs: DataFrame, entropy: float, repeats: float, budget: float | None, block_docs: int) -> DataFrame:
    """Per source key s: t (tokens), c (documents), weight, quota (tokens to take), epochs (whole ones), rest, blocks.

    Sources without a token have no weight: their documents are taken once.
    """
    t = docs.groupBy("s").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    t = keep(t, "sources")
    total = t.agg(F.sum("t")).first()[0] or 0
    shares = t.where("t > 0").select("t", (F.col("t") / F.lit(float(max(total, 1)))).alias("p"))
    a = exponent(shares, entropy, repeats, budget) if total else 1.0
    z, largest = (shares.agg(F.sum(F.pow("p", F.lit(a))), F.max("p")).first()) if total else (1.0, 1.0)
    whole = budget is None
    if whole:
        budget = total * z * largest ** (1 - a)
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(total, 1))), F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    quota = F.when(F.col("t") > 0, F.floor(F.lit(float(budget)) * F.col("weight") * (1 + 1e-9))).otherwise(F.lit(0)).cast("long")
    if whole:
        quota = F.greatest(quota, F.col("t"))
    out = t.withColumn("weight", weight).withColumn("quota", quota).withColumn("weight", F.round("weight", 12))
    out = out.withColumn("epochs", F.when(F.col("t") > 0, F.floor(F.col("quota") / F.col("t"))).otherwise(F.lit(1)).cast("int"))
    return out.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("t")).withColumn("blocks", F.ceil(F.col("c") / block_docs).cast("long"))


#: What mix_sources returns besides the columns asked for.
OUT = ("doc_id", "source", "n_tokens", "epoch", "block", "position", "weight")


def _dealt(rows: DataFrame, seed: int) -> DataFrame:
    """Adds block and position: hashes of the epoch and the row's id."""
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "epoch", "id"), F.col("blocks"))).withColumn("position", F.xxhash64(F.lit(seed), "epoch", "id"))


def _stops(light: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Per source with a partial epoch: its last block and the last position taken there (null if none)."""
    some = sources.where("rest > 0")
    rows = _dealt(join_counted(light, some, "s").withColumn("epoch", F.col("epochs")), seed)
    blocks = keep(rows.groupBy("s", "block").agg(F.sum("n_tokens").alias("b")).withColumn("upper", F.floor(F.col("block") / 1000)), "blocks")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    uppers = blocks.groupBy("s", "upper").agg(F.sum("b").alias("u"))
    uppers = uppers.withColumn("base", F.coalesce(F.sum("u").over(before("s", "upper")), F.lit(0))).select("s", "upper", "base")
    begins = blocks.withColumn("inner", F.coalesce(F.sum("b").over(before("s", "upper", "block")), F.lit(0))).join(uppers, ["s", "upper"]).withColumn("begin", F.col("base") + F.col("inner"))
    last = begins.join(some.select("s", "rest"), "s").where("begin + b > rest").groupBy("s").agg(F.min(F.struct("block", "begin")).alias("m"))
    last = keep(last.select("s", F.col("m.block").alias("last"), F.col("m.begin").alias("begin"), F.lit(1).alias("c")), "last")
    drop(blocks)
    edge = join_counted(rows.drop("c"), last, "s").where("block = last")
    sofar = F.sum("n_tokens").over(Window.partitionBy("s").orderBy("position").rangeBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("sofar", sofar).where("begin + sofar <= rest").groupBy("s").agg(F.max("position").alias("stop"))
    out = keep(last.select("s", "last").join(edge, "s", "left"), "stops")
    drop(last)
    return out


def mix_sources(docs: DataFrame, entropy: float = 0.97, repeats: float = 2.0, budget: float | None = None, block_docs: int = 1000, seed: int = 7, columns: list[str] | None = None) -> DataFrame:
    """Documents in mixed order: doc_id, source, n_tokens, epoch, block, position,
    weight, and ``columns`` of docs (one named like an output column gets "_in"
    behind its name).

    A row appears once for each epoch that takes it. ``block`` and ``position``
    order a source's epoch. A null source is a source of its own, null and empty
    texts count no tokens. Rows that repeat a doc_id share their places and are
    taken together; rows without one are told apart by their texts. Documents of
    a source without any token are taken once. An empty table gives an empty
    result.
    """
    kept = F.struct(F.lit(0), *[F.col(c).alias(c if c not in OUT else f"{c}_in") for c in columns or []])
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    base = docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), F.coalesce("source", F.lit("\u0000")).alias("s"), ident.alias("id"), kept.alias("kept"))
    light = keep(base.select("s", "id", "n_tokens"), "tokens")
    sources = keep(plan(light, entropy, repeats, budget, block_docs), "plan")
    stops = _stops(light, sources, seed)
    drop(light)
    sources = keep(sources.join(stops, "s", "left").select("s", "c", "weight", "epochs", "rest", "blocks", "last", "stop"), "places")
    drop(stops)

    last = F.when(F.col("rest") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1)
    rows = _dealt(join_counted(base, sources, "s").where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last))), seed)
    inside = (F.col("block") < F.col("last")) | ((F.col("block") == F.col("last")) & (F.col("position") <= F.col("stop")))
    taken = rows.where((F.col("epoch") < F.col("epochs")) | F.coalesce(inside, F.lit(False)))
    return taken.select(*OUT, *[F.col("kept")[c if c not in OUT else f"{c}_in"].alias(c if c not in OUT else f"{c}_in") for c in columns or []])
