"""Results that several later steps read."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df, worked out once: checkpointed where the session has a shared folder for that, else kept by the
    executors, whose lost parts are worked out again."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def fence(df: DataFrame) -> DataFrame:
    """df behind a step that the optimizer neither pushes filters through nor merges with what follows.

    Rules on columns made by rules would otherwise be copied into one another
    until plans are too large to handle.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


#: Bytes of an input's files for each partition that rows are dealt to.
PART_BYTES = 2 << 20


def _parts(df: DataFrame) -> int:
    """Partitions that df's largest input of files asks for, from the sizes of the leaves; nothing is run or optimized.
    Settled tables do not count: each step would else have the partitions of all before it."""
    size, leaves = 0, df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() != "LogicalRDD":
            size = max(size, min(int(str(leaf.stats().sizeInBytes())), 1 << 50))
    return ceil(size / PART_BYTES)


def deal(keys: list[str], *tables: DataFrame) -> list[DataFrame]:
    """Tables dealt by keys, all to the same number of partitions, which grows with their inputs, so that what one task
    sorts or holds does not. Small ones are left to the session's own number of partitions."""
    n = max(_parts(t) for t in tables)
    if n <= tables[0].sparkSession.sparkContext.defaultParallelism:
        return [t.repartition(*keys) for t in tables]
    return [t.repartition(n, *keys) for t in tables]
