"""Sequential work within many small groups.

Pages and documents are small and many, so a pandas call for each would cost more
than its rows. Rows are dealt and sorted by the group's key, and one pass over a
partition hands each group's rows to a function as tuples, in order. A group is
held by one task at a time; tasks stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilspark.operators.store import deal


def fold_groups(df: DataFrame, keys: list[str], order: list[Column], work: Callable[[list[tuple]], list[tuple]], schema: StructType, rows: int = 8192) -> DataFrame:
    """Rows that ``work`` makes of each group of ``keys``, whose rows come sorted by ``order``."""
    at = itemgetter(*[df.columns.index(k) for k in keys])
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        def pack(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)

        out: list[tuple] = []
        for _, group in groupby(tuples(), key=at):
            out += work(list(group))
            if len(out) >= rows:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return deal(keys, df)[0].sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
