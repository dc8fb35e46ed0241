"""Tables between the steps of an operator.

``keep`` cuts lineage by writing Parquet into the folder that all executors
share (``spark.checkpoint.dir``), so a lost executor loses nothing that was
kept. Only in local mode without that setting (tests, a laptop) is a temporary
folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = jvm.get() if jvm.isDefined() else tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that keep() wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles():
        if "/veilspark/" not in file:
            raise ValueError(f"not a kept table: {file}")
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return


def join_counted(rows: DataFrame, counts: DataFrame, key: str | list[str], parts: int = 4096, few: int = 20_000) -> DataFrame:
    """rows joined with counts (key, c), a kept table with the number of rows of each key.

    Up to ``few`` keys are broadcast. Of more, those with over 1/parts of all
    rows, so fewer than ``parts``, are broadcast and their rows stay where they
    are; the others are shuffled.
    """
    total, number = counts.agg(F.sum("c"), F.count("*")).first()
    if number <= few:
        return rows.join(F.broadcast(counts), key)
    most = max(1000, total // parts)
    hot = F.broadcast(counts.where(F.col("c") > most))
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counts.where(F.col("c") <= most), keys)
    return rows.join(hot, keys).unionByName(rest)


def by_group(rows: DataFrame, key: str, work: Callable[[pa.Table], list[np.ndarray] | None], ddl: str) -> DataFrame:
    """Rows that ``work`` makes of each group of the long column ``key``.

    Groups are many and small: rows are dealt and sorted by key, and a task
    holds one group at a time as an Arrow table. work returns a column each.
    """
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[list[np.ndarray]] = []
        last, size = None, 0

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*made), schema)], schema=schema)
            made.clear()
            return done

        def close() -> None:
            nonlocal size
            got = work(pa.Table.from_batches(held)) if held else None
            held.clear()
            if got is not None:
                made.append(got)
                size += len(got[0])

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(key).to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for start, stop in zip(edges, edges[1:]):
                if ids[start] != last:
                    close()
                    last = ids[start]
                held.append(b.slice(start, stop - start))
                if size > 8192:
                    yield flush()
                    size = 0
        close()
        if made:
            yield flush()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, ddl)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(make: Callable[..., Iterable[tuple]], schema: pa.Schema, columns: list[str], rows: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: make(*values of one row) yields output tuples.

    ``make`` may be a factory marked by a ``setup`` attribute, which is called
    once in each task. Output leaves in batches of at most ``rows``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make.setup() if hasattr(make, "setup") else make
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cells = list(zip(*out)) if out else [()] * len(schema)
            arrays = [pa.array(c, t.type) for c, t in zip(cells, schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            parts = [batch.column(c) for c in columns]
            for i in range(batch.num_rows):
                for row in each(*[p[i].as_py() for p in parts]):
                    out.append(row)
                if len(out) >= rows:
                    yield flush()
        if out:
            yield flush()

    return run
