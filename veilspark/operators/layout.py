"""Rows, blocks and areas from boxes on a page."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from veilspark.operators.fold import fold_groups
from veilspark.operators.store import deal


def visual_rows(lines: DataFrame) -> DataFrame:
    """Adds row to lines (doc_id, page, text, left, right, center_y, height).

    A line joins the current row while its centre lies within max(0.6 x median
    height, 4) of the row's running mean. The mean moves with each line, so a page is folded in order.
    """

    y, h = lines.columns.index("center_y"), lines.columns.index("height")

    def one(rows: list[tuple]) -> list[tuple]:
        reach = max(0.6 * median(r[h] for r in rows), 4.0)
        out, mean, n, row = [], None, 0, -1
        for r in rows:
            if mean is None or abs(r[y] - mean) > reach:
                mean, n, row = r[y], 1, row + 1
            else:
                n += 1
                mean += (r[y] - mean) / n
            out.append((*r, row))
        return out

    schema = StructType([*lines.schema.fields, StructField("row", IntegerType())])
    return fold_groups(lines, ["doc_id", "page"], [F.col(c) for c in ("center_y", "left", "text")], one, schema)


def blocks(rows: DataFrame) -> DataFrame:
    """Adds block to rows (doc_id, page, top, bottom, height): a new one where the gap exceeds max(1.75 x median height, 12)."""
    middle = F.percentile("height", 0.5).over(Window.partitionBy("doc_id", "page"))
    w = Window.partitionBy("doc_id", "page").orderBy("top", "bottom")
    fresh = F.coalesce((F.col("top") - F.lag("bottom").over(w) > F.greatest(F.lit(1.75) * F.col("median"), F.lit(12.0))).cast("int"), F.lit(0))
    return deal(["doc_id", "page"], rows)[0].withColumn("median", middle).withColumn("fresh", fresh).withColumn("block", F.sum("fresh").over(w)).drop("median", "fresh")


def row_text(lines: DataFrame) -> DataFrame:
    """doc_id, page, row, text: a tab where the gap exceeds max(2.5 x height, 2.5 % of the page's width), else a space."""
    width = F.max("right").over(Window.partitionBy("doc_id", "page"))
    w = Window.partitionBy("doc_id", "page", "row").orderBy("left", "text")
    gap = F.col("left") - F.lag("right").over(w)
    sep = F.when(gap.isNull(), "").when(gap > F.greatest(2.5 * F.col("height"), 0.025 * F.col("width")), "\t").otherwise(" ")
    parts = deal(["doc_id", "page"], lines)[0].withColumn("width", width).withColumn("sep", sep)
    return parts.groupBy("doc_id", "page", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text", "sep"))), lambda x: F.concat(x["sep"], x["text"])), "").alias("text"))


def union_area(boxes: DataFrame) -> DataFrame:
    """doc_id, page, area, share of the union of boxes (left, top, right, bottom) clipped to the page (width, height).

    Boxes are cut into the vertical strips between neighbouring edges; within a
    strip, covered heights come from a running maximum.
    """
    clip = boxes.select("doc_id", "page", "width", "height", F.greatest("left", F.lit(0.0)).alias("l"), F.greatest("top", F.lit(0.0)).alias("t"), F.least("right", "width").alias("r"), F.least("bottom", "height").alias("b")).where("r > l and b > t")
    edges = clip.select("doc_id", "page", F.explode(F.array("l", "r")).alias("x")).distinct()
    strips = edges.withColumn("x2", F.lead("x").over(Window.partitionBy("doc_id", "page").orderBy("x"))).where("x2 is not null")
    cut = clip.join(strips, ["doc_id", "page"]).where("l < x2 and r > x")
    w = Window.partitionBy("doc_id", "page", "x").orderBy("t", "b").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("t"), F.coalesce(F.max("b").over(w), F.col("t"))))
    per = cut.withColumn("part", part * (F.col("x2") - F.col("x"))).groupBy("doc_id", "page").agg(F.sum("part").alias("area"), F.first("width").alias("w"), F.first("height").alias("h"))
    return per.select("doc_id", "page", "area", (F.col("area") / (F.col("w") * F.col("h"))).alias("share"))


def html_tables(pages: DataFrame) -> DataFrame:
    """page_id, table, row, cell, text of every table cell of pages (page_id, html), nested tables apart. Null and table-less pages have none."""
    from collections.abc import Iterator
    from html.parser import HTMLParser

    import pyarrow as pa

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.found: list[tuple[int, int, int, str]] = []
            self.open: list[list] = []
            self.count = 0

        def _close(self) -> None:
            if self.open and self.open[-1][3] is not None:
                t = self.open[-1]
                self.found.append((t[0], t[1], t[2], " ".join("".join(t[3]).split())))
                t[3] = None

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "table":
                self.open.append([self.count, -1, -1, None])
                self.count += 1
            elif tag == "tr" and self.open:
                self._close()
                self.open[-1][1:3] = [self.open[-1][1] + 1, -1]
            elif tag in ("td", "th") and self.open:
                self._close()
                t = self.open[-1]
                t[1], t[2], t[3] = max(t[1], 0), t[2] + 1, []
            elif tag in ("br", "p", "div") and self.open and self.open[-1][3] is not None:
                self.open[-1][3].append(" ")

        def handle_endtag(self, tag: str) -> None:
            if tag in ("td", "th", "tr", "table"):
                self._close()
            if tag == "table" and self.open:
                self.open.pop()

        def handle_data(self, data: str) -> None:
            if self.open and self.open[-1][3] is not None:
                self.open[-1][3].append(data)

    def cells(text: str | None) -> list[tuple[int, int, int, str]]:
        reader = Reader()
        reader.feed(text or "")
        reader.close()
        return reader.found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *c) for i, t in zip(b.column("page_id").to_pylist(), b.column("html")) if t.is_valid and "<t" in t.as_py().lower() for c in cells(t.as_py())]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["page_id", "table", "row", "cell", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, table int, row int, cell int, text string")


def table_text(cells: DataFrame) -> DataFrame:
    """page_id, table, text: rows as lines with bars between cells, a rule below the first."""
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]), " | "), F.lit(" |"))
    rows = cells.groupBy("page_id", "table", "row").agg(line.alias("line"), F.count("*").alias("n"))
    rule = lambda n: F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n))
    per = rows.groupBy("page_id", "table").agg(F.sort_array(F.collect_list(F.struct("row", "line", "n"))).alias("r"))
    lines = F.concat(F.array(F.get("r", 0)["line"], rule(F.get("r", 0)["n"].cast("int"))), F.transform(F.slice("r", 2, F.greatest(F.size("r"), F.lit(1))), lambda x: x["line"]))
    return per.select("page_id", "table", F.array_join(lines, "\n").alias("text"))


def infer_tables(rows: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, page, block, rows, columns: blocks of text rows (doc_id, page, block, row, text) that read as tables, as at least ``least`` of their rows have the same number (two or more) of tab-separated cells."""
    cells = F.size(F.split("text", "\t"))
    same = rows.withColumn("cells", cells).where("cells > 1").groupBy("doc_id", "page", "block", "cells").agg(F.count("*").alias("n"))
    best = same.groupBy("doc_id", "page", "block").agg(F.max(F.struct("n", "cells")).alias("m"))
    return best.where(F.col("m.n") >= least).select("doc_id", "page", "block", F.col("m.n").alias("rows"), F.col("m.cells").alias("columns"))
