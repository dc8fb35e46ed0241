"""Files in, results out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What uploads may be, and how large.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp", "txt", "docx")
MOST_BYTES = 20 * 1024 * 1024
MOST_FILES = 100


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, extension, size, content_hash, problem of files below a folder.

    Only names, sizes and hashes leave the scan; problem is null for a file that
    may enter. The scan itself passes over empty files; check_uploads names them
    where a listing is given.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))
    return check_uploads(out)


def check_uploads(files: DataFrame) -> DataFrame:
    """Adds extension and problem to (filename, size)."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    problem = (
        F.when(F.trim(F.coalesce("filename", F.lit(""))) == "", "NO_NAME")
        .when(~ext.isin(*EXTENSIONS), "EXTENSION")
        .when(F.col("size") == 0, "EMPTY")
        .when(F.col("size") > MOST_BYTES, "TOO_LARGE")
    )
    return files.withColumn("extension", ext).withColumn("problem", problem)


def route(files: DataFrame) -> DataFrame:
    """Adds source: how a file's text is had. (extension, chars, image_share) of a page; a PDF page is searchable from 500 characters, or from 10 with images on at most 30 %."""
    searchable = (F.col("chars") >= 500) | (F.col("chars") >= 10) & (F.col("image_share") <= 0.30)
    per = files.groupBy("path", "extension").agg(F.bool_and(searchable).alias("every"), F.bool_or(searchable).alias("some"))
    source = F.when(F.col("extension").isin("txt", "docx"), "NATIVE_TEXT").when(F.col("extension") != "pdf", "OCR").when(F.col("every"), "NATIVE_PDF").when(F.col("some"), "MIXED_PDF").otherwise("OCR")
    return per.select("path", "extension", source.alias("source"))


def merge_pages(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """doc_id, page_number, page_text: the native text of a page where there is one, else the recognised."""
    n, r = native.alias("n"), recognised.alias("r")
    both = n.join(r, ["doc_id", "page_number"], "full_outer")
    return both.select("doc_id", "page_number", F.coalesce(F.nullif(F.trim("n.page_text"), F.lit("")), "r.page_text", F.lit("")).alias("page_text"))


def create_runs(uploads: DataFrame, run_id: str) -> DataFrame:
    """run_id, files, documents, status of an upload: REFUSED if over MOST_FILES or a file may not enter, else QUEUED; copies count as files, not as documents."""
    n = uploads.agg(F.count("*").alias("files"), F.countDistinct(F.when(F.col("problem").isNull(), F.col("content_hash"))).alias("documents"), F.count("problem").alias("bad"))
    status = F.when((F.col("files") > MOST_FILES) | (F.col("bad") > 0) | (F.col("files") == 0), "REFUSED").otherwise("QUEUED")
    return n.select(F.lit(run_id).alias("run_id"), "files", "documents", status.alias("status"))


def docx_text(content: bytes) -> str:
    """Paragraphs, and rows of tables with tabs between cells, of a DOCX file; what is no such file has none."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    said = lambda node: "".join("\t" if t.tag == f"{w}tab" else t.text or "" for t in node.iter() if t.tag in (f"{w}t", f"{w}tab"))
    lines = []
    for part in body if body is not None else ():
        if part.tag == f"{w}p":
            lines.append(said(part))
        elif part.tag == f"{w}tbl":
            lines += ["\t".join(" ".join(filter(None, map(said, cell.iter(f"{w}p")))) for cell in row.iter(f"{w}tc")) for row in part.iter(f"{w}tr")]
    return "\n".join(x for x in lines if x.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, text of DOCX files, one row a file."""
    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(docx_text)

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", text("content").alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, text of UTF-8 text files, one row a file."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return raw.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_redacted(redacted: DataFrame, path: str, run_id: str) -> None:
    """Replaces one run's partition and leaves the others."""
    rows = redacted.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_entities(entities: DataFrame, path: str) -> None:
    """Entities, their reviews and redactions as three tables by document bucket. Writing a document again replaces what was there (delete, then insert)."""
    from veilspark.operators.redact import needs_review
    from veilspark.operators.relational import replace_rows

    spark = entities.sparkSession
    rows = entities.withColumn("entity_id", F.xxhash64("doc_id", "page", "start", "end", "entity_type"))
    marker = F.concat(F.lit("[REDACTED_"), F.col("entity_type"), F.lit("]"))
    tables = {
        "entities": rows, "reviews": rows.where(needs_review(F.col("confidence"))).select("doc_id", "entity_id", F.lit("PENDING").alias("status")),
        "redactions": rows.select("doc_id", "entity_id", "start", "end", marker.alias("replacement")),
    }
    for name, table in tables.items():
        new = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
        target = f"{path}/{name}"
        if spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(target)):
            old = spark.read.schema(new.schema).parquet(target)
            touched = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int").alias("bucket")).distinct()
            kept = replace_rows(old.join(touched, "bucket", "left_semi"), new, "doc_id") if name == "entities" else old.join(touched, "bucket", "left_semi").join(rows.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
            new = kept.select(*new.columns).persist()
            new.count()  # read before what it is read from is replaced
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
