"""Documents as they arrive.

A file stream takes the queue's place: the checkpoint remembers what was read, a
batch is replayed after a crash, and its output is written under the batch's
number, so a replay replaces it. Failed batches are retried and then set aside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.documents import with_content_hash


def document_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, retries: int = 2, dead: str | None = None) -> StreamingQuery:
    """Run ``work`` on each batch of new contents, once, and append its rows.

    Contents seen in earlier batches are told by an anti join with the stored
    hashes, not by unbounded stream state. ``work`` that fails ``retries`` + 1
    times sends the batch to ``dead`` (or fails the query without one).
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        fresh = with_content_hash(df)
        fresh = fresh.join(fresh.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")), ["content_hash", "doc_id"], "left_semi")
        try:
            stored = spark.read.parquet(f"{out}/hashes").where(F.col("batch") < number).select("content_hash")
            fresh = fresh.join(stored, "content_hash", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        for attempt in range(retries + 1):
            try:
                work(fresh.drop("content_hash")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/rows")
                break
            except Exception:
                if attempt == retries:
                    if dead is None:
                        raise
                    df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(dead)
                    return
        fresh.select("content_hash").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/hashes")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# The stages of a document's work, where work starts again after each, and what must be restored for that.
STAGES = ("LOAD_DOCUMENT", "UPDATE_PROCESSING_STATUS", "DOCUMENT_CLASSIFICATION", "OCR_DECISION", "OCR_EXECUTION", "STORE_OCR_RESULTS", "DETECTION_EXECUTION", "STORE_DETECTION_RESULTS", "HUMAN_REVIEW", "REDACTION", "REPORT_GENERATION", "COMPLETE_WORKFLOW")
RESUME_AT = {
    "LOAD_DOCUMENT": "DOCUMENT_CLASSIFICATION", "UPDATE_PROCESSING_STATUS": "DOCUMENT_CLASSIFICATION", "DOCUMENT_CLASSIFICATION": "OCR_DECISION", "OCR_DECISION": "OCR_DECISION", "OCR_EXECUTION": "OCR_DECISION",
    "STORE_OCR_RESULTS": "DETECTION_EXECUTION", "DETECTION_EXECUTION": "DETECTION_EXECUTION", "STORE_DETECTION_RESULTS": "HUMAN_REVIEW", "HUMAN_REVIEW": "REDACTION", "REDACTION": "REPORT_GENERATION",
    "REPORT_GENERATION": "COMPLETE_WORKFLOW", "COMPLETE_WORKFLOW": "COMPLETE_WORKFLOW",
}
NEEDS_TEXT = ("STORE_OCR_RESULTS", "DETECTION_EXECUTION", "STORE_DETECTION_RESULTS", "HUMAN_REVIEW", "REDACTION")
NEEDS_REDACTION = ("REDACTION",)


def resume_stage(jobs: DataFrame) -> DataFrame:
    """Adds resume_at to jobs (last_stage, has_text, has_redaction): where work goes on after its last finished stage.

    Work without a finished stage starts at the first; work whose stored text or
    redaction is gone starts again at classification.
    """
    at = F.try_element_at(F.create_map(*[F.lit(x) for kv in RESUME_AT.items() for x in kv]), F.col("last_stage"))
    gone = (F.col("last_stage").isin(*NEEDS_TEXT) & ~F.coalesce("has_text", F.lit(False))) | (F.col("last_stage").isin(*NEEDS_REDACTION) & ~F.coalesce("has_redaction", F.lit(False)))
    return jobs.withColumn("resume_at", F.when(F.col("last_stage").isNull(), STAGES[0]).when(gone, "DOCUMENT_CLASSIFICATION").otherwise(F.coalesce(at, F.lit(STAGES[0]))))


def retry_or_fail(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Adds next (RETRY, DEAD) and retry_count to failed jobs (retry_count, error): a redaction that failed its checks fails the same again, so it is never retried."""
    final = F.coalesce(F.col("error").isin("REDACTION_VERIFICATION_FAILED"), F.lit(False))
    again = ~final & (F.coalesce("retry_count", F.lit(0)) < most)
    return jobs.withColumn("next", F.when(again, "RETRY").otherwise("DEAD")).withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + again.cast("int"))
