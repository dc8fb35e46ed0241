"""Query shapes of the audit database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last row of each key by (order, values); one aggregate, no sort."""
    return df.groupBy(key).agg(F.max(F.struct(order, *values)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in (order, *values)])


def top_recent(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def visible_to(df: DataFrame, owner: Column, mail: Column, user: str, user_mail: str, role: str) -> DataFrame:
    """Row-level access: reviewers and admins see all, others their own rows and unowned rows that carry their mail."""
    if role in ("REVIEWER", "ADMIN"):
        return df
    return df.where((owner == user) | (owner.isNull() & (F.lower(mail) == user_mail.lower())))


def run_outcomes(jobs: DataFrame) -> DataFrame:
    """run_id, total, completed, failed, status: COMPLETED or FAILED by the last job once all are through, else RUNNING."""
    n = jobs.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.max_by("status", F.struct("finished_at", "job_id")).alias("last"))
    done = F.col("completed") + F.col("failed") == F.col("total")
    return n.select("run_id", "total", "completed", "failed", F.when(done, F.col("last")).otherwise("RUNNING").alias("status"))


def page_key(c: Column) -> Column:
    """Sort key of page numbers kept as text: numbers first, in order, then the rest."""
    return F.struct(c.try_cast("int").isNull(), c.try_cast("int"), c)


def run_name(number: Column) -> Column:
    return F.format_string("RUN-%06d", number)


def canonical_provider(name: Column) -> Column:
    """The name shown for a model's provider: Azure or Gemma for what contains or stands for them, else the name as given; blank is none."""
    given = F.nullif(F.trim(name), F.lit(""))
    key = F.translate(F.lower(given), "- ", "__")
    return F.when(F.contains(key, F.lit("azure")), "Azure").when(F.contains(key, F.lit("gemma")) | (key == "ollama"), "Gemma").otherwise(given)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys`` (what DELETE ... IN leaves): rows with a null key stay."""
    return df.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of new, and what old holds of other keys: delete-then-insert as one table."""
    return without_keys(old, new, key).unionByName(new)
