"""Counters and statistics over stored vectors, queues and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import vector
from millrace.functions.text import estimated_tokens, is_blank


def embedding_metrics(docs: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row (avg_norm, zero_vectors, vectors) over vectors that are not null; norms that are NaN stay out of the average."""
    n = vector.norm(F.col(embedding))
    return docs.where(F.col(embedding).isNotNull()).agg(
        F.round(F.avg(F.when(~F.isnan(n), n)), 4).alias("avg_norm"), F.count_if(n == 0).alias("zero_vectors"), F.count("*").alias("vectors")
    )


def embedding_states(docs: DataFrame, width: int, embedding: str = "embedding") -> DataFrame:
    """(state, n): how many vectors are null, empty, of another width, NaN, zero or ok."""
    return docs.groupBy(vector.state(F.col(embedding), width).alias("state")).agg(F.count("*").alias("n"))


def content_sizes(items: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """(file_path, items, blank, tokens) per file; null contents count as blank."""
    c = F.col(content)
    return items.groupBy(F.col(path).alias("file_path")).agg(
        F.count("*").alias("items"), F.count_if(c.isNull() | is_blank(c)).alias("blank"), F.coalesce(F.sum(estimated_tokens(c)), F.lit(0)).cast("long").alias("tokens")
    )


def timing_summary(timings: DataFrame, operation: str, at: str, tie: str, value: str, last: int = 100) -> DataFrame:
    """(operation, n, avg, min, max, total) over the last timings of each operation.

    The window keeps `last` rows per operation, which Spark cuts to that number in every task before the shuffle.
    """
    w = f"row_number() over (partition by {operation} order by {at} desc, {tie} desc)"
    rows = timings.selectExpr(f"{operation} as operation", f"{value} as v", f"{w} as place").where(F.col("place") <= last)
    return rows.groupBy("operation").agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("avg_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.round(F.sum("v"), 6).alias("total_value")
    )


def error_counts(errors: DataFrame, key: str, at: str, warn_above: int = 10) -> DataFrame:
    """(key, n, last_time, warn) of error rows per key."""
    rows = errors.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.max(at).alias("last_time"))
    return rows.withColumn("warn", F.col("n") > warn_above)


def queue_sizes(items: DataFrame) -> DataFrame:
    """(file_path, items, bytes, largest) per file: UTF-8 bytes of content, tags and path of each delivered item (id once)."""
    tags = F.aggregate(F.coalesce("tags", F.array().cast("array<string>")), F.lit(0), lambda s, t: s + F.coalesce(F.octet_length(t), F.lit(0)))
    size = F.coalesce(F.octet_length("content"), F.lit(0)) + tags + F.coalesce(F.octet_length("file_path"), F.lit(0))
    once = items.select("id", "file_path", size.cast("long").alias("size")).distinct()
    return once.groupBy("file_path").agg(F.count("*").alias("items"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def queue_history(items: DataFrame, seconds: int = 3600) -> DataFrame:
    """(hour, queued, bytes, queued_so_far, bytes_so_far): what was enqueued per period, and the running totals.

    Rows are summed per period first; the running window then sees one row a period.
    """
    rows = items.where("enqueued_at is not null").groupBy(F.floor(F.col("enqueued_at") / seconds).alias("hour")).agg(F.count("*").alias("queued"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    over = "over (order by hour rows between unbounded preceding and current row)"
    return rows.selectExpr("hour", "queued", "bytes", f"sum(queued) {over} as queued_so_far", f"sum(bytes) {over} as bytes_so_far")


def folder_stats(files: DataFrame, path: str = "filepath") -> DataFrame:
    """(folder, files, bytes) per parent folder."""
    return files.groupBy(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def exported(stats: DataFrame, path: str) -> None:
    """Write a small table of statistics as one JSON file under path, replacing what was there."""
    stats.coalesce(1).write.mode("overwrite").json(path)
