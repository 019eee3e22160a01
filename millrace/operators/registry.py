"""The registry of processed files: change detection, counters, statistics and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.functions.validate import INPUT_EXTENSIONS, extension

#: A file counts as changed in time if its mtime differs by more than so many seconds.
MTIME_SLACK = 1.0


def latest(registry: DataFrame, order: str = "record_no", path: str = "filepath") -> DataFrame:
    """The last record of each file. Rows are reduced before the shuffle, so a file registered any number of times is no hot key."""
    others = [c for c in registry.columns if c not in (order, path)]
    rows = registry.where(F.col(path).isNotNull()).groupBy(path).agg(F.max(F.struct(order, *others)).alias("r"))
    return rows.select(path, "r.*").select(*registry.columns)


def checksum(c: Column) -> Column:
    """The checksum in lower case without surrounding white space; null for an empty one."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def changes(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(filepath, should_process, reason) of each file of a listing against the registry's latest records.

    files: (filepath, found, size, mtime, checksum); `found` false for a path without a file, null where that could not be seen.
    registry: (filepath, size, mtime, checksum), one row a path. The first that holds: file_not_found, new_file, size_changed,
    time_changed, content_changed (only for files with bytes and both checksums known), already_processed; where size or mtime is
    unknown, error_checking, which is processed.
    """
    old = registry.select("filepath", F.lit(True).alias("known"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), checksum(F.col("checksum")).alias("old_sum"))
    rows = files.join(old, "filepath", "left")
    reason = (
        F.when(~F.col("found"), "file_not_found")
        .when(F.col("found").isNull(), "error_checking")
        .when(F.col("known").isNull(), "new_file")
        .when(F.col("size").isNull() | F.col("mtime").isNull() | F.col("old_size").isNull() | F.col("old_mtime").isNull(), "error_checking")
        .when(F.col("size") != F.col("old_size"), "size_changed")
        .when(F.abs(F.col("mtime") - F.col("old_mtime")) > MTIME_SLACK, "time_changed")
        .when((F.col("size") > 0) & (checksum(F.col("checksum")) != F.col("old_sum")), "content_changed")
        .otherwise("already_processed")
    )
    return rows.select("filepath", (~reason.isin("file_not_found", "already_processed")).alias("should_process"), reason.alias("reason"))


def verdicts(changed: DataFrame) -> DataFrame:
    """(filepath, ready, message) of each file of changes(): whether it may be processed, and what that would mean."""
    supported = extension(F.col("filepath")).isin(*INPUT_EXTENSIONS)
    message = (
        F.when(F.col("reason") == "file_not_found", "File does not exist")
        .when(~supported, F.concat(F.lit("Unsupported file type: "), extension(F.col("filepath"))))
        .when(F.col("should_process"), "Ready for processing (new/changed file)")
        .otherwise("Ready for processing (will reprocess)")
    )
    return changed.select("filepath", (supported & (F.col("reason") != "file_not_found")).alias("ready"), message.alias("message"))


def change_counts(changed: DataFrame) -> DataFrame:
    """One row of counters; a file that was not found is skipped and counts as an error too."""
    of = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    return changed.agg(
        F.count("*").alias("total_files"), F.count_if("should_process").alias("files_to_process"), F.count_if(~F.col("should_process")).alias("files_skipped"),
        of("new_file").alias("new_files"), of("size_changed").alias("size_changed"), of("time_changed").alias("time_changed"), of("content_changed").alias("content_changed"),
        of("already_processed").alias("already_processed"), of("file_not_found", "error_checking").alias("error_files"),
    )


def missing(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registry rows whose path is not in the listing: what a clean-up removes."""
    return registry.join(files.select("filepath"), "filepath", "left_anti")


def kept(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registry rows whose path is in the listing."""
    return registry.join(files.select("filepath"), "filepath", "left_semi")


def stats(registry: DataFrame) -> DataFrame:
    """One row; averages of an empty registry are 0, its extremes null. Null counts and sizes add nothing."""
    n = F.count("*")
    return registry.agg(
        n.alias("total_files"), F.coalesce(F.sum("records_count"), F.lit(0)).alias("total_records"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1048576, 6).alias("total_size_mb"),
        F.round(F.when(n > 0, F.coalesce(F.sum("records_count"), F.lit(0)) / n).otherwise(0.0), 6).alias("avg_records_per_file"),
        F.min("records_count").alias("min_records_per_file"), F.max("records_count").alias("max_records_per_file"), F.count_if(F.col("records_count") == 0).alias("files_with_no_records"),
        F.max("processed_at").alias("most_recent_processing"), F.min("processed_at").alias("oldest_processing"),
    )


def recent(registry: DataFrame, k: int = 5) -> DataFrame:
    """The k records processed last, by processed_at descending and path."""
    return registry.select("filepath", "processed_at", "records_count").where("processed_at is not null").orderBy(F.desc("processed_at"), "filepath").limit(k)
