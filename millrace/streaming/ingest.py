"""Ingest as streams: queue items that arrive in a folder are embedded and stored, each micro-batch once; a folder of files is watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import Settings
from millrace.operators import embed
from millrace.operators.embed import Embedder
from millrace.operators.lookup import marked
from millrace.plans.ingest import Store, ingest
from millrace.session import scan
from millrace.sources.files import listing

#: Parts of the ids that were stored.
PARTS = 16

ITEMS = "id string, content string, tags array<string>, file_path string, chunk_index int, enqueued_at double, size_bytes bigint"


def item_stream(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """Parquet files of queue items as they arrive; so many at most per micro-batch (the queue's back-pressure)."""
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def embed_stream(items: DataFrame, embedder: Embedder, out: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Start a query that stores embedded items under `out`/documents and failures under `out`/dead_letters, until no files are left.

    An item delivered again (same id), however late, is dropped: within a micro-batch, and against the ids of the batches before,
    which lie in PARTS parts by a hash. Only the parts of the new ids are read, and only ids that a bit map of the new ones lets through
    are shuffled. Each micro-batch writes to subfolders of its own number, so that one that is repeated after a failure replaces itself.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")

    def store(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.where("id is not null").dropDuplicates(["id"])
        ids = f"{out}/ids/batch={number}"
        new.select("id", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(ids)
        if number > 0:
            own = scan(spark, "id string, part int", ids, base=f"{out}/ids")
            there = [r[0] for r in own.select("part").distinct().collect()]  # at most PARTS numbers
            done = scan(spark, "id string, batch int, part int", f"{out}/ids", base=f"{out}/ids").where((F.col("batch") < number) & F.col("part").isin(there))
            new = new.join(marked(done.select("id"), own, "id"), "id", "left_anti")
        path = f"{out}/embedded/batch={number}"
        embed.embedded(new, embedder, settings).write.mode("overwrite").parquet(path)
        good, dead = embed.split(spark.read.parquet(path))
        good.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        dead.write.mode("overwrite").parquet(f"{out}/dead_letters/batch={number}")

    return items.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_folder(store: Store, root: str, embedder: Embedder, checkpoint: str, settings: Settings = Settings(), every: str = "1 minute", once: bool = False) -> StreamingQuery:
    """Ingest a folder of files again and again: a stream of ticks, each of which runs the folder pipeline over a new listing.

    A file source would see each path once; here changed files are found by the comparison with the registry, and a run is exactly
    once by its commit, whatever becomes of a tick. A tick without new or changed files stores nothing. once: one tick, then the end.
    """
    spark = store.spark
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def run(rows: DataFrame, number: int) -> None:
        ingest(store, listing(spark, root), embedder, settings)

    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) of an event stream per time window; a window is final once events are `late` beyond its end."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, window), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "key", "n")
