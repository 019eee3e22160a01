"""The folder pipeline: list, compare with the registry, parse, embed, store, and only then commit.

Everything of a run lies under `batch=<number>/version=<number>` subfolders of the store. A batch counts once its mark under `commits`
exists, which is written last and in one step and names the version of each table; nothing else is read, the registry included. A run
that failed before has left nothing that a reader sees, and is simply begun again: it overwrites what is there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.operators import embed, parse, registry
from millrace.operators.embed import Embedder
from millrace.session import counted, dropped, marked_done, marks, scan
from millrace.sources import files

DOCUMENTS = "id bigint, content string, tags array<string>, created_at timestamp, embedding array<float>, file_path string, chunk_index int, batch int"
DEAD = "file_path string, chunk_index int, content string, tags array<string>, reason string, batch int"
REGISTRY = "filepath string, size bigint, mtime double, checksum string, processed_at timestamp, records_count bigint, batch int"


@dataclass
class Store:
    """Tables of one store: documents, dead letters and the registry, in which each committed batch has its rows."""

    spark: SparkSession
    root: str
    progress: Callable[[str, int, int], None] | None = None
    """Called with table, batch and rows after each table has been written; the write itself counts them."""

    def commits(self) -> dict[int, dict[str, int]]:
        """The version of each table of each committed batch. A batch's marks are numbered; the last one counts."""
        found = sorted((*map(int, name.split(".")), text) for name, text in marks(self.spark, f"{self.root}/commits").items())
        return {batch: json.loads(text) for batch, _, text in found}

    def commit(self, batch: int, versions: dict[str, int]) -> None:
        last = max((int(n.split(".")[1]) for n in marks(self.spark, f"{self.root}/commits") if n.split(".")[0] == str(batch)), default=-1)
        marked_done(self.spark, f"{self.root}/commits/{batch}.{last + 1}", json.dumps(versions))

    def path(self, name: str, batch: int, version: int = 0) -> str:
        return f"{self.root}/{name}/batch={batch}/version={version}"

    def _committed(self, name: str, schema: str) -> DataFrame:
        return scan(self.spark, schema, *(self.path(name, b, v.get(name, 0)) for b, v in self.commits().items()), base=f"{self.root}/{name}")

    def registry(self) -> DataFrame:
        """The last record of each file."""
        return registry.latest(self._committed("registry", REGISTRY), "batch")

    def documents(self, replaced: bool = False) -> DataFrame:
        """Stored rows of committed batches. A changed file's older rows stay; with replaced, only its last batch counts."""
        rows = self._committed("documents", DOCUMENTS)
        if not replaced:
            return rows
        last = self.registry().select(F.col("filepath").alias("file_path"), F.col("batch"))
        return rows.join(last, ["file_path", "batch"], "left_semi")

    def dead_letters(self) -> DataFrame:
        return self._committed("dead_letters", DEAD)

    def next_batch(self) -> int:
        return max(self.commits(), default=0) + 1

    def write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        rows = counted(df, self.path(name, batch))
        if self.progress:
            self.progress(name, batch, rows)
        return self.spark.read.schema(df.schema).parquet(self.path(name, batch))

    def compact(self, name: str, batch: int, files: int) -> None:
        """Rewrite one batch of a table with so many files, as a further version; readers see the one or the other.

        The old version stays for those who read it now, until vacuum().
        """
        versions = self.commits()[batch]
        old = versions.get(name, 0)
        self.spark.read.parquet(self.path(name, batch, old)).repartition(files).write.mode("overwrite").parquet(self.path(name, batch, old + 1))
        self.commit(batch, versions | {name: old + 1})

    def describe(self) -> DataFrame:
        """(table, batches, rows, first_batch, last_batch) of what is committed."""
        tables = {"documents": DOCUMENTS, "dead_letters": DEAD, "registry": REGISTRY}
        out = None
        for name, schema in tables.items():
            part = self._committed(name, schema).agg(F.lit(name).alias("table"), F.count_distinct("batch").alias("batches"), F.count("*").alias("rows"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"))
            out = part if out is None else out.unionByName(part)
        return out

    def vacuum(self) -> None:
        """Delete versions that compact() has replaced, and what only a run itself needed."""
        for batch, versions in self.commits().items():
            for name, last in versions.items():
                for version in range(last):
                    dropped(self.spark, self.path(name, batch, version))
            for name in ("staged", "records", "embedded"):
                dropped(self.spark, f"{self.root}/{name}/batch={batch}")


def to_process(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a listing (path, size, mtime) that have to be processed, with their data; and why.

    Size and time decide first; only files that these leave undecided are read for their checksum. Data is loaded for the chosen only.
    """
    seen = listing.select(F.col("path").alias("filepath"), F.lit(True).alias("found"), "size", "mtime", F.lit(None).cast("string").alias("checksum"))
    first = registry.changes(seen, known)
    decided = listing.join(first.where("should_process").select(F.col("filepath").alias("path"), "reason"), "path")
    undecided = listing.join(first.where("reason = 'already_processed'").select(F.col("filepath").alias("path")), "path", "left_semi")
    sums = registry.checksum(F.col("checksum"))
    old = known.where("size > 0").select(F.col("filepath").alias("path"), sums.alias("old_sum")).where("old_sum is not null")
    again = files.with_checksums(undecided.join(old, "path")).where(sums != F.col("old_sum")).select("path", "size", "mtime", F.lit("content_changed").alias("reason"))
    return files.with_data(decided.select("path", "size", "mtime", "reason").unionByName(again))


def ingest(store: Store, listing: DataFrame, embedder: Embedder, settings: Settings = Settings(), batch: int | None = None) -> DataFrame:
    """One run over a listing of files; returns its summary: (files, records, stored, dead, batch). Where no file is new or has changed,
    nothing is committed."""
    batch = batch or store.next_batch()
    chosen = to_process(listing, store.registry())
    staged = store.write(chosen.where("data is not null").select("path", "size", "mtime", "checksum", "data", "reason"), "staged", batch)
    if staged.isEmpty():
        return store.spark.createDataFrame([(0, 0, 0, 0, batch)], "files long, records long, stored long, dead long, batch int")
    records = store.write(parse.parsed(staged).select("file_path", "chunk_index", "content", "tags"), "records", batch)
    good, dead = embed.split(store.write(embed.embedded(records, embedder, settings), "embedded", batch))
    ident = F.xxhash64("file_path", "chunk_index", "content").alias("id")
    good = good.select(ident, "content", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.current_timestamp().alias("created_at"), "embedding", "file_path", "chunk_index")
    stored, lost = store.write(good, "documents", batch), store.write(dead.select("file_path", "chunk_index", "content", "tags", "reason"), "dead_letters", batch)
    counts = records.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("records_count"))
    done = staged.join(counts, "path", "left").select(F.col("path").alias("filepath"), "size", "mtime", "checksum", F.current_timestamp().alias("processed_at"), F.coalesce("records_count", F.lit(0)).cast("long").alias("records_count"))
    store.write(done, "registry", batch)
    store.commit(batch, {"documents": 0, "dead_letters": 0, "registry": 0})
    # one row each
    one = lambda df, alias: df.agg(F.count("*").alias(alias))
    return one(staged, "files").crossJoin(one(records, "records")).crossJoin(one(stored, "stored")).crossJoin(one(lost, "dead")).withColumn("batch", F.lit(batch))
