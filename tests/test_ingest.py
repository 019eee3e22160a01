from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.operators import embed, metrics
from millrace.plans.ingest import Store, ingest, to_process
from millrace.sources import files
from millrace.sources.files import listing
from millrace.streaming.ingest import embed_stream, item_stream, watch_folder, windowed_counts

SMALL = Settings(dim=16, retry_seconds=0.0)


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def folder(tmp_path):
    root = str(tmp_path / "in")
    write(root, "a.txt", "first words")
    write(root, "__init__.py", "def f():\n    return 1\n")
    write(root, ".hidden/B.TXT", "second words")
    write(root, "sub/c.json", '[{"k": 1}, {"k": 2}]')
    write(root, "sub/skip.md", "no")
    return root


def test_listing_sees_hidden_and_underscored_names(spark, tmp_path):
    root = folder(tmp_path)
    assert {os.path.relpath(r.path, root) for r in listing(spark, root).collect()} == {"a.txt", "__init__.py", ".hidden/B.TXT", "sub/c.json"}


def test_ingest_changes_and_replacement(spark, tmp_path):
    root, store = folder(tmp_path), Store(spark, str(tmp_path / "store"))
    r = ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL).first()
    assert (r.files, r.records, r.stored, r.dead, r.batch) == (4, 5, 5, 0, 1)
    assert ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL).first().files == 0
    path = write(root, "a.txt", "changed words here")
    assert ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL).first().files == 1
    assert {x.content for x in store.documents().where(F.col("file_path") == path).collect()} == {"first words", "changed words here"}
    assert {x.content for x in store.documents(replaced=True).where(F.col("file_path") == path).collect()} == {"changed words here"}
    store.compact("documents", 1, 1)
    assert store.documents().count() == 6


@pytest.mark.parametrize("lost", ["staged", "records", "embedded", "documents", "dead_letters", "registry", "commit"])
def test_a_run_that_fails_anywhere_is_repeated_without_trace(spark, tmp_path, monkeypatch, lost):
    root, store = folder(tmp_path), Store(spark, str(tmp_path / "store"))
    write_table = Store.write

    def failing(self, df, name, batch):
        out = write_table(self, df, name, batch)
        if name == lost:  # after the table has been written
            raise RuntimeError("lost")
        return out

    def no_commit(self, batch, versions):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "write", failing)
        if lost == "commit":
            m.setattr(Store, "commit", no_commit)
        with pytest.raises(RuntimeError):
            ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL)
    assert store.documents().count() == store.registry().count() == 0
    r = ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL).first()
    assert (r.files, r.stored) == (4, 5)
    rows = store.documents()
    assert rows.count() == 5 == rows.select("id").distinct().count() and store.registry().count() == 4
    assert ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL).first().files == 0


def test_progress_and_description(spark, tmp_path):
    seen = []
    root, store = folder(tmp_path), Store(spark, str(tmp_path / "store"), lambda *x: seen.append(x))
    ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL)
    assert seen == [("staged", 1, 4), ("records", 1, 5), ("embedded", 1, 5), ("documents", 1, 5), ("dead_letters", 1, 0), ("registry", 1, 4)]
    assert {(r.table, r.batches, r.rows) for r in store.describe().collect()} == {("documents", 1, 5), ("dead_letters", 0, 0), ("registry", 1, 4)}
    metrics.exported(store.describe(), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).count() == 3


def test_readers_work_while_a_batch_is_compacted(spark, tmp_path, monkeypatch):
    root, store = folder(tmp_path), Store(spark, str(tmp_path / "store"))
    ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL)
    before = store.documents()

    def crash(self, batch, versions):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", crash)
        with pytest.raises(RuntimeError):
            store.compact("documents", 1, 1)  # the new version is there, but not committed
    assert store.documents().count() == 5
    store.compact("documents", 1, 1)
    store.compact("documents", 1, 1)
    assert before.count() == store.documents().count() == 5 and len(store.documents().inputFiles()) == 1
    store.vacuum()
    assert store.documents().count() == 5 and not os.path.exists(f"{store.root}/documents/batch=1/version=0")


def test_unchanged_files_are_only_hashed(spark, tmp_path, monkeypatch):
    root, store = folder(tmp_path), Store(spark, str(tmp_path / "store"))
    ingest(store, listing(spark, root), embed.HashingEmbedder(16), SMALL)
    chosen = to_process(listing(spark, root), store.registry())
    assert chosen.count() == 0
    path = os.path.join(root, "a.txt")
    before = os.stat(path)
    write(root, "a.txt", "FIRST words")  # same size, and the same time as far as the registry tells
    os.utime(path, (before.st_atime, before.st_mtime))
    assert [(r.path, r.reason, bytes(r.data)) for r in to_process(listing(spark, root), store.registry()).collect()] == [(path, "content_changed", b"FIRST words")]


def test_listing_shares_out_deep_and_flat_folders(spark, tmp_path):
    root = str(tmp_path / "deep")
    want = {write(root, f"one/two/s{i}/t{j}/f{k}.txt", "x") for i in range(5) for j in range(4) for k in range(3)}
    rows = listing(spark, root)
    assert {r.path for r in rows.collect()} == want and rows.rdd.getNumPartitions() >= 20
    assert listing(spark, str(tmp_path / "absent")).count() == 0
    assert {r.path for r in listing(spark, f"file://{root}").collect()} == {f"file://{p}" for p in want}
    assert files.with_data(listing(spark, f"file://{root}").select("path")).where("data is not null and checksum is not null").count() == len(want)


class Flaky:
    """Fails whole batches that hold 'bad'."""

    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("model said no")
        return [[0.0] * 16 if "zero" in t else [1.0] * (3 if "narrow" in t else 16) for t in texts]


def test_failures_become_dead_letters(spark):
    rows = spark.createDataFrame([("good", 1), ("bad", 2), ("zero", 3), ("narrow", 4), (" ", 5), (None, 6)], "content string, embedding int")
    good, dead = embed.split(embed.embedded(rows, Flaky(), SMALL))
    assert [r.content for r in good.collect()] == ["good"]
    assert {(r.content, r.reason) for r in dead.collect()} == {("bad", "ValueError: model said no"), ("zero", "zero"), ("narrow", "width")}


def test_stream_stores_each_item_once(spark, tmp_path, data):
    items = spark.read.parquet(f"{data}/queue_items.parquet")
    src = str(tmp_path / "items")
    items.repartition(4).write.parquet(src)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # a restart goes on after what is done
        embed_stream(item_stream(spark, src, 2), embed.HashingEmbedder(16), out, mark, SMALL).awaitTermination()
    got = spark.read.parquet(f"{out}/documents")
    assert got.count() == got.select("id").distinct().count()
    stored = {r.id for r in got.collect()} | {r.id for r in spark.read.parquet(f"{out}/dead_letters").collect()}
    assert stored == {r.id for r in items.collect() if r.id and r.content and r.content.strip()}


def test_a_watched_folder(spark, tmp_path):
    root, store = folder(tmp_path), Store(spark, str(tmp_path / "store"))
    tick = lambda: watch_folder(store, root, embed.HashingEmbedder(16), str(tmp_path / "mark"), SMALL, once=True).awaitTermination()
    tick()
    assert store.documents().count() == 5
    tick()  # nothing new
    assert sorted(store.commits()) == [1]
    write(root, "a.txt", "changed words here")
    write(root, "sub/new.txt", "new words")
    tick()
    assert store.documents().count() == 7 and sorted(store.commits()) == [1, 2]


def test_windowed_counts_of_a_stream(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "events")
    events.write.parquet(src)
    counts = windowed_counts(spark.readStream.schema(events.schema).parquet(src), "ts", "event_type")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
