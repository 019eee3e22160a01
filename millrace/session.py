"""Session defaults and tables written to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(app: str = "millrace", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can reach.

    Where it is unset, a temporary folder is made and remembered in the session's settings, but only on one machine: no other could
    read what is written there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, one subfolder per application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and return a scan of it.

    What was written survives the loss of executors, and a second use neither runs Python code again nor shuffles again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, path: str, *by: str) -> int:
    """Write df to path, overwriting it, in subfolders by the given columns; returns the number of rows, which the write itself counts."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    return seen.get["n"]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that is read no more."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def marked_done(spark: SparkSession, path: str, text: str = "") -> None:
    """Create a small file, which shows to every reader at once that what it stands for is complete. It replaces an earlier one.

    It is written under a hidden name first, so that no reader sees half of it.
    """
    folder, name = path.rsplit("/", 1)
    fs, hidden = _fs(spark, f"{folder}/.{name}.new")
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, p = _fs(spark, path)
    fs.delete(p, False)
    fs.rename(hidden, p)


def marks(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and texts of the files that marked_done left in a folder."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return {}
    out = {}
    for status in fs.listStatus(p):
        if status.getPath().getName().startswith("."):
            continue
        stream = fs.open(status.getPath())
        try:
            out[status.getPath().getName()] = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    return out


def scan(spark: SparkSession, schema: str, *paths: str, base: str | None = None) -> DataFrame:
    """The Parquet rows under those of the paths that exist; a write of no rows in partitions leaves none. base: the folder below
    which parts of a path like `part=3` are columns, if the schema names them."""
    there = [p for p in paths if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    if not there:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if base is None:
        return reader.parquet(*there)
    return reader.option("basePath", base).parquet(*there).select(*(f"`{c}`" for c in StructType.fromDDL(schema).names))


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's folder under the shared folder, once its results have been read."""
    dropped(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
