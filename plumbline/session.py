"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "plumbline", memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Our own run-time setting; it goes before spark.checkpoint.dir.
FOLDER_KEY = "plumbline.shared.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """A fresh folder for tables that several tasks or jobs read.

    It lies below `folder`, else below the setting FOLDER_KEY, else below
    spark.checkpoint.dir. On a cluster one of them must name a folder that all
    machines share; only a local session falls back to a temporary one.
    """
    root = folder or spark.conf.get(FOLDER_KEY, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"name a shared folder in spark.checkpoint.dir or in {FOLDER_KEY}")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set(FOLDER_KEY, root)
    path = f"{root.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_written(spark: SparkSession) -> int:
    """Delete the folders this process has asked for so far; call it when no result is read any more."""
    jvm, removed = spark._jvm, 0
    for path in _made:
        place = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    _made.clear()
    return removed


def written(df: DataFrame, partitions: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage at a point that survives lost executors, and lets several
    consumers share one computation.
    """
    path = shared_dir(df.sparkSession)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
