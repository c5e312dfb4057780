"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a folder is made for local masters only:
    on a cluster a machine-local folder would be lost with its executor, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tabulark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _store(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def new_folder(spark: SparkSession, tag: str) -> str:
    """A name in the shared folder; what is written there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    store, at = _store(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def put_text(spark: SparkSession, text: str, name: str) -> str:
    """Path of a file of that text in the shared folder."""
    path = f"{new_folder(spark, 'text')}/{name}"
    store, at = _store(spark, path)
    out = store.create(at)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def _written(df: DataFrame, tag: str):
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives executors. It is
    there until the application ends."""
    return _written(df, tag)[0]


class Scratch:
    """Tables an operator writes on its way to a result that it writes too: leaving the `with` block deletes
    them. Spark drops the shuffle files of plans that are done when the driver's JVM collects them, so it is asked to."""

    def _collect(self):
        self.spark.range(1).count()  # the listeners' queues hold the last execution and its shuffles until the next one
        self.spark._jvm.System.gc()

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self):
        return self

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = _written(df, tag)
        self.paths.append(path)
        self._collect()
        return out

    def drop(self):
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
        self._collect()

    def __exit__(self, *_):
        self.drop()
