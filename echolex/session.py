"""Sessions, and tables that cut a plan's lineage in storage that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, **settings: str) -> SparkSession:
    """A single-JVM session for tests, the bench and the command line."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("echolex")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


_own_folder: str | None = None
_made: list["Scratch"] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where that is unset, a local session (tests, the command line) gets a folder
    of its own that is removed at the end; any other is an error."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="echolex-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Removes what the operators called inside wrote to the shared folder, at the end. Their results read it, so they
    have to be written or collected inside. Outside of such a block the folders `echolex-*` are the caller's to remove."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            made = _made.pop()
            made.drop(made.root)


def small_table(spark: SparkSession, **columns) -> DataFrame:
    """A table of arrays that are known on the driver, as a relation whose size the planner knows."""
    return spark.createDataFrame(pa.table(columns))


class Scratch:
    """Tables written to the shared folder during one query.

    A table survives the loss of any executor, unlike a cached or locally checkpointed one. `drop` removes a table
    that no later step reads, so that iterative operators hold a bounded number of them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/echolex-{name}-{uuid.uuid4().hex}"
        self.made = 0
        _made.append(self)

    def write(self, df: DataFrame) -> str:
        self.made += 1
        path = f"{self.root}/{self.made:04d}"
        df.write.parquet(path)
        return path

    def read(self, path: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(path)

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows of `df`, computed once and read from the shared folder from here on."""
        return self.read(self.write(df), df.schema)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of steps that are done, which it does when the driver collects garbage;
        a long query would otherwise hold those of all its steps."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
