"""Tables that cut lineage, in the folder which all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a row group: what a writer or a reader of a table holds at once.
ROW_GROUP = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="genoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many texts: a worker's memory then follows the texts' length, not the table's."""
    _arrays_apart()
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """A folder for the tables of one run; it goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/genoloom-{uuid.uuid4().hex}"
        self._path(self.root)[1].deleteOnExit(self._path(self.root)[0])

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again: later jobs start from the files, wherever an executor was lost."""
        where = f"{self.root}/{name}"
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def without(self, docs: DataFrame, gone: DataFrame, keys: dict, slots: int = 1 << 18) -> DataFrame:
        """``docs`` without the rows whose ``keys`` (names of columns of ``gone``, and expressions over docs that are
        never null) are in ``gone``.  A table of at most ``slots`` hash values is broadcast, so that only rows that
        fall into a slot of one that goes are joined, and shuffled where ``gone`` is large."""
        row, slot = "row" + uuid.uuid4().hex, "slot" + uuid.uuid4().hex
        marks = gone.select(F.pmod(F.xxhash64(*keys), F.lit(slots)).alias(slot)).distinct()
        marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *[k.alias(n) for n, k in keys.items()])
        marked = marked.withColumn(slot, F.pmod(F.xxhash64(*keys), F.lit(slots)))
        by = marked.join(F.broadcast(marks), slot, "left_anti").select(f"{row}.*")
        near = marked.join(F.broadcast(marks), slot, "left_semi").join(gone, list(keys), "left_anti").select(f"{row}.*")
        return by.union(near)

    def tidy(self) -> None:
        """Lets Spark drop the shuffle files of what is no longer referred to, which otherwise waits for the driver's
        own garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        path, fs = self._path(f"{self.root}/{name}")
        fs.delete(path, True)


def lean(run, apart: int = 1 << 19):
    """``run`` over batches, after which a worker gives memory that it freed back: workers live on from task to task,
    and what one operator left would be held beside what the next one needs.  Arrays under ``apart`` bytes are kept
    for the next ones meanwhile: more is faster where many are made in turn."""

    def lean_run(batches):
        _arrays_apart(apart)
        try:
            yield from run(batches)
        finally:
            _arrays_apart()
            give_back()

    return lean_run


def _arrays_apart(size: int = 1 << 19) -> None:
    """Arrays from ``size`` bytes (512 KB) on get pages of their own, which go back when they are freed."""
    _c_library(lambda c: (c.mallopt(-3, size), c.mallopt(-1, size if size == 1 << 19 else 8 * size)))


def _c_library(use) -> None:
    import ctypes

    try:
        use(ctypes.CDLL("libc.so.6"))
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """Memory that this process freed goes back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    _c_library(lambda c: c.malloc_trim(0))
