"""Arrow files, as legacy score tables come."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type


def _plain(t: pa.DataType) -> pa.DataType:
    """Spark has no half precision and no dictionaries."""
    if pa.types.is_float16(t):
        return pa.float32()
    return _plain(t.value_type) if pa.types.is_dictionary(t) else pa.string() if pa.types.is_large_string(t) else t


def _tables(raw: bytes):
    with pa.ipc.open_file(pa.BufferReader(raw)) as f:
        for k in range(f.num_record_batches):
            yield f.get_batch(k)


def read_feather(spark: SparkSession, path: str, wide_as: tuple[str, str, str] | None = None) -> DataFrame:
    """The files at ``path``, one task each.  ``wide_as`` = (key, name, value) turns a column a spot into long rows
    of the first column, the column's name and its value, without zeros: a plan never holds thousands of columns."""
    files = spark.read.format("binaryFile").load(path)
    if wide_as:
        key, name, value = wide_as

        def long(batches):
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    for b in _tables(raw):
                        keys = b.column(0).cast(pa.string())
                        for k in range(1, b.num_columns):
                            x = b.column(k).cast(pa.float32())
                            keep = pa.compute.fill_null(pa.compute.not_equal(x, 0.0), False)
                            n = pa.compute.sum(keep).as_py() or 0
                            yield pa.RecordBatch.from_arrays([keys.filter(keep), pa.array([b.schema.names[k]] * n, pa.string()), x.filter(keep)], names=[key, name, value])

        import pyarrow.compute  # noqa: F401

        return files.select("content").mapInArrow(long, f"{key} string, {name} string, {value} float")
    first = files.select("content").first()
    if first is None:
        raise ValueError(f"nothing at {path}")
    schema = next(_tables(first["content"])).schema
    fields = [pa.field(f.name, _plain(f.type)) for f in schema]

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for b in _tables(raw):
                    yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in fields], names=[f.name for f in fields])

    return files.select("content").mapInArrow(run, T.StructType([T.StructField(f.name, from_arrow_type(f.type)) for f in fields]))
