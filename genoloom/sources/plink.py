"""PLINK genotype files as a data source: a partition for each range of variants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The file's first bytes, and the calls of two bits from the low end; 9 is missing.
MAGIC = bytes([0x6C, 0x1B, 0x01])
CALLS = np.array([0, 9, 1, 2], np.int8)


def decode(raw: bytes, n: int) -> np.ndarray:
    """Calls of ``n`` individuals by variant.  Codes in file order: 00 is 0, 01 (low bit set) missing, 10 is 1, 11 is 2."""
    width = -(-n // 4)
    two = np.frombuffer(raw, np.uint8).reshape(-1, width)
    codes = (two[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return CALLS[codes.reshape(len(two), -1)[:, :n]]


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.n, self.m = options["path"], int(options["individuals"]), int(options["variants"])
        self.rows = int(options.get("rows", 20_000))
        self.chr = int(options.get("chr", 0))

    def partitions(self):
        width = -(-self.n // 4)
        with open(self.path, "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path} is no variant-major genotype file")
            f.seek(0, 2)
            if f.tell() != 3 + self.m * width:
                raise ValueError(f"{self.path} does not hold {self.m} variants of {self.n} individuals")
        return [_Range(a, min(a + self.rows, self.m)) for a in range(0, self.m, self.rows)]

    def read(self, part):
        width = -(-self.n // 4)
        with open(self.path, "rb") as f:
            f.seek(3 + part.start * width)
            at = part.start
            while at < part.stop:
                k = min(1000, part.stop - at)
                calls = decode(f.read(k * width), self.n)
                values = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * self.n, pa.int32()), pa.array(calls.ravel(), pa.int8()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, self.chr), pa.int32()), pa.array(np.arange(at, at + k), pa.int64()), values], names=["chr", "idx", "g"])
                at += k


class PlinkSource(DataSource):
    """``spark.read.format("plink_bed")`` with path, individuals, variants, and chr and rows a partition if wanted.
    The file has to be at the same path on every executor; ``read_bed_files`` reads through Spark instead."""

    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return "chr int, idx long, g array<tinyint>"

    def reader(self, schema):
        return _Reader(self.options)


def read_bed(spark: SparkSession, path: str, individuals: int, variants: int, chr: int = 0, rows: int = 20_000) -> DataFrame:
    spark.dataSource.register(PlinkSource)
    return spark.read.format("plink_bed").options(individuals=individuals, variants=variants, chr=chr, rows=rows).load(path)


def read_bed_files(spark: SparkSession, path: str, individuals: int, chr: int = 0) -> DataFrame:
    """As ``read_bed`` from any store that Spark reads: one task a file, for panels cut by chromosome."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw[:3] != MAGIC:
                    raise ValueError("no variant-major genotype file")
                width, m = -(-individuals // 4), 0
                while (block := raw[3 + m * width : 3 + (m + 1000) * width]):
                    calls = decode(block, individuals)
                    k = len(calls)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * individuals, pa.int32()), pa.array(calls.ravel(), pa.int8()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chr), pa.int32()), pa.array(np.arange(m, m + k), pa.int64()), values], names=["chr", "idx", "g"])
                    m += k

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "chr int, idx long, g array<tinyint>")
