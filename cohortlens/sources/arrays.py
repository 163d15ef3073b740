"""Stores of binary arrays: fixed-length records read in ranges by all tasks, with shape checks; metadata and normalization beside them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expect import Unmet, nothing

FORMAT = "org.apache.spark.input.FixedLengthBinaryInputFormat"
WRITABLES = ("org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")


def file_length(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def read_array(spark: SparkSession, path: str, dtype: str, shape: Sequence[int], rows: int | None = None) -> DataFrame:
    """position (from 0), values (a record's numbers, flattened) of a raw array of records of this shape.

    The file is split into ranges of whole records, so it may be larger than any task's memory. A length that is no number of records, or not
    rows of them, is refused.
    """
    kind = np.dtype(dtype)
    record = kind.itemsize * math.prod(shape)
    length = file_length(spark, path)
    if length % record or rows is not None and length != rows * record:
        raise Unmet(f"{path} has {length} bytes, not {'whole' if rows is None else rows} records of {record}")
    # The one reader of fixed-length records that Spark has is an input format of its RDDs.
    raw = spark.sparkContext.newAPIHadoopFile(path, FORMAT, *WRITABLES, conf={f"{FORMAT}.recordLength": str(record)})
    out = "float" if kind.itemsize < 8 and kind.kind == "f" else "double" if kind.kind == "f" else "long"
    arrow = {"float": pa.float32(), "double": pa.float64(), "long": pa.int64()}[out]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [pa.array(np.frombuffer(b.as_buffer(), kind).astype(arrow.to_pandas_dtype())) for b in batch.column("bytes")]
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array([v.tolist() for v in values], pa.list_(arrow))], ["position", "values"])

    rows_ = spark.createDataFrame(raw.map(lambda kv: (kv[0], bytes(kv[1]))), "position long, bytes binary")
    return rows_.mapInArrow(decode, f"position long, values array<{out}>")


def read_store(spark: SparkSession, root: str, leads: int, samples: int, labels: int) -> DataFrame:
    """position, metadata columns, signal and targets of a store: signals.bin (float32), targets.bin and status.bin (bytes), metadata.parquet with position.

    Every array has as many records as the metadata, positions run from 0 without gaps, and every record's status is 1; else the store is refused.
    """
    metadata = spark.read.parquet(f"{root}/metadata.parquet")
    got = metadata.agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("low"), F.max("position").alias("high")).first()
    n = got["n"]
    if n and (got["d"], got["low"], got["high"]) != (n, 0, n - 1):
        raise Unmet("positions of the metadata do not run from 0 without gaps")
    own = lambda name, dtype, shape, column: read_array(spark, f"{root}/{name}.bin", dtype, shape, n).withColumnRenamed("values", column)
    nothing(own("status", "u1", [1], "status").where("status[0] <> 1"), "the store is not complete")
    signals, targets = own("signals", "<f4", [leads, samples], "flat"), own("targets", "u1", [labels], "targets")
    cut = F.transform(F.sequence(F.lit(0), F.lit(leads - 1)), lambda i: F.slice("flat", i * samples + 1, samples))
    return metadata.join(signals.select("position", cut.alias("signal")), "position").join(targets, "position")


def read_normalization(spark: SparkSession, path: str, leads: int = 12) -> tuple[list[float], list[float]]:
    """Means and standard deviations a lead from JSON; another number of leads, values that are not finite, and deviations of 0 or less are refused."""
    names = ("per_lead_mean_mv", "per_lead_standard_deviation_mv")
    row = spark.read.json(path, schema=", ".join(f"{n} array<double>" for n in names), multiLine=True).first()
    mean, sd = (list(row[n] or []) for n in names)
    if len(mean) != leads or len(sd) != leads:
        raise Unmet(f"the normalization has {len(mean)} and {len(sd)} leads, not {leads}")
    if not all(v is not None and math.isfinite(v) for v in (*mean, *sd)) or min(sd) <= 0:
        raise Unmet("the normalization is not finite and positive")
    return mean, sd
