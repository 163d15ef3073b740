"""What several corpus operators share: reading a table, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder of its own only where none is set and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cohortlens-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders of the scratch tables made inside the running released() block.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables made inside, and no others: results that read those must have been written by then."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(token)
        for root in own:
            delete(spark, root)


def small_batches(spark: SparkSession, rows: str = "1000") -> None:
    """Rows that Spark hands to a Python worker at once, unless the session says otherwise: whole texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, rows)


class Scratch:
    """Tables written to the shared folder and read again: any executor can be lost after that.

    Call drop() with a table that nothing reads any more; a released() block deletes what was made inside it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if (own := _OWN.get()) is not None:
            own.append(self.root)
        self.paths: dict[int, str] = {}
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        self._alive = getattr(self, "_alive", [])
        self._alive.append(kept)
        return kept

    def folder(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                delete(self.spark, path)
                self._alive = [x for x in self._alive if x is not df]


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, component = smallest node reachable).

    Every round takes the smallest label among a node and its neighbours, then follows the label
    once more (pointer jumping). Only aggregates and equi-joins, so a hub with many edges is
    summed up on the map side. Null ends and loops are ignored; no edges give no rows.
    """
    scratch = Scratch(spark, "components")
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.keep(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    # Labels only get smaller, so this ends.
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        moved = scratch.keep(
            step.join(jump, "mid", "left").select(
                "node", F.least("mid", F.coalesce("far", "mid")).alias("component"), "old"
            )
        )
        changed = not moved.where("component <> old").isEmpty()
        scratch.drop(labels)
        labels = moved
        if not changed:
            scratch.drop(both)
            return labels.select("node", "component")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """df with running totals over all rows in order, each without its own row.

    Rows are dealt by ranges of the order and written with their range, so ranges stay what they are; within a range a
    window adds up, and between ranges only a row a range does. Rows that tie in the whole order share a range.
    """
    keys = {f"run_{i}": c for i, c in enumerate(order)}
    values = {f"own_{name}": c for name, c in sums.items()}
    dealt = df.withColumns(keys | values).repartitionByRange(*keys).withColumn("run_range", F.spark_partition_id())
    dealt = scratch.keep(dealt)
    # As many rows as ranges.
    ranges = dealt.groupBy("run_range").agg(*[F.sum(f"own_{n}").alias(f"all_{n}") for n in sums])
    earlier = W.orderBy("run_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("run_range", *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"all_{n}") for n in sums])
    before = W.partitionBy("run_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(ranges), "run_range")
    out = out.withColumns({n: F.col(f"all_{n}") + F.coalesce(F.sum(f"own_{n}").over(before), F.lit(0)) for n in sums})
    return out.drop("run_range", *keys, *values, *[f"all_{n}" for n in sums])
