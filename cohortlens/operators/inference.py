"""Scoring cohorts by many models and seeds with receipts, so that an interrupted run goes on where it stopped.

A pass is one model and seed over a cohort. Its scores are written by Spark to a folder of their own; only then a receipt, one small
file, names the folder, the checkpoint's digest and the digest of what was written. Results are read through receipts alone: a folder
whose receipt is missing does not count, whoever died before writing it. What is left to do is the wanted passes without a receipt (an
anti-join). Folder and receipts go through Spark's file systems, so driver and executors may change between runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import temperature_scaled
from .expect import Unmet, content_digest, nothing

RECEIPT = "cohort string, model string, seed long, checkpoint string, choices string, path string, rows long, digest string"


@dataclass(frozen=True)
class Pass:
    """A model, its seed and its checkpoint's digest; score takes the cohort's records and adds p, one row a record and label."""

    model: str
    seed: int
    checkpoint: str
    score: Callable[[DataFrame], DataFrame]


class Receipts:
    """The receipts below a root folder, one file each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/receipts")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], RECEIPT)
        return self.spark.read.schema(RECEIPT).json(f"{self.root}/receipts")

    def add(self, **row) -> None:
        names = StructType.fromDDL(RECEIPT).names
        self.spark.createDataFrame([tuple(row[n] for n in names)], RECEIPT).coalesce(1).write.mode("append").json(f"{self.root}/receipts")


def pending(spark: SparkSession, passes: Sequence[Pass], receipts: DataFrame, cohort: str, choices: str) -> list[Pass]:
    """Wanted passes without a receipt. A receipt of other choices, or of another checkpoint of the same model and seed, is refused."""
    wanted = spark.createDataFrame([(cohort, p.model, p.seed, p.checkpoint, choices) for p in passes], "cohort string, model string, seed long, checkpoint string, choices string")
    own = receipts.where(F.col("cohort") == cohort)
    other = own.withColumnsRenamed({"checkpoint": "was", "choices": "chosen"}).join(wanted, ["cohort", "model", "seed"])
    nothing(other.where("was <> checkpoint or chosen <> choices").select("model", "seed", "was", "chosen"), "receipts of other checkpoints or choices")
    left = {(r["model"], r["seed"]) for r in wanted.join(own, ["cohort", "model", "seed", "checkpoint", "choices"], "left_anti").collect()}
    return [p for p in passes if (p.model, p.seed) in left]


def score_cohort(spark: SparkSession, records: DataFrame, passes: Sequence[Pass], root: str, cohort: str, choices: str, record: str = "record_id") -> int:
    """Scores what has no receipt yet and gives back how many passes that were. Scores must be of exactly the cohort's (record, label) rows, finite and in [0, 1]."""
    receipts, done = Receipts(spark, root), 0
    keys = [record, "label"]
    for p in pending(spark, passes, receipts.table(), cohort, choices):
        path = f"{receipts.root}/passes/{cohort}-{p.model}-{p.seed}-{uuid.uuid4().hex}"
        p.score(records).select(*keys, "y", F.col("p").cast("float").alias("p")).write.parquet(path)
        written = spark.read.parquet(path)
        check_scores(records, written, keys)
        receipts.add(cohort=cohort, model=p.model, seed=p.seed, checkpoint=p.checkpoint, choices=choices, path=path, rows=written.count(), digest=content_digest(written, [*keys, "y", "p"]))
        done += 1
    return done


def check_scores(records: DataFrame, scores: DataFrame, keys: Sequence[str]) -> None:
    """The same rows with the same targets, each once, and probabilities."""
    nothing(scores.where("p is null or isnan(p) or p < 0 or p > 1"), "no probabilities")
    count = lambda d, n: d.groupBy(*keys, "y").agg(F.count("*").alias(n))
    both = count(records, "wanted").join(count(scores, "found"), [*keys, "y"], "full")
    nothing(both.where("not (wanted <=> found)"), "scores are not of the cohort's records")


def cohort_scores(spark: SparkSession, passes: Sequence[Pass], root: str, cohort: str, choices: str, verify: bool = True, record: str = "record_id") -> DataFrame:
    """model, seed, record, label, y, p of every pass, through receipts; a pass without one, or files that are not what it says, fail."""
    receipts = Receipts(spark, root).table()
    if left := pending(spark, passes, receipts, cohort, choices):
        raise Unmet(f"no receipt of {[(p.model, p.seed) for p in left]}")
    own = {(r["model"], r["seed"]): r for r in receipts.where((F.col("cohort") == cohort) & (F.col("choices") == choices)).collect()}
    out = None
    for p in passes:
        r = own[p.model, p.seed]
        rows = spark.read.parquet(r["path"])
        if verify and content_digest(rows, [record, "label", "y", "p"]) != r["digest"]:
            raise Unmet(f"the scores of {p.model}, seed {p.seed} are not those of their receipt")
        rows = rows.select(F.lit(p.model).alias("model"), F.lit(p.seed).cast("long").alias("seed"), record, "label", "y", "p")
        out = rows if out is None else out.unionByName(rows)
    return out


def ensembles(scores: DataFrame, temperatures: dict[str, float], record: str = "record_id") -> DataFrame:
    """model, record, label, y, seeds, p and calibrated (single precision): the mean over seeds, and that at the model's temperature."""
    mean = scores.groupBy("model", record, "label", "y").agg(F.count("*").alias("seeds"), F.avg(F.col("p").cast("double")).alias("mean"))
    t = F.element_at(F.create_map(*[F.lit(v) for pair in temperatures.items() for v in pair]), F.col("model"))
    return mean.select("model", record, "label", "y", "seeds", F.col("mean").cast("float").alias("p"), temperature_scaled(F.col("mean"), t).cast("float").alias("calibrated"))
