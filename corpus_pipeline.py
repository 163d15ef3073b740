"""A corpus pipeline of four stages: language ID, near-duplicates, mixing to target weights, packing.

Every stage reads what the one before wrote. The first three return the columns of documents: rows
whose language is rejected go, one document of each group of near-duplicates stays, sources are mixed to 150% of
all words at weights 3, 1, 2 (whole documents, repeated or left out as their quota says). The last packs what is
left into sequences. A stage's docs may be empty; nulls and ties are as the operators define them. Further columns of any
names, dotted ones and the operators' own too, travel along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import langid, mixing, near_dup, packing
from cohortlens.llm.common import Scratch, released
from cohortlens.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The row travels whole, so its columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    judged = langid.classify(langid.train(docs), rows, keep_text=False)
    return judged.where("not rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, extras=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("mixing to weights", mix_sources),
    ("packing", pack),
]

#: Models, hashes and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        with released(spark):
            kept = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
