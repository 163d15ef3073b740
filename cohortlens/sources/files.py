"""Readers and writers with fixed schemas: headers, checksum lists, code groups, CSV, resumable and sorted sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import expect


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a header file: path and the parsed fields."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", parse.header_record(F.col("value")).alias("h")).select("path", "h.*")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(parse.checksum_line(F.col("value")).alias("c")).select("c.*")


def matrix_index(checksums: DataFrame, suffix: str = ".mat") -> DataFrame:
    """stem, path, digest of the matrices; a stem that repeats is an error."""
    rows = checksums.where(F.col("path").endswith(suffix)).select(parse.stem(F.col("path")).alias("stem"), "path", "digest")
    return expect.unique(rows, ["stem"])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header and pinned types; a row that does not fit is an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_code_groups(spark: SparkSession, path: str) -> DataFrame:
    """key, codes of a square matrix whose header and first column agree; codes of a key are joined by a pipe."""
    rows = spark.read.csv(path, header=True)
    head, first = rows.columns[1:], [r[0] for r in rows.select(rows.columns[0]).collect()]
    if head != first:
        raise expect.Unmet("the matrix's axes differ")
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("key")).withColumn("codes", F.split("key", r"\|"))


def code_names(groups: DataFrame, names: DataFrame) -> DataFrame:
    """key, name: the names of a group's codes in order, joined; a code without a name is an error."""
    codes = groups.select("key", F.posexplode("codes").alias("at", "code"))
    joined = codes.join(names, "code", "left")
    expect.nothing(joined.where("name is null").select("code"), "codes without a name")
    return joined.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]), " / ").alias("name"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """label, codes, headline and positive counts of a label manifest in JSON."""
    schema = "labels array<struct<label_key:string,snomed_codes:array<string>,diagnosis:string,headline_eligible:boolean,positive_counts:map<string,long>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True)
    return rows.select(F.posexplode("labels").alias("position", "l")).select("position", "l.*")


def verified_files(spark: SparkSession, path: str, checksums: DataFrame, pattern: str = "*") -> DataFrame:
    """Contents of the files whose digest is the listed one, with name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("name", F.regexp_extract("path", r"[^/]*$", 0))
    listed = checksums.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "digest")
    return files.withColumn("digest", F.sha2("content", 256)).join(listed, ["name", "digest"], "left_semi")


def plan_jobs(records: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One job a record: its matrix by the stem of its signal file."""
    jobs = records.withColumn("stem", parse.stem(F.col("signal_file"))).join(index, "stem", "left")
    return jobs.select(key, F.struct("path", "digest").alias("job"), F.col("path").isNull().alias("missing"))


def append_new(df: DataFrame, path: str, key: Sequence[str]) -> int:
    """Appends only the rows whose key the table lacks, so a broken run goes on where it stopped; how many it wrote."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(*key)
    except Exception as error:  # the table is not there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        have = None
    new = df if have is None else df.join(have, list(key), "left_anti")
    before = 0 if have is None else have.count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str], columns: Sequence[str]) -> None:
    """Fixed column order, globally sorted part files with headers."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_statistics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("cohort", "stat").parquet(path)


def cached(df_of, spark: SparkSession, folder: str, digest: str) -> DataFrame:
    """The table kept under this digest, or made and kept now; other digests are stale and not read."""
    path = f"{folder}/{digest}"
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
