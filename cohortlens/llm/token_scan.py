"""Token counts from flat token files without an index, by a scan for the end-of-document id.

A flat file is little-endian 16- or 32-bit ids, documents one after another, each ended by one id. Files are
cut into blocks of a fixed number of ids that know nothing of documents. A task searches its blocks
with numpy and gives the places of the end ids; the blocks of a file are stitched by a prefix scan of their
counts and last places, so a document may span any number of blocks.

write_token_files() writes such files with Spark's own text writer, whose line separator is the end id's bytes, and a
manifest of the documents' order. Unless told that the documents' plan has one order, it encodes them once to a table and
makes both from there. Nulls and ties: a null text has no tokens but its end id; a null
id keeps its place; repeated rows are documents of their own; an empty table gives no files and no
rows; tokens after a file's last end id are one more, unended document; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder

#: Ids in a block.
BLOCK = 1 << 20
#: Bytes of a file that Spark reads as one row.
ROW = 1 << 28


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, scratch: Scratch | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one flat file of 16-bit ids a partition to folder; returns (file, ordinal, doc_id).

    Both come from one table in scratch; without scratch, from two scans of docs, whose order must be fixed then.
    Texts can't hold the end id: special tokens in them are ordinary text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text=True)
        for batch in batches:
            ids = [enc.encode(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    encoded = ordered = rows.mapInArrow(encode, "doc_id long, ids binary")
    if scratch is None:
        # Without the texts.
        ordered = rows
    else:
        encoded = ordered = scratch.keep(encoded)
    separator = end_id.to_bytes(2, "little").decode("latin-1")
    encoded.select(F.col("ids").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(folder)
    rows = ordered.select(
        F.spark_partition_id().alias("file"),
        # Within a partition, the row's number.
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"),
        "doc_id",
    )
    return rows.select("file", "ordinal", "doc_id")


def read_blocks(spark: SparkSession, folder: str, width: int = 2, block: int = BLOCK, row: int = ROW) -> DataFrame:
    """(path, block, ids): the files of folder, of any size, in blocks of so many ids.

    Files of up to row bytes come through Spark's reader of binary files. Of larger ones only the lengths do; tasks read their blocks at their
    places in the file, through Arrow's file systems.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    size = block * width
    last = F.expr(f"(length - 1) div {size}")
    # Cut before the rows multiply, so that no row carries the whole file.
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.substring("content", (b * size + 1).cast("int"), F.lit(size)))
    small = files.where(f"length > 0 and length <= {row}").select("path", F.posexplode(cut).alias("block", "ids")).withColumn("block", F.col("block").cast("long"))
    large = files.where(f"length > {row}").select("path", "length")
    if large.isEmpty():
        return small
    places = large.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, inside = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with system.open_input_file(inside) as file:
                    raw = file.read_at(min(size, length - at * size), at * size)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([raw], pa.binary())], ["path", "block", "ids"])

    return small.union(places.repartition("path", "block").mapInArrow(read, "path string, block long, ids binary"))


def find_ends(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(path, block, n, ends): each block's ids and the places in it of the end id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["path", "block", "n", "ends"]
            )

    return blocks.select("path", "block", "ids").mapInArrow(task, "path string, block long, n long, ends array<long>")


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of every document in the files; n_tokens is without the end id."""
    found = find_ends(blocks, end_id, width)
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # The prefix scan: ids, documents ended and the last end's place, over all blocks before. A row a block.
    scan = found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    scan = scan.withColumn("ends", F.transform("ends", lambda e: e + F.col("at")))
    scan = scan.withColumn("done", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"))
    scan = scan.withColumn("open_at", F.coalesce(F.max(F.array_max("ends")).over(before) + 1, F.lit(0)).cast("long"))
    starts = F.concat(F.array("open_at"), F.transform("ends", lambda e: e + 1))
    ended = scan.select(
        "path", F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size("ends")).alias("start"), F.col("ends").alias("end"))).alias("i", "d"), "done"
    ).select(
        "path", (F.col("done") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"),
        (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"),
    )
    whole = scan.groupBy("path").agg(
        F.max(F.col("at") + F.col("n")).alias("ids"), F.max(F.col("done") + F.size("ends")).alias("ordinal"),
        F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0)).cast("long").alias("start"),
    )
    rest = whole.where("start < ids").select("path", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def document_token_counts(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", one_order: bool = False) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every row of docs, through flat files in folder.

    one_order: every scan of docs gives its rows in the same order and partitions, as one of files does, so that no copy of the ids
    is needed. The manifest's counts and the files' must fit, else this fails.
    """
    spark = docs.sparkSession
    scratch = None if one_order else Scratch(spark, "token-ids")
    manifest = write_token_files(docs, folder, tokenizer, end_id, scratch, id_col, text_col)
    manifest.write.parquet(f"{folder}-manifest")
    manifest = spark.read.schema(manifest.schema).parquet(f"{folder}-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, file int, ordinal long, start long, n_tokens long")
    counted = count_tokens(read_blocks(spark, folder), end_id).withColumn("file", F.regexp_extract("path", r"part-(\d+)", 1).cast("int"))
    counted.select("file", "ordinal", "start", "n_tokens").write.parquet(f"{folder}-counts")
    counted = spark.read.parquet(f"{folder}-counts")
    have, want = (df.groupBy("file").count() for df in (counted, manifest))
    if not have.exceptAll(want).union(want.exceptAll(have)).isEmpty():
        raise RuntimeError("the scans of the documents differed; run it again")
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
