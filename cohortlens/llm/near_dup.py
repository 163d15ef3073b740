"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct WIDTH-word shingles (with fewer words, the whole sequence as one).
Under each permutation both the least and the greatest hash are kept, so PERMUTATIONS evaluations give twice
as many values; bands of ROWS values are bucket keys. With the defaults, a pair at similarity 0.85
shares none of the 28 bands with a probability of 8e-8, at 0.8 of 1.5e-5.

Documents with equal sets form a class with the smallest id as its representative, so exact copies cost
nothing further. In a bucket every class is compared with a pivot, not with every other. Confirmed
links give components. Members of one pivot that are still in different components are compared if their
sizes and what they have beyond the pivot allow it (see across), so no link of a bucket is lost.
Comparison is exact: intersections of whole sets of 64-bit shingle hashes.

Nulls and ties: null, empty or blank text has an empty set (n_shingles 0) and links with nothing; a null
id takes part in no link and is kept; rows that repeat an id are the same node; an empty table
gives no rows; other columns are not read by near_duplicates() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, components

WIDTH = 5
PERCENT = 80
PERMUTATIONS = 70
ROWS = 5
#: Pivots with up to so many members have all those in different components compared.
SMALL_STAR = 8
#: Ids (8 bytes each) up to which the candidates are broadcast to the scan of texts; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000
#: Shingles that are hashed at once.
CHUNK = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = mix(h ^ c) + np.uint64(0x632BE59BD9B4E019)
    return h


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first text, sorted distinct shingle hashes of each) for runs of texts."""
    at = 0
    while at < len(texts):
        first, words, lengths = at, [], []
        while at < len(texts) and (len(words) < CHUNK or at == first):
            own = (texts[at] or "").encode("utf-8", "surrogatepass").lower().split()
            words += own
            lengths.append(len(own))
            at += 1
        if not words:
            yield first, [np.empty(0, np.uint64)] * len(lengths)
            continue
        array = np.empty(len(words), object)
        array[:] = words
        h = pd.util.hash_array(array, categorize=False)
        rolled = chain([h[k : len(h) - width + 1 + k] for k in range(width)]) if len(h) >= width else h[:0]
        sets, start = [], 0
        for n in lengths:
            if n >= width:
                sets.append(np.unique(rolled[start : start + n - width + 1]))
            elif n:
                sets.append(chain([h[start + k : start + k + 1] for k in range(n)]))
            else:
                sets.append(np.empty(0, np.uint64))
            start += n
        yield first, sets


def class_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that equal sets share."""
    out = []
    for s in sets:
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
        out.append(np.array([a, b], "<u8").tobytes() if len(s) else None)
    return out


def band_keys(sets: list[np.ndarray], permutations: int, rows: int, seed: int) -> np.ndarray:
    """Bucket keys [sets, bands] of sets that aren't empty: bands of least and bands of greatest values."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, permutations, np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    least = np.empty((len(sets), permutations), np.uint64)
    most = np.empty_like(least)
    for p in range(permutations):
        value = flat * factor[p] + shift[p]
        least[:, p] = np.minimum.reduceat(value, starts)
        most[:, p] = np.maximum.reduceat(value, starts)
    bands = []
    for number, (kind, at) in enumerate((v, a) for v in (least, most) for a in range(0, permutations - rows + 1, rows)):
        bands.append(chain([np.full(len(sets), number, np.uint64), *[kind[:, at + k] for k in range(rows)]]))
    return np.stack(bands, axis=1).view(np.int64)


def signatures(rows: DataFrame, width: int, permutations: int, rows_a_band: int, seed: int) -> DataFrame:
    """rows (doc_id, text): (doc_id, n_shingles, k, bands)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, sets in shingle_sets(texts, width):
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                # A run of sets of about CHUNK shingles at a time bounds the memory.
                if full:
                    keys = band_keys([sets[i] for i in full], permutations, rows_a_band, seed)
                    for i, own in zip(full, keys):
                        bands[i] = own
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(class_keys(sets), pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "k", "bands"],
                )

    return rows.mapInArrow(task, "doc_id long, n_shingles long, k binary, bands array<long>")


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """rows (doc_id, text): (k, shingles)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(1).to_pylist(), width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_keys(sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["k", "shingles"],
                )

    return rows.mapInArrow(task, "k binary, shingles array<long>")


def measure(pairs: DataFrame, texts: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """pairs (a, ka, na, b, kb, nb), each once, with common (shared shingles), and the sets (k, shingles) they have."""
    ends = scratch.keep(pairs.select(F.col("a").alias("doc_id"), F.col("ka").alias("k")).union(pairs.select("b", "kb")).distinct())
    ids = ends.select("doc_id").distinct()
    if ends.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = scratch.keep(full_sets(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text"), width).where("k is not null"))
    left = sets.select(F.col("k").alias("ka"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("k").alias("kb"), F.col("shingles").alias("sb"))
    found = pairs.join(left, "ka").join(right, "kb").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    found = scratch.keep(found.drop("sa", "sb"))
    scratch.drop(ends)
    return found, sets


def similar(percent: int) -> Column:
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def ordered(pairs: DataFrame) -> DataFrame:
    """pairs of structs x, y (rep, k, n): each unordered pair once, as columns."""
    a, b = F.least("x", "y"), F.greatest("x", "y")
    return pairs.select(a.alias("a"), b.alias("b")).select(
        F.col("a.rep").alias("a"), F.col("a.k").alias("ka"), F.col("a.n").alias("na"),
        F.col("b.rep").alias("b"), F.col("b.k").alias("kb"), F.col("b.n").alias("nb"),
    ).distinct()


def fitting(percent: int) -> Column:
    """A pair of far too different sizes can't be similar enough."""
    return F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent


def across(stars: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of a star's members in different components that might be similar.

    stars (p, x, i, label, m): x = (rep, k, n), i shingles shared with the pivot, m members. In a small star all such
    pairs are compared. In a large one, let U be a member's shingles that the pivot lacks. Two members without common U share
    at most the smaller i. So similar members either share as much of U as their sizes ask beyond i, and
    then, in any fixed order of shingles, one of the first |U| - that + 1 of both; or both have an i that is enough by itself.
    """
    t = percent / 100
    need = lambda size: F.ceil((size * percent) / F.lit(100 + percent))  # noqa: E731  of two sets of that many together
    few = stars.where(F.col("m") <= SMALL_STAR)
    other = lambda df: df.select("p", *[F.col(c).alias(n) for c, n in (("x", "y"), ("label", "other"), ("i", "iy")) if c in df.columns])
    direct = few.select("p", "x", "label").join(other(few.select("p", "x", "label")), "p").where("label < other").select("x", "y")
    many = stars.where(F.col("m") > SMALL_STAR)
    least = many.groupBy("p").agg(F.min("x.n").alias("low"))
    many = many.join(least, "p").withColumn(
        "lacks", F.greatest(F.lit(1).cast("long"), need(F.col("x.n") + F.greatest("low", F.ceil(F.col("x.n") * t))) - F.col("i"))
    )
    enough = many.where("lacks = 1").where(need(F.col("x.n") + F.greatest("low", F.ceil(F.col("x.n") * t))) <= F.col("i"))
    # Nearly all of these are in one component, the pivot's; only the others look for partners.
    main = enough.groupBy("p", "label").agg(F.count("*").alias("c")).groupBy("p").agg(F.max(F.struct("c", "label")).alias("top"))
    seekers = enough.join(main, "p").where(F.col("label") != F.col("top.label"))
    by_size = (
        seekers.select("p", "x", "label", "i").join(other(enough.select("p", "x", "label", "i")), "p")
        .where("label <> other").where(need(F.col("x.n") + F.col("y.n")) <= F.least("i", "iy")).select("x", "y")
    )
    own = many.select("p", F.col("p.k").alias("kp"), "x", F.col("x.k").alias("kx"), "label", "lacks")
    own = own.join(sets.select(F.col("k").alias("kx"), F.col("shingles").alias("sx")), "kx").join(sets.select(F.col("k").alias("kp"), F.col("shingles").alias("sp")), "kp")
    own = own.withColumn("u", F.array_except("sx", "sp")).where(F.size("u") >= F.col("lacks"))
    own = scratch.keep(own.select(F.col("p.rep").alias("star"), "x", "label", (F.size("u") - F.col("lacks") + 1).alias("first"), F.explode("u").alias("u")))
    often = own.groupBy("star", "u").agg(F.count("*").alias("often"))
    rank = F.row_number().over(W.partitionBy("star", "x.rep").orderBy("often", "u"))
    # A shingle that one member has alone joins nothing, but counts among the first.
    prefix = own.join(often, ["star", "u"]).withColumn("r", rank).where("r <= first and often > 1")
    prefix = scratch.keep(prefix.select("star", "u", "x", "label"))
    shared = prefix.join(prefix.select("star", "u", F.col("x").alias("y"), F.col("label").alias("other")), ["star", "u"]).where("label < other").select("x", "y")
    return ordered(direct.union(by_size).union(shared).where(fitting(percent)))


def links(reps: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Components (node, component) of the linked representatives; reps (rep, k, n, bands)."""
    spark = reps.sparkSession
    members = reps.select(F.struct("rep", "k", "n").alias("x"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = scratch.keep(members.join(shared, "bucket"))
    # The pivot of a bucket is the member that meets most others: of many variants, one near their source.
    meets = members.groupBy("x").agg(F.sum("m").alias("meets"))
    members = members.join(meets, "x")
    pick = members.groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("x.rep")).alias("low"), "x")).alias("top"))
    stars = scratch.keep(members.join(pick.select("bucket", F.col("top.x").alias("p")), "bucket").where("x.rep <> p.rep").select("p", "x").distinct())
    if stars.isEmpty():
        return None
    near, sets = measure(ordered(stars.select("x", F.col("p").alias("y"))), texts, width, scratch)
    found = near.where(similar(percent)).select("a", "b")
    labels = components(spark, found)
    name = labels.withColumnRenamed("node", "rep")
    spokes = stars.select("p", "x", F.least("p.k", "x.k").alias("k1"), F.greatest("p.k", "x.k").alias("k2"), F.col("x.rep").alias("rep")).join(
        near.select(F.least("ka", "kb").alias("k1"), F.greatest("ka", "kb").alias("k2"), F.col("common").alias("i")), ["k1", "k2"]
    ).join(name, "rep", "left").select("p", "x", "i", F.coalesce("component", "rep").alias("label"))
    spokes = scratch.keep(spokes)
    apart = spokes.groupBy("p").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low < high").select("p", "m")
    open_stars = scratch.keep(spokes.join(apart, "p"))
    if open_stars.isEmpty():
        return labels
    tried = near.select(F.least("ka", "kb").alias("k1"), F.greatest("ka", "kb").alias("k2"))
    pairs = across(open_stars, sets, percent, scratch)
    pairs = pairs.withColumns({"k1": F.least("ka", "kb"), "k2": F.greatest("ka", "kb")}).join(tried, ["k1", "k2"], "left_anti").drop("k1", "k2")
    pairs = scratch.keep(pairs)
    if pairs.isEmpty():
        return labels
    more, _ = measure(pairs, texts, width, scratch)
    return components(spark, found.union(more.where(similar(percent)).select("a", "b")))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    permutations: int = PERMUTATIONS, rows_a_band: int = ROWS, seed: int = 29,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept, one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = scratch.keep(signatures(texts, width, permutations, rows_a_band, seed))
    classes = scratch.keep(
        sigs.where("k is not null and doc_id is not null").groupBy("k", "bands")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("members"))
    )
    labels = links(classes.select("rep", "k", "n", "bands"), texts, width, percent, scratch)
    if labels is None:
        named = classes.where("members > 1").select("k", F.col("rep").alias("component"))
    else:
        named = (
            classes.select("k", "rep", "members").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .where("members > 1 or component is not null").select("k", F.coalesce("component", "rep").alias("component"))
        )
    rows = sigs.select("doc_id", "n_shingles", "k")
    # Empty sets have no key to join by; as null keys they would all meet in one task.
    out = rows.where("k is not null").join(named, "k", "left").unionByName(rows.where("k is null"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps; of repeated rows with one id, all stay."""
    gone = near_duplicates(docs, width, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    # The row travels whole, so its columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
