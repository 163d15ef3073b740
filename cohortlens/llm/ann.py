"""Nearest neighbours by NN-descent and greedy graph search.

Equal vectors form a class, of which the graph holds one node, so copies cost nothing; a class keeps its k + 1
smallest ids, which is all that a list of k can need. The graph starts from blocks of nodes that are
neighbours along random directions. Each round joins every node's neighbours and a sample of those that
name it (the method's own sampling) with their vectors, compares neighbours of neighbours inside that
small set, and keeps each node's best, until few links change. Vectors travel there as the bytes of their own
numbers, unrounded: a cluster may be as small as its type can tell, however far it lies from others. Pairs are chosen by products of
differences from the set's own node, and the chosen ones are measured from their own difference.

A query starts at its own class and at a few entry nodes, and again and again joins its best unexpanded
nodes with their neighbours in both directions, until the best BEAM nodes it has seen are all expanded. Distances of the search
are Euclidean in double precision on the original vectors.

Nulls and ties: null, empty and zero vectors, and those with null or non-finite components, take no
part, as do rows with a null id; vectors of different lengths have no distance, so each length is
searched by itself; equal distances go to the smaller id; rows that repeat an id and vector count once; with fewer than k
others all found are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

NEIGHBOURS = 20
NAMED_BY = 20
#: Rounds end once at most this share of links is new.
SETTLED = 0.005
DIRECTIONS = 3
BLOCK = 512
#: Of a node's comparisons inside one set, so many are passed on.
PASSED = 10
BEAM = 256
EXPAND = 64
ENTRIES = 4
#: Bytes of vectors that are broadcast; beyond it they are shuffled to the sets they stand in.
SMALL = 32 << 20


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, vector): (node, vector, members), node being the smallest id."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")).select(
        F.col("members")[0].alias("node"), "vector", "members"
    )


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Doubles of bytes that packed() made: 4 or 8 a component."""
    raw = b"".join(column.to_pylist())
    wide = len(raw) == 8 * dim * len(column)
    return np.frombuffer(raw, np.float64 if wide else np.float32).reshape(-1, dim).astype(np.float64)


def packed(classes: DataFrame, dim: int) -> DataFrame:
    """(node, small): the vector's numbers as bytes, floats as they are and all other numbers as doubles."""
    kind = np.float32 if classes.schema["vector"].dataType.simpleString() == "array<float>" else np.float64

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "small"])

    vector = F.col("vector") if kind is np.float32 else F.col("vector").cast("array<double>").alias("vector")
    return classes.select("node", vector).mapInArrow(task, "node long, small binary")


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, from their differences, so that near rows far from the origin keep theirs."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest (node, other, d, fresh) of each node, each once; fresh where every row of the link is."""
    rank = F.row_number().over(W.partitionBy("node").orderBy("d", "other"))
    return edges.groupBy("node", "other").agg(F.min("d").alias("d"), F.bool_and("fresh").alias("fresh")).withColumn("r", rank).where(F.col("r") <= k).drop("r")


def first_graph(nodes: DataFrame, dim: int, seed: int) -> DataFrame:
    """Each node's nearest inside its block, blocks being runs along a random direction."""
    rng = np.random.default_rng(seed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            ids = table.column(0).to_numpy()
            x = unpack(table.column(1), dim)
            y = x - x[len(x) // 2]
            n = (y * y).sum(axis=1)
            d = n[:, None] + n[None, :] - 2 * (y @ y.T)
            np.fill_diagonal(d, np.inf)
            k = min(NEIGHBOURS, len(ids) - 1)
            at = np.argpartition(d, k - 1, axis=1)[:, :k].ravel() if k else np.empty(0, int)
            own = np.repeat(np.arange(len(ids)), k)
            return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[at]), pa.array(apart(x[own], x[at]))], ["node", "other", "d"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * BLOCK:
                table = pa.Table.from_batches(held)
                while table.num_rows >= 2 * BLOCK:
                    yield block(table.slice(0, BLOCK))
                    table = table.slice(BLOCK)
                held = table.to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    out = None
    for _ in range(DIRECTIONS):
        direction = rng.standard_normal(dim)

        def project(batches: Iterator[pa.RecordBatch], direction=direction) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unpack(b.column(1), dim) @ direction)], ["node", "small", "along"])

        lined = nodes.mapInArrow(project, "node long, small binary, along double")
        edges = lined.repartitionByRange("along", "node").sortWithinPartitions("along", "node").select("node", "small").mapInArrow(task, "node long, other long, d double")
        out = edges if out is None else out.union(edges)
    return best(out.withColumn("fresh", F.lit(True)), NEIGHBOURS)


def compare_sets(rows: DataFrame, dim: int) -> DataFrame:
    """rows (hub, node, worst, small), a hub's together: pairs of its nodes nearer than a node's worst neighbour so far."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(hub: np.ndarray, node: np.ndarray, worst: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]])
            sizes = np.diff(np.r_[starts, len(hub)])
            width = int(sizes.max())
            place = np.arange(len(hub)) - np.repeat(starts, sizes)
            row = np.repeat(np.arange(len(starts)), sizes)
            # Every set holds its hub's own row.
            own = np.flatnonzero(hub == node)
            padded = np.zeros((len(starts), width, dim))
            padded[row, place] = x - x[own[row]]
            ids = np.full((len(starts), width), -1, np.int64)
            ids[row, place] = node
            limit = np.zeros((len(starts), width))
            limit[row, place] = worst
            n = (padded * padded).sum(axis=2)
            d = n[:, :, None] + n[:, None, :] - 2 * (padded @ padded.transpose(0, 2, 1))
            d[:, np.arange(width), np.arange(width)] = np.inf
            d[np.broadcast_to((ids < 0)[:, None, :], d.shape)] = np.inf
            k = min(PASSED, width - 1)
            if k <= 0:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["node", "other", "d"])
            at = np.argpartition(d, k - 1, axis=2)[:, :, :k]
            near = np.take_along_axis(d, at, axis=2)
            good = (near < limit[:, :, None]) & (ids >= 0)[:, :, None]
            a, b, c = np.nonzero(good)
            other = at[a, b, c]
            gaps = apart(x[starts[a] + b], x[np.minimum(starts[a] + other, len(x) - 1)])
            # A pair with padding, or that rounding made look near, goes.
            true = (ids[a, other] >= 0) & (gaps < limit[a, b])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[a, b][true]), pa.array(ids[a, other][true]), pa.array(gaps[true])], ["node", "other", "d"]
            )

        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)] + [unpack(batch.column(3), dim)]
            if rest is not None:
                now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            begin = 0
            while begin < cut:
                # Whole sets, about 4,096 rows at a time.
                end = cut if begin + 4096 >= cut else int(np.searchsorted(now[0], now[0][begin + 4096]))
                end = end if end > begin else cut
                yield sets(*[x[begin:end] for x in now])
                begin = end
        if rest is not None and len(rest[0]):
            yield sets(*rest)

    return rows.mapInArrow(task, "node long, other long, d double")


def neighbour_graph(classes: DataFrame, dim: int, settled: float, scratch: Scratch, seed: int = 5, small: int = SMALL) -> DataFrame:
    """(node, other, d, fresh): about the NEIGHBOURS nearest of every class. Up to small bytes of vectors are broadcast, with the same result."""
    nodes = scratch.keep(packed(classes, dim))
    # Counted, with a node's id and worst neighbour.
    few = nodes.agg(F.coalesce(F.sum(F.length("small") + 16), F.lit(0)).alias("bytes")).first()["bytes"] <= small
    graph = scratch.keep(first_graph(nodes, dim, seed))
    # Links only get shorter, so this ends.
    for step in itertools.count():
        worst = graph.groupBy("node").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
        state = nodes.join(worst, "node", "left").select("node", F.when(F.col("n") >= NEIGHBOURS, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst"), "small")
        rank = F.row_number().over(W.partitionBy("hub").orderBy(F.xxhash64("hub", "node", F.lit(step)), "node"))
        named = graph.select(F.col("other").alias("hub"), "node").withColumn("r", rank).where(F.col("r") <= NAMED_BY).drop("r")
        sets = graph.select(F.col("node").alias("hub"), F.col("other").alias("node")).union(named)
        sets = sets.union(nodes.select(F.col("node").alias("hub"), "node")).distinct()
        # Where vectors are few, only ids are shuffled to their sets.
        rows = sets.repartition("hub").join(F.broadcast(state), "node") if few else sets.join(state, "node").repartition("hub")
        rows = rows.select("hub", "node", "worst", "small").sortWithinPartitions("hub", "node")
        compared = compare_sets(rows, dim).withColumn("fresh", F.lit(True))
        new = scratch.keep(best(graph.withColumn("fresh", F.lit(False)).union(compared), NEIGHBOURS))
        scratch.drop(graph)
        graph = new
        links = graph.agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n")).first()
        if links["fresh"] <= settled * links["n"]:
            return graph


def search(queries: DataFrame, classes: DataFrame, graph: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """queries (q, vector), start (q): (q, node, score), the best k + 1 classes each query has found."""
    links = graph.select("node", "other").union(graph.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    links = scratch.keep(links)
    entries = [F.lit(r["node"]) for r in classes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    own = queries.join(classes.select(F.col("node").alias("q")), "q", "left_semi").select("q", F.col("q").alias("node"))
    fresh = own.union(queries.select("q", F.explode(F.array(*entries)).alias("node"))).distinct()
    pool: DataFrame | None = None
    seen: DataFrame | None = None
    # Every hop expands nodes that were not expanded before, so this ends.
    while True:
        gaps = F.zip_with("a", "b", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        score = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))
        measured = (
            fresh.join(classes.select("node", F.col("vector").alias("b")), "node")
            .join(queries.select("q", F.col("vector").alias("a")), "q")
            .select("q", "node", score.alias("score"), F.lit(False).alias("expanded"))
        )
        rank = F.row_number().over(W.partitionBy("q").orderBy("score", "node"))
        everything = measured if pool is None else pool.select("q", "node", "score", F.col("expanded") | F.col("now")).toDF("q", "node", "score", "expanded").union(measured)
        best_now = everything.withColumn("r", rank).where(F.col("r") <= BEAM).drop("r")
        waiting = F.row_number().over(W.partitionBy("q", "expanded").orderBy("score", "node"))
        new_pool = scratch.keep(best_now.withColumn("now", ~F.col("expanded") & (waiting <= EXPAND)))
        seen_now = scratch.keep(fresh)
        if pool is not None:
            scratch.drop(pool)
        pool = new_pool
        seen = seen_now if seen is None else seen.union(seen_now)
        frontier = pool.where("now").select("q", "node")
        if frontier.isEmpty():
            break
        fresh = frontier.join(links, "node").select("q", F.col("other").alias("node")).distinct().join(seen, ["q", "node"], "left_anti")
        fresh = scratch.keep(fresh)
    rank = F.row_number().over(W.partitionBy("q").orderBy("score", "node"))
    return pool.withColumn("r", rank).where(F.col("r") <= k + 1).select("q", "node", "score")


def nearest(
    table: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", settled: float = SETTLED
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest other rows found, for every usable row where queries holds."""
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), queries.alias("asks")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    # As many rows as there are lengths.
    lengths = [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [nearest_of(rows.where(F.size("vector") == n), n, k, settled, scratch) for n in lengths]
    return functools.reduce(DataFrame.union, found)


def nearest_of(rows: DataFrame, length: int, k: int, settled: float, scratch: Scratch) -> DataFrame:
    """nearest() of rows (id, vector, asks) whose vectors all have that length."""
    classes = scratch.keep(classes_of(rows.select("id", "vector").distinct(), k))
    graph = neighbour_graph(classes, length, settled, scratch)
    asked = scratch.keep(rows.where("asks").select("id", "vector").distinct().join(classes.select("node", "vector"), "vector").select("id", "node", "vector"))
    found = search(asked.select(F.col("node").alias("q"), "vector").distinct(), classes, graph, k, scratch)
    found = found.join(classes.select("node", "members"), "node").select("q", F.explode("members").alias("vec_id"), "score")
    found = asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(found, "q").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
