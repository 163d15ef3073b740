"""Cluster bootstrap: weights, replicate statistics and intervals.

Clusters are resampled, records of one share a weight, and models share the weights of a replicate, so contrasts are
paired. Three kinds of weights: hash (Poisson counts from a hash of cluster and replicate; any engine can repeat
them, nothing is stored), multinomial (as many hashed draws a replicate as there are clusters), and registered (one multinomial
stream in replicate order, drawn over a cohort's clusters in one task).

Rows are dealt by cluster, so that a cluster's weights are made once, and no row is multiplied by the replicates: a task sums
its rows of a key and bin, or of a score that many of them share, in one product with their clusters' weights.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.scalar import affine
from .calibration import bin_index, from_totals
from .discrimination import from_buckets, score_bucket
from .lineage import cut
from .utility import steps_reached

#: Replicates of a study.
REPLICATES = 2000
#: Poisson(1) counts whose tail beyond is under 1e-9.
MOST = 12
#: Rows that meet their weights at once, and values of sums that a task holds before it passes them on.
CHUNK, HELD = 1024, 1 << 21
#: Rows of one score in a batch from which they are summed before they move, and bytes of hashed weights that a task keeps.
MANY, KEPT = 16, 1 << 27
#: Places of a span; bytes of a batch's draws and of a task's sums; rows of a span that are added up together.
SPAN, BLOCKS, SUMS, WAITING = 16_384, 1 << 26, 1 << 28, 1 << 18
#: Score buckets of a key in the scan of resamples: one is a task's sort, so scores that crowd on the logit need narrow ones.
FINE = 512
#: An integer hash's multipliers, each under 2**31, and its modulus for identifiers, a prime.
CLUSTER_FACTOR, REPLICATE_FACTOR, FIRST, SECOND = 1540483477, 2027808503, 569420461, 1935289751
MODULUS = 4294967291


def poisson_edges() -> list[int]:
    """Upper edges, out of 2**32, of the counts 0, 1, 2, ..."""
    edges, total = [], 0.0
    for k in range(MOST):
        total += math.exp(-1) / math.factorial(k)
        edges.append(int(total * 2**32))
    return edges


def hash_draw(cluster: Column, replicate: Column) -> Column:
    """A number below 2**32 for each pair. Clusters are integers; hash other identifiers to one first."""
    two = F.lit(1 << 32)
    # The cluster is mixed on its own first, so that no two clusters share a sequence of draws shifted by some replicates.
    x = F.pmod(F.pmod(cluster.cast("long"), F.lit(MODULUS)) * F.lit(CLUSTER_FACTOR), two)
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(SECOND), two)
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) + replicate.cast("long") * F.lit(REPLICATE_FACTOR), two)
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(FIRST), two)
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(SECOND), two)
    return x.bitwiseXOR(F.shiftright(x, 15))


def hash_weight(cluster: Column, replicate: Column) -> Column:
    """Poisson(1) count of a cluster in a replicate."""
    draw, weight = hash_draw(cluster, replicate), F.lit(MOST)
    for k in range(MOST - 1, -1, -1):
        weight = F.when(draw < poisson_edges()[k], k).otherwise(weight)
    return weight.cast("int")


#: What follows the first product, step by step, on v; {r} is the replicate.
HASH_STEPS_SQL = (
    f"xor(v, v >> 16) * {SECOND} % 4294967296", f"(xor(v, v >> 15) + {{r}} * {REPLICATE_FACTOR}) % 4294967296", f"xor(v, v >> 16) * {FIRST} % 4294967296",
    f"xor(v, v >> 15) * {SECOND} % 4294967296", "xor(v, v >> 15)",
)


def hash_draw_sql(cluster: str, replicate: str) -> str:
    x = f"(CAST({cluster} AS BIGINT) % {MODULUS} * {CLUSTER_FACTOR} % 4294967296)"
    for step in HASH_STEPS_SQL:
        x = f"(SELECT {step.replace('{r}', f'CAST({replicate} AS BIGINT)')} FROM (SELECT {x} AS v))"
    return x


def hash_weight_sql(draw: str) -> str:
    return "CASE " + " ".join(f"WHEN {draw} < {e} THEN {k}" for k, e in enumerate(poisson_edges())) + f" ELSE {MOST} END"


def cell_seed(cell: Column, repeat: Column, seed: int = 0) -> Column:
    """A seed below 2**32 for each cell (a whole number of its own) of a study and repeat: the same wherever and in whatever order cells are drawn."""
    return hash_draw(cell.cast("long") + F.lit(seed), repeat)


def hash_draws(clusters: np.ndarray, replicates: int, first: int = 0) -> np.ndarray:
    """hash_draw() of all pairs, [clusters, replicates], with replicates from first on; 32 bits wrap as the modulus asks."""
    c = (clusters % MODULUS).astype(np.uint32) * np.uint32(CLUSTER_FACTOR)
    r = np.arange(first, first + replicates, dtype=np.uint32) * np.uint32(REPLICATE_FACTOR)
    c = (c ^ c >> np.uint32(16)) * np.uint32(SECOND)
    x = (c ^ c >> np.uint32(15))[:, None] + r
    for shift, factor in ((16, FIRST), (15, SECOND)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(15)
    return x


def hash_counts(clusters: np.ndarray, replicates: int) -> np.ndarray:
    """hash_weight() of all pairs as bytes, some clusters at a time so that they stay in the processor's cache."""
    out = np.zeros((len(clusters), replicates), np.uint8)
    step = max(1, (1 << 16) // replicates)
    for at in range(0, len(clusters), step):
        draws, own = hash_draws(clusters[at : at + step], replicates), out[at : at + step]
        for edge in poisson_edges():
            own += draws >= np.uint32(edge)
    return out


def hash_weights(clusters: np.ndarray, replicates: int) -> np.ndarray:
    """hash_weight() of all pairs."""
    own, back = np.unique(clusters, return_inverse=True)
    return hash_counts(own, replicates).astype(np.float64)[back]


def multinomial_weights(clusters: DataFrame, cohort: str, replicates: int, seed: int, cluster: str = "cluster_id", every: int = 100) -> DataFrame:
    """cohort, cluster, batch, weights (an entry a replicate of the batch): each of a cohort's n clusters casts one hashed draw of n a replicate.

    Draws follow from n alone, so a task makes a batch of one cohort's replicates without any rows and hands on counts by place.
    """
    own = clusters.select(cohort, cluster).distinct()
    sizes = own.groupBy(cohort).agg(F.count("*").alias("n"))
    batches = sizes.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // every)))).repartition(cohort, "batch")

    def draw(rows_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_:
            for name, n, batch in zip(*[rows.column(c).to_pylist() for c in (cohort, "n", "batch")]):
                size = min(every, replicates - batch * every)
                drawn = np.zeros((size, n), np.int8)
                for k in range(size):
                    ends = hash_draws(np.arange(n) + seed, 1, batch * every + k)[:, 0].astype(np.uint64)
                    drawn[k] = as_bytes(np.bincount((ends * np.uint64(n) >> np.uint64(32)).astype(np.int64), minlength=n))
                yield from by_place(name, rows.schema.field(cohort).type, batch, drawn.T, [cohort, "batch", "place", "weights"])

    schema = StructType([own.schema[cohort], StructField("batch", IntegerType()), StructField("place", LongType()), StructField("weights", ArrayType(ByteType()))])
    draws = batches.select(cohort, "n", "batch").mapInArrow(draw, schema)
    return at_places(draws, own, cohort, cluster)


def as_bytes(drawn: np.ndarray) -> np.ndarray:
    """Counts of draws in a byte each; n draws of n clusters never reach 128 for one of them but by a fault."""
    if drawn.max(initial=0) > np.iinfo(np.int8).max:
        raise OverflowError("a cluster was drawn over 127 times in a replicate")
    return drawn.astype(np.int8)


def at_places(draws: DataFrame, own: DataFrame, cohort: str, cluster: str) -> DataFrame:
    """cohort, cluster, batch, weights. Tasks make the draws from next to nothing, so their measured input says nothing of their size: never broadcast."""
    return draws.hint("merge").join(cluster_places(own, cohort, cluster), [cohort, "place"]).select(cohort, cluster, "batch", "weights")


def by_place(name: object, kind: pa.DataType, batch: int, drawn: np.ndarray, names: list[str], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """A matrix of draws [places, replicates] as rows of a cohort and batch."""
    for at in range(0, len(drawn), rows):
        some = drawn[at : at + rows]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * drawn.shape[1], pa.int32()), pa.array(np.ascontiguousarray(some).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), kind), pa.array(np.full(len(some), batch, np.int32)), pa.array(np.arange(at, at + len(some))), flat], names)


def registered_weights(clusters: DataFrame, cohort: str, replicates: int, seed: int, cluster: str = "cluster_id", batch: int = 100) -> DataFrame:
    """cohort, cluster, weights from one multinomial stream: a cohort's clusters, in order, meet the stream in one task."""
    own = clusters.select(cohort, cluster).distinct()

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(cluster)
        stream = np.concatenate(list(registered_stream(len(rows), replicates, seed, batch))).astype(np.int32)
        return rows.assign(weights=list(stream.T))

    return own.groupBy(cohort).applyInPandas(draw, StructType([*own.schema.fields, StructField("weights", ArrayType(IntegerType()))]))


def state_text(rng: np.random.Generator) -> str:
    own = rng.bit_generator.state
    return json.dumps({**own, "state": {k: str(v) for k, v in own["state"].items()}})


def generator(text: str) -> np.random.Generator:
    """The generator as state_text() found it."""
    state, rng = json.loads(text), np.random.default_rng()
    rng.bit_generator.state = {**state, "state": {k: int(v) for k, v in state["state"].items()}}
    return rng


def stream_states(sizes: DataFrame, cohort: str, replicates: int, seed: int, every: int = 100) -> DataFrame:
    """cohort, n, batch, state: where the registered stream of a cohort of n clusters stands before each batch of replicates.

    The generator can't jump over multinomial draws, as they take varying amounts of randomness; so one task a cohort runs it once and
    keeps a state a batch, no draws. From a state any task makes its batch's draws alone. sizes: cohort, n.
    """

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng, kept = np.random.default_rng(seed), []
                for at in range(0, replicates, every):
                    kept.append(state_text(rng))
                    for _ in range(min(every, replicates - at)):
                        rng.multinomial(n, np.full(n, 1 / n))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept), batch.schema.types[0]), pa.array([n] * len(kept)), pa.array(range(len(kept)), pa.int32()), pa.array(kept)], [cohort, "n", "batch", "state"])

    schema = StructType([sizes.schema[cohort], StructField("n", LongType()), StructField("batch", IntegerType()), StructField("state", StringType())])
    return sizes.select(cohort, F.col("n").cast("long").alias("n")).repartition(cohort).mapInArrow(states, schema)


def draws_from_states(states: DataFrame, cohort: str, replicates: int, every: int = 100) -> DataFrame:
    """cohort, batch, place, weights (an entry a replicate of the batch): every batch of every cohort in a task of its own, equal to the single stream."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, n, number, text in zip(*[rows.column(c).to_pylist() for c in (cohort, "n", "batch", "state")]):
                rng, even = generator(text), np.full(n, 1 / n)
                drawn = np.zeros((min(every, replicates - number * every), n), np.int8)
                for k in range(len(drawn)):
                    drawn[k] = as_bytes(rng.multinomial(n, even))
                yield from by_place(name, rows.schema.field(cohort).type, number, drawn.T, [cohort, "batch", "place", "weights"])

    schema = StructType([states.schema[cohort], StructField("batch", IntegerType()), StructField("place", LongType()), StructField("weights", ArrayType(ByteType()))])
    return states.repartition(cohort, "batch").mapInArrow(draw, schema)


def spread_registered_weights(clusters: DataFrame, cohort: str, replicates: int, seed: int, cluster: str = "cluster_id", every: int = 100) -> DataFrame:
    """cohort, cluster, batch, weights: registered_weights() made batch by batch in tasks of their own; cohorts are in lock step by batch."""
    own = clusters.select(cohort, cluster).distinct()
    sizes = own.groupBy(cohort).agg(F.count("*").alias("n"))
    draws = draws_from_states(stream_states(sizes, cohort, replicates, seed, every), cohort, replicates, every)
    return at_places(draws, own, cohort, cluster)


def cluster_places(own: DataFrame, cohort: str, cluster: str) -> DataFrame:
    """cohort, cluster, place (from 0 in order)."""
    return places(own.select(cohort, cluster), [cohort], [cluster])


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with place, from 0, in their key by the order: ranges number their rows, and the counts of a key's ranges go before."""
    # Written once: ranges that were drawn twice could differ.
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("own", F.row_number().over(W.partitionBy(*keys, "part").orderBy(*order)) - 1)
    counts = dealt.groupBy(*keys, "part").count()
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return inside.join(counts, [*keys, "part"]).withColumn("place", (F.col("own") + F.col("before")).cast("long")).drop("own", "before", "part")


def replicate_auroc_in_batches(df: DataFrame, keys: Sequence[str], weights: DataFrame, replicates: int, every: int = 100, cluster: str = "cluster_id") -> DataFrame:
    """keys, replicate, auroc with weights that come in batches (cohort, cluster, batch, weights) of every replicates: rows are not copied by batch."""
    return replicate_scan(df, keys, (), replicates, cluster, weights, every).select(*keys, "replicate", "auroc")


def registered_stream(clusters: int, replicates: int, seed: int, batch: int = 100) -> Iterator[np.ndarray]:
    """The registered draws, batch by batch; they do not depend on the batch size."""
    rng = np.random.default_rng(seed)
    for at in range(0, replicates, batch):
        yield rng.multinomial(clusters, np.full(clusters, 1 / clusters), size=min(batch, replicates - at))


def registered_auroc(df: DataFrame, keys: Sequence[str], sizes: DataFrame, replicates: int, seed: int, cohort: str = "cohort", place: str = "place") -> DataFrame:
    """keys, replicate, auroc by the registered stream: replicate_auroc() with registered_weights(), whose draws are never rows of a cluster.

    df: keys (cohort among them), place (of the cluster in its cohort, from 0), p, y. sizes: cohort, n. Places go in spans; a batch's draws leave their
    task as a block a span, and meet the rows of the span in a task that keeps the sums of each score for all of its spans.
    """
    spark = df.sparkSession
    sizes = cut(sizes.select(cohort, F.col("n").cast("long").alias("n")))
    each = F.ceil(F.col("n") / SPAN).cast("long")
    # A row a cohort.
    every_row = W.orderBy(cohort)
    sizes = sizes.withColumns({"number": F.row_number().over(every_row) - 1, "before": F.sum(each).over(every_row) - each})
    cohorts, spans = sizes.agg(F.count("*"), F.sum(each)).first()
    parts = max(1, min(int(spans or 0), 2 * spark.sparkContext.defaultParallelism))
    states = states_of_batches(sizes.repartitionById(max(cohorts, 1), F.col("number").cast("int")), cohort, replicates, seed)
    blocks = blocks_from_states(cut(states), cohort, replicates)
    where, span = F.broadcast(sizes.select(cohort, "before")), lambda c: (F.col("before") + F.col(c)).cast("long").alias("span")
    p = (F.col("p") + F.lit(0.0)).cast("double")
    rows = df.withColumns({"p": p, "bucket": score_bucket(p, FINE), "own": F.floor(F.col(place) / SPAN)}).join(where, cohort)
    rows = rows.select(span("own"), F.lit(1).alias("kind"), *keys, "bucket", F.xxhash64(*keys, "bucket").alias("group"), "p", F.col("y").cast("double").alias("y"), (F.col(place) % SPAN).cast("int").alias("slot"), F.lit(None).cast("binary").alias("block"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*keys, "bucket")]
    # A block has its replicates' number for a group, and the first of them for a slot.
    blocks = blocks.join(where, cohort).select(span("own"), F.lit(0).alias("kind"), *none, F.col("size").cast("long").alias("group"), *[F.lit(None).cast("double").alias(c) for c in ("p", "y")], F.col("first").alias("slot"), "block")
    both = rows.unionByName(blocks).withColumn("part", F.floor(F.col("span") * parts / max(int(spans or 0), 1)).cast("int"))
    dealt = both.repartitionById(parts, "part").drop("part").sortWithinPartitions((F.col("span") * 2 + F.col("kind")))
    return scan_sums(span_sums(dealt, keys, replicates), keys, (), replicates).select(*keys, "replicate", "auroc")


def states_of_batches(sizes: DataFrame, cohort: str, replicates: int, seed: int) -> DataFrame:
    """cohort, n, first, size, state: stream_states() of batches whose draws fill BLOCKS bytes at most."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng, every = np.random.default_rng(seed), max(1, min(100, BLOCKS // n))
                kept = []
                for at in range(0, replicates, every):
                    kept.append((at, min(every, replicates - at), state_text(rng)))
                    for _ in range(kept[-1][1]):
                        rng.multinomial(n, np.full(n, 1 / n))
                firsts, counts, texts = zip(*kept)
                columns = [pa.array([name] * len(kept), batch.schema.types[0]), pa.array([n] * len(kept)), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32()), pa.array(texts)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = StructType([sizes.schema[cohort], StructField("n", LongType()), StructField("first", IntegerType()), StructField("size", IntegerType()), StructField("state", StringType())])
    return sizes.select(cohort, "n").mapInArrow(states, schema)


def blocks_from_states(states: DataFrame, cohort: str, replicates: int) -> DataFrame:
    """cohort, own (the span), first, size, block (bytes [places, replicates of the batch]), every batch in a task that follows from its own number."""
    spark = states.sparkSession
    order = W.orderBy("first", cohort)
    # A row a batch.
    dealt = states.withColumn("task", F.row_number().over(order) - 1).repartitionById(4 * spark.sparkContext.defaultParallelism, F.col("task").cast("int"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, n, first, size, text in zip(*[rows.column(c).to_pylist() for c in (cohort, "n", "first", "size", "state")]):
                rng, even = generator(text), np.full(n, 1 / n)
                drawn = np.zeros((size, n), np.int8)
                for k in range(size):
                    drawn[k] = as_bytes(rng.multinomial(n, even))
                for own in range(-(-n // SPAN)):
                    block = np.ascontiguousarray(drawn[:, own * SPAN : (own + 1) * SPAN].T).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name], rows.schema.field(cohort).type), pa.array([own]), pa.array([first], pa.int32()), pa.array([size], pa.int32()), pa.array([block], pa.binary())], schema.names)

    schema = StructType([states.schema[cohort], StructField("own", LongType()), *[StructField(c, IntegerType()) for c in ("first", "size")], StructField("block", BinaryType())])
    return dealt.mapInArrow(draw, schema)


def span_sums(dealt: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """score_sums() of rows and blocks in order of their spans, blocks first: a task adds up each score's weights over its spans, as far as SUMS bytes hold them."""
    plain = [*keys, "bucket", "group", "p"]
    schema = StructType([*[dealt.schema[k] for k in plain], *[StructField(c, LongType() if c == "cluster" else DoubleType()) for c in ("cluster", "pos", "neg")], *[StructField(c, BinaryType()) for c in ("w", "pos_w", "neg_w")]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((SPAN, replicates), np.uint8)
        held: dict[tuple[int, float, float], np.ndarray] = {}
        names: dict[int, tuple] = {}
        waiting: list[pa.RecordBatch] = []

        def add() -> None:
            if not waiting:
                return
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            g, p, y, slot = (rows.column(c).to_numpy() for c in ("group", "p", "y", "slot"))
            for group, i in zip(*np.unique(g, return_index=True)):
                if int(group) not in names:
                    names[int(group)] = tuple(rows.column(k)[int(i)].as_py() for k in (*keys, "bucket", "group"))
            order = np.lexsort((y, p, g))
            g, p, y, slot = g[order], p[order], y[order], slot[order]
            edges = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (y[1:] != y[:-1])) + 1, [len(g)]])
            lows = edges[:-1]
            # So many bytes add up within a byte.
            step = 255 // max(int(matrix.max()), 1)
            for low, high, at, score, label in zip(lows.tolist(), edges[1:].tolist(), g[lows].tolist(), p[lows].tolist(), y[lows].tolist()):
                sums = held.get((at, score, label))
                if sums is None:
                    sums = held[at, score, label] = np.zeros(replicates, np.uint32)
                for i in range(low, high, step):
                    own = slot[i : min(i + step, high)]
                    sums += matrix[own[0]] if len(own) == 1 else matrix.take(own, axis=0).sum(axis=0, dtype=np.uint8)

        def out() -> Iterator[pa.RecordBatch]:
            cells: dict[tuple[int, float], list[tuple[float, np.ndarray]]] = {}
            for (at, score, label), sums in held.items():
                cells.setdefault((at, score), []).append((label, sums))
            held.clear()
            every = list(cells.items())
            step = max(1, HELD // 4 // replicates)
            for low in range(0, len(every), step):
                some = every[low : low + step]
                pos, neg = ([packed(sum(share(label) * sums.astype(np.float64) for label, sums in found)) for _, found in some] for share in (float, lambda label: 1 - label))
                n = len(some)
                own = [pa.array(c, t) for c, t in zip(zip(*(names[at] for (at, _), _ in some)), kinds)]
                columns = [*own, pa.array([score for (_, score), _ in some], pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.binary()), pa.array(pos, pa.binary()), pa.array(neg, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        span, kinds = None, []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in (*keys, "bucket", "group")]
            at = batch.column("span").to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for low, high in zip(edges, edges[1:]):
                if at[low] != span:
                    add()
                    span = at[low]
                    matrix[:] = 0
                    if len(held) * replicates * 4 > SUMS:
                        yield from out()
                own = batch.slice(low, high - low)
                blocks = int((own.column("kind").to_numpy() == 0).sum())
                for i in range(blocks):
                    first, size = own.column("slot")[i].as_py(), own.column("group")[i].as_py()
                    block = np.frombuffer(own.column("block")[i].as_buffer(), np.uint8).reshape(-1, size)
                    matrix[: len(block), first : first + size] = block
                if blocks < high - low:
                    waiting.append(own.slice(blocks).select([*plain, "y", "slot"]))
                    if sum(b.num_rows for b in waiting) >= WAITING:
                        add()
        add()
        yield from out()

    return dealt.select("span", "kind", *plain, "y", "slot", "block").mapInArrow(task, schema)


class Kept:
    """Weights of a task's clusters as rows of bytes: made or read once, and used by all of the clusters' rows."""

    def __init__(self, replicates: int):
        self.replicates, self.at, self.rows = replicates, {}, np.zeros((64, replicates), np.uint8)

    def slots(self, clusters: list[int]) -> list[int]:
        """A row a cluster, new ones zero."""
        found = [self.at.setdefault(c, len(self.at)) for c in clusters]
        if len(self.at) > len(self.rows):
            more = np.zeros((max(len(self.at), 2 * len(self.rows)) - len(self.rows), self.replicates), self.rows.dtype)
            self.rows = np.concatenate([self.rows, more])
        return found

    def read(self, clusters: list[int], firsts: list[int], weights: pa.Array) -> None:
        """Given weights, each from its first replicate on."""
        flat, ends = weights.flatten().to_numpy(), np.concatenate([[0], np.cumsum(weights.value_lengths().to_numpy())])
        if flat.max(initial=0) > np.iinfo(self.rows.dtype).max:
            self.rows = self.rows.astype(np.int64)
        slots, lengths = np.array(self.slots(clusters)), np.diff(ends)
        for first, n in sorted({*zip(firsts, lengths.tolist())}):
            some = (np.array(firsts) == first) & (lengths == n)
            self.rows[slots[some], first : first + n] = flat[np.repeat(some, lengths)].reshape(-1, n)

    def of(self, clusters: np.ndarray, given: bool) -> tuple[np.ndarray, np.ndarray]:
        """A matrix and the row of each cluster in it; hashed weights past KEPT bytes are made anew."""
        own, back = np.unique(clusters, return_inverse=True)
        if given:
            return self.rows, np.array([self.at.get(c, -1) for c in own.tolist()])[back]
        fresh = np.array([c not in self.at for c in own.tolist()])
        if (len(self.at) + fresh.sum()) * self.replicates > KEPT:
            return hash_counts(own, self.replicates), back
        if fresh.any():
            slots = self.slots(own[fresh].tolist())
            self.rows[slots] = hash_counts(own[fresh], self.replicates)
        return self.rows, np.array([self.at[c] for c in own.tolist()])[back]


def with_weights(rows: DataFrame, cluster: str, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return rows.withColumn("cluster", F.col(cluster).cast("long"))
    on = [c for c in weights.columns if c != "weights"]
    return rows.join(weights.hint("merge"), on).withColumn("cluster", F.xxhash64(*on))


def replicate_sums(basis: DataFrame, keys: Sequence[str], columns: Sequence[str], replicates: int = REPLICATES, cluster: str = "cluster_id", weights: DataFrame | None = None, deal: bool = True) -> DataFrame:
    """keys, replicate and the weighted sums of the columns, at whatever grain basis comes.

    Rows are dealt and sorted by cluster, so that a weight is made once for all of a cluster's rows; a task sums a run of clusters by key
    and multiplies that matrix with their weights. deal=False leaves rows where they are, for hashed weights and few keys: then weights are made
    once for a batch's rows of a cluster, which costs less than a shuffle where a record's rows come together.
    """
    rows = with_weights(basis, cluster, weights)
    rows = rows.select(*keys, F.xxhash64(*keys).alias("group"), *[F.col(c).cast("double").alias(c) for c in columns], "cluster", *(["weights"] if weights is not None else []))
    schema, given = StructType([rows.schema[k] for k in keys] + [StructField(c, ArrayType(DoubleType())) for c in columns]), weights is not None
    if deal or given:
        rows = rows.repartition("cluster").sortWithinPartitions("cluster")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[pa.Array], np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for own, sums in held.values():
                yield pa.RecordBatch.from_arrays([*own, *[pa.array([v], pa.list_(pa.float64())) for v in sums]], schema.names)
            held.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, 4 * CHUNK):
                batch = whole.slice(at, 4 * CHUNK)
                own, one, member = np.unique(batch.column("cluster").to_numpy(), return_index=True, return_inverse=True)
                if not given:
                    w = hash_counts(own, replicates).astype(float)
                else:
                    w = np.stack([batch.column("weights")[i].values.to_numpy() for i in one.tolist()]).astype(float)
                values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
                groups, first, group = np.unique(batch.column("group").to_numpy(), return_index=True, return_inverse=True)
                for low in range(0, len(groups), step := max(1, HELD // max(len(own), replicates) // len(columns))):
                    some = groups[low : low + step]
                    mine = (group >= low) & (group < low + step)
                    place = (group[mine] - low) * len(own) + member[mine]
                    dense = np.concatenate([np.bincount(place, v[mine], len(some) * len(own)).reshape(len(some), len(own)) for v in values])
                    sums = (dense @ w).reshape(len(columns), len(some), replicates)
                    for i, g in enumerate(some.tolist()):
                        if g in held:
                            held[g][1][:] += sums[:, i]
                        else:
                            held[g] = [batch.column(k).slice(first[low + i], 1) for k in range(len(keys))], sums[:, i].copy()
                    if len(held) * replicates * len(columns) > HELD:
                        yield from out()
        yield from out()

    parts = rows.mapInArrow(task, schema).select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("replicate", "s"))
    return parts.groupBy(*keys, "replicate").agg(*[F.sum(f"s.{c}").alias(c) for c in columns])


def threshold_replicates(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], replicates: int = REPLICATES, cluster: str = "cluster_id") -> DataFrame:
    """keys, replicate, pos, neg, and tp_i, fp_i at each of the rising thresholds, by hash weights: sums by step between thresholds, so nothing is sorted or dealt."""
    y = F.col("y").cast("double")
    rows = df.select(*keys, cluster, steps_reached(F.col("p"), thresholds).alias("step"), y.alias("pos"), (1 - y).alias("neg"))
    sums = replicate_sums(rows, [*keys, "step"], ["pos", "neg"], replicates, cluster, deal=False)
    over = [F.sum(F.when(F.col("step") > i, F.col(c)).otherwise(0.0)).alias(f"{kind}_{i}") for i in range(len(thresholds)) for kind, c in (("tp", "pos"), ("fp", "neg"))]
    return sums.groupBy(*keys, "replicate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *over)


class Scan:
    """One key's bucket in score order: weighted pairs won by positives, for all replicates at once."""

    def __init__(self, replicates: int):
        self.pos, self.neg, self.wins = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        self.score: float | None = None
        self.tied_pos, self.tied_neg = np.zeros(replicates), np.zeros(replicates)

    def close(self) -> None:
        """The last score's rows are all there."""
        self.wins += self.tied_pos * (self.neg + self.tied_neg / 2)
        self.pos += self.tied_pos
        self.neg += self.tied_neg
        self.tied_pos, self.tied_neg, self.score = self.tied_pos * 0, self.tied_neg * 0, None

    def add(self, p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """More rows with weighted positives and negatives [rows, replicates], none below the ones before; the last score stays open, as its rows may go on."""
        if self.score is not None and p[0] != self.score:
            self.close()
        last = int(np.searchsorted(p, p[-1]))
        if last and self.score is not None:
            same = int(np.searchsorted(p, self.score, side="right"))
            self.tied_pos += pos[:same].sum(axis=0)
            self.tied_neg += neg[:same].sum(axis=0)
            self.close()
            p, pos, neg, last = p[same:], pos[same:], neg[same:], last - same
        if last:
            # A row wins against all below its score and half of those at it: the mean of the sums before and after its ties.
            sums = np.concatenate([self.neg[None], self.neg + np.cumsum(neg[:last], axis=0)])
            own = p[:last]
            reach = sums[np.searchsorted(own, own)] + sums[np.searchsorted(own, own, side="right")]
            self.wins += (pos[:last] * reach).sum(axis=0) / 2
            self.pos += pos[:last].sum(axis=0)
            self.neg = sums[-1]
        self.score = float(p[-1])
        self.tied_pos += pos[last:].sum(axis=0)
        self.tied_neg += neg[last:].sum(axis=0)


def replicate_auroc(df: DataFrame, keys: Sequence[str], replicates: int = REPLICATES, cluster: str = "cluster_id", weights: DataFrame | None = None) -> DataFrame:
    """keys, replicate, auroc by hash weights, or by weights (an array entry a replicate): one sort for all replicates."""
    return replicate_scan(df, keys, (), replicates, cluster, weights).select(*keys, "replicate", "auroc")


def score_sums(df: DataFrame, keys: Sequence[str], replicates: int, cluster: str, weights: DataFrame | None, every: int | None) -> DataFrame:
    """keys, bucket, group, p and either pos_w, neg_w (weighted sums of many rows of one score, an entry a replicate) or a row's cluster, pos, neg (and w, its given weights).

    Rows are dealt by cluster, so that a cluster's weights are made or read once a task, and sorted by score: where a task has many rows of a
    score, one product sums them; rows of rare scores go on as they are.
    """
    keep = [*keys, F.col("cluster"), (F.col("p") + F.lit(0.0)).cast("double").alias("p"), F.col("y").cast("double").alias("pos"), (1 - F.col("y")).cast("double").alias("neg")]
    given = weights is not None
    if given:
        on = [c for c in weights.columns if c not in ("batch", "weights")]
        first = F.col("batch") * every if every else F.lit(0)
        rows = df.withColumn("cluster", F.xxhash64(*on)).select(*keep, F.lit(1).alias("kind"), F.lit(0).alias("first"), F.lit(None).cast(weights.schema["weights"].dataType).alias("weights"))
        told = weights.select(*[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys], F.xxhash64(*on).alias("cluster"), *[F.lit(None).cast("double").alias(c) for c in ("p", "pos", "neg")], F.lit(0).alias("kind"), first.cast("int").alias("first"), "weights")
        rows = rows.unionByName(told)
    else:
        rows = df.withColumn("cluster", F.col(cluster).cast("long")).select(*keep)
    # Equal keys need to meet, in whatever order: one number sorts faster than the keys.
    order = [*(["kind"] if given else []), "group", "p"]
    rows = rows.withColumn("bucket", score_bucket(F.col("p"), FINE)).withColumn("group", F.xxhash64(*keys, "bucket")).repartition("cluster").sortWithinPartitions(*order)
    schema = StructType([*[rows.schema[k] for k in (*keys, "bucket", "group", "p", "cluster", "pos", "neg")], *[StructField(c, BinaryType()) for c in ("w", "pos_w", "neg_w")]])
    plain = schema.names[:-3]
    most = max(1, HELD // 8 // replicates)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(replicates)
        for batch in batches:
            if given:
                told_here = int((batch.column("kind").to_numpy() == 0).sum())
                if told_here:
                    part = batch.slice(0, told_here)
                    kept.read(part.column("cluster").to_pylist(), part.column("first").to_pylist(), part.column("weights"))
                    batch = batch.slice(told_here)
                if not batch.num_rows:
                    continue
            matrix, slot = kept.of(batch.column("cluster").to_numpy(), given)
            if (slot < 0).any():
                # As in a join, rows of clusters without weights take no part.
                batch, slot = batch.filter(pa.array(slot >= 0)), slot[slot >= 0]
                if not batch.num_rows:
                    continue
            g, p, values = batch.column("group").to_numpy(), batch.column("p").to_numpy(zero_copy_only=False), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "neg")])
            edges = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1])) + 1, [len(g)]])
            long = np.diff(edges) >= MANY
            alone = np.flatnonzero(np.repeat(~long, np.diff(edges)))
            for at in range(0, len(alone), most if given else max(len(alone), 1)):
                some = alone[at : at + most] if given else alone
                own = batch.select(plain).take(pa.array(some))
                w = pa.array([packed(r) for r in matrix[slot[some]]], pa.binary()) if given else pa.nulls(len(some), pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns, w, *[pa.nulls(len(some), pa.binary())] * 2], schema.names)
            lows, highs = edges[:-1][long], edges[1:][long]
            for at in range(0, len(lows), most):
                sums = np.zeros((min(most, len(lows) - at), 2, replicates))
                for i, (low, high) in enumerate(zip(lows[at : at + most].tolist(), highs[at : at + most].tolist())):
                    sums[i] = row_sums(values[:, low:high], matrix, slot[low:high])
                own = batch.select(plain).take(pa.array(lows[at : at + most]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.nulls(len(sums), pa.binary()), *[pa.array([packed(v) for v in sums[:, k]], pa.binary()) for k in (0, 1)]], schema.names)

    return rows.select(*plain, *(["kind", "first", "weights"] if given else [])).mapInArrow(task, schema)


def row_sums(values: np.ndarray, matrix: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Positives' and negatives' weights added up over rows, [2, replicates]."""
    if matrix.dtype == np.uint8 and ((values == 0) | (values == 1)).all() and (values.sum(axis=0) == 1).all():
        # 256 bytes add up within 16 bits.
        add = lambda own: sum((matrix[own[at : at + 256]].sum(axis=0, dtype=np.uint16).astype(np.float64) for at in range(0, len(own), 256)), np.zeros(matrix.shape[1]))
        return np.stack([add(slot[values[0] == 1]), add(slot[values[1] == 1])])
    return sum(values[:, at : at + CHUNK] @ matrix[slot[at : at + CHUNK]].astype(np.float64) for at in range(0, len(slot), CHUNK))


def packed(vector: np.ndarray) -> bytes:
    """A vector in the fewest bytes an entry (1, 2, 4 or 8) that hold it exactly."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if vector.min() >= 0 and vector.max() <= np.iinfo(kind).max and (vector == (own := vector.astype(kind))).all():
            return own.tobytes()
    return vector.astype(np.float64).tobytes()


def unpacked(text: bytes, replicates: int) -> np.ndarray:
    return np.frombuffer(text, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}[len(text) // replicates])


def weighted(batch: pa.RecordBatch, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted positives and negatives [rows, replicates] of score_sums()' rows."""
    pos, neg = np.zeros((2, batch.num_rows, replicates))
    summed = batch.column("pos_w").is_valid().to_numpy(zero_copy_only=False)
    if summed.any():
        for out, name in ((pos, "pos_w"), (neg, "neg_w")):
            out[summed] = [unpacked(v, replicates) for v in batch.column(name).drop_null().to_pylist()]
    if not summed.all():
        rest = batch.filter(pa.array(~summed))
        if rest.column("w").null_count:
            w = hash_weights(rest.column("cluster").to_numpy(), replicates)
        else:
            w = np.stack([unpacked(v, replicates) for v in rest.column("w").to_pylist()]).astype(float)
        pos[~summed], neg[~summed] = (w * rest.column(c).to_numpy()[:, None] for c in ("pos", "neg"))
    return pos, neg


def replicate_scan(
    df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], replicates: int = REPLICATES, cluster: str = "cluster_id", weights: DataFrame | None = None, every: int | None = None
) -> DataFrame:
    """keys, replicate, auroc, pos, neg, and tp_i, fp_i at each threshold: rank and threshold sums of one sorted scan of weighted scores.

    every: weights come in batches (a column batch) of so many replicates.
    """
    return scan_sums(score_sums(df, keys, replicates, cluster, weights, every), keys, thresholds, replicates)


def scan_sums(sums_: DataFrame, keys: Sequence[str], thresholds: Sequence[float], replicates: int) -> DataFrame:
    """replicate_scan() of score_sums()."""
    rows = sums_.repartition(*keys, "bucket").sortWithinPartitions(*keys, "bucket", "p")
    flags = [f"{kind}_{i}" for i in range(len(thresholds)) for kind in ("tp", "fp")]
    sums = ("pos", "neg", "wins", *flags)
    schema = StructType([*[rows.schema[k] for k in keys], StructField("bucket", IntegerType()), *[StructField(c, ArrayType(DoubleType())) for c in sums]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, scan, names, over = None, Scan(replicates), [], np.zeros((len(flags), replicates))
        size = max(1, min(CHUNK, HELD // 4 // replicates))

        def out() -> Iterator[pa.RecordBatch]:
            if group is not None:
                scan.close()
                vars(scan).update(zip(flags, over))
                yield pa.RecordBatch.from_arrays([*names, *[pa.array([getattr(scan, c)], pa.list_(pa.float64())) for c in sums]], schema.names)

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                pos, neg = weighted(batch, replicates)
                g, p = batch.column("group").to_numpy(), batch.column("p").to_numpy()
                edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
                for low, high in zip(edges, edges[1:]):
                    if g[low] != group:
                        yield from out()
                        group, scan, names = g[low], Scan(replicates), [batch.column(i).slice(low, 1) for i in range(len(keys) + 1)]
                        over = np.zeros((len(flags), replicates))
                    scan.add(p[low:high], pos[low:high], neg[low:high])
                    for i, t in enumerate(thresholds):
                        # Rows are in the order of their scores.
                        first = low + int(np.searchsorted(p[low:high], t))
                        over[2 * i] += pos[first:high].sum(axis=0)
                        over[2 * i + 1] += neg[first:high].sum(axis=0)
        yield from out()

    parts = rows.mapInArrow(task, schema).select(*keys, "bucket", F.posexplode(F.arrays_zip(*sums)).alias("replicate", "s"))
    return from_buckets(parts.select(*keys, "bucket", "replicate", "s.*"), [*keys, "replicate"], flags)


def rung_replicates(df: DataFrame, rungs: DataFrame, names: Sequence[str], keys: Sequence[str], replicates: int = REPLICATES, cluster: str = "cluster_id", weights: DataFrame | None = None) -> DataFrame:
    """keys, rung, replicate, ece, brier, n: calibration error of every recalibration of the scores, never fitted again inside a replicate.

    rungs: keys, rung, slope, offset on the logit (null: as they are). A score's weighted sums give its share to each rung's bin in the task that
    made them: neither rows nor sums are copied by rung before they are added up.
    """
    wide = rungs.groupBy(*keys).agg(*[F.max(F.when(F.col("rung") == r, F.struct("slope", "offset"))).alias(f"map_{i}") for i, r in enumerate(names)])
    # A row a key and a struct a rung: as many as the labels list.
    rows = score_sums(df, keys, replicates, cluster, weights, None).join(F.broadcast(wide), list(keys))
    own = [affine(F.col("p"), F.col(f"map_{i}.slope"), F.col(f"map_{i}.offset")) for i in range(len(names))]
    rows = rows.withColumns({"q": F.array(*own), "bins": F.array(*[bin_index(q) for q in own]), "key": F.xxhash64(*keys)})
    rows = rows.select(*keys, "key", "q", "bins", "cluster", "pos", "neg", "w", "pos_w", "neg_w")
    columns = ("n", "sum_y", "sum_p", "sum_sq")
    schema = StructType([rows.schema[k] for k in keys] + [StructField("rung", StringType()), StructField("bin", IntegerType()), *[StructField(c, ArrayType(DoubleType())) for c in columns]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[list[pa.Array], np.ndarray]] = {}
        size = max(1, min(CHUNK, HELD // 4 // replicates))

        def out() -> Iterator[pa.RecordBatch]:
            for (_, i, b), (mine, sums) in held.items():
                yield pa.RecordBatch.from_arrays([*mine, pa.array([names[i]]), pa.array([b], pa.int32()), *[pa.array([v], pa.list_(pa.float64())) for v in sums]], schema.names)
            held.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                pos, neg = weighted(batch, replicates)
                q, bins = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)) for c in ("q", "bins"))
                key = batch.column("key").to_numpy()
                for k in np.unique(key).tolist():
                    mine = np.flatnonzero(key == k)
                    for i in range(len(names)):
                        found, at_bin = np.unique(bins[mine, i], return_inverse=True)
                        share, own = (np.arange(len(found))[:, None] == at_bin).astype(float), q[mine, i]
                        y, no = share @ pos[mine], share @ neg[mine]
                        sums = y + no, y, share * own @ (pos[mine] + neg[mine]), share * (1 - own) ** 2 @ pos[mine] + share * own**2 @ neg[mine]
                        for b, v in zip(found.tolist(), np.stack(sums, axis=1)):
                            if (k, i, b) in held:
                                held[k, i, b][1][:] += v
                            else:
                                held[k, i, b] = [batch.column(c).slice(mine[0], 1) for c in range(len(keys))], v
                if len(held) * replicates * len(columns) > 4 * HELD:
                    yield from out()
        yield from out()

    parts = rows.mapInArrow(task, schema).select(*keys, "rung", "bin", F.posexplode(F.arrays_zip(*columns)).alias("replicate", "s"))
    sums = parts.groupBy(*keys, "rung", "bin", "replicate").agg(*[F.sum(f"s.{c}").alias(c) for c in columns])
    return from_totals(sums, [*keys, "rung", "replicate"])


def interval(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """keys, lower, upper, mean, median, defined: percentiles by linear interpolation over finite values."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    tail = (1 - level) / 2
    q = F.percentile(v, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    return df.groupBy(*keys).agg(q.alias("q"), F.avg(v).alias("mean"), F.count(v).alias("defined")).select(
        *keys, F.col("q")[0].alias("lower"), F.col("q")[2].alias("upper"), F.col("q")[1].alias("median"), "mean", "defined"
    )


def contrast(df: DataFrame, keys: Sequence[str], by: str, a: str, b: str, value: str) -> DataFrame:
    """keys and value(a) - value(b); keys name the replicate, so the two are paired by it."""
    side = lambda x, name: [F.count_if(F.col(by) == x).alias(f"n_{name}"), F.max(F.when(F.col(by) == x, F.col(value))).alias(name)]
    both = df.where(F.col(by).isin(a, b)).groupBy(*keys).agg(*side(a, "va"), *side(b, "vb"))
    return both.where("n_va > 0 and n_vb > 0").select(*keys, (F.col("va") - F.col("vb")).alias("change"))


def against(df: DataFrame, keys: Sequence[str], by: str, base: str, value: str) -> DataFrame:
    """Rows other than the base's with inside (the base's value at the same keys) and change from it; rows whose keys the base lacks leave. One pass, no self-join."""
    same, mine = W.partitionBy(*keys), F.col(by) == base
    rows = df.withColumn("inside", F.max(F.when(mine, F.col(value))).over(same)).withColumn("based", F.count_if(mine).over(same))
    return rows.where((F.col(by) != base) & (F.col("based") > 0)).drop("based").withColumn("change", F.col(value) - F.col("inside"))


def p_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two-sided, with one added to both counts."""
    low, high, n = F.count_if(F.col(value) <= 0), F.count_if(F.col(value) >= 0), F.count(value)
    return df.groupBy(*keys).agg(F.least(F.lit(1.0), 2 * F.least((low + 1) / (n + 1), (high + 1) / (n + 1))).alias("p_value"))


def benjamini_hochberg(df: DataFrame, family: Sequence[str], p: str, ties: Sequence[str]) -> DataFrame:
    """Adds q: the smallest adjusted p at this rank or a later one, 1 at most."""
    m = F.count("*").over(W.partitionBy(*family))
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*family).orderBy(p, *ties))).withColumn("adjusted", F.col(p) * m / F.col("rank"))
    later = W.partitionBy(*family).orderBy("rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    return ranked.withColumn("q", F.least(F.min("adjusted").over(later), F.lit(1.0))).drop("rank", "adjusted")


def subsample(df: DataFrame, keys: Sequence[str], record: str, fraction: float, draw: Column) -> DataFrame:
    """Without replacement: the rounded fraction of each key's records that come first by a hash of record and draw."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n_all"))
    placed = places(df.withColumn("drawn", F.md5(F.concat_ws("#", F.col(record).cast("string"), draw.cast("string")))), keys, ["drawn", record])
    return placed.join(sizes, list(keys)).where(F.col("place") < F.rint(F.col("n_all") * fraction)).drop("place", "drawn", "n_all")


def within(own: DataFrame, other: DataFrame, keys: Sequence[str], value: str, published: str, tolerance: float) -> DataFrame:
    """own with other's column and within: whether both differ by at most tolerance; a row of one only is not within."""
    both = own.join(other, list(keys), "full")
    return both.withColumn("within", F.coalesce(F.abs(F.col(value) - F.col(published)) <= tolerance, F.lit(False)))
