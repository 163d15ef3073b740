"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a hash of id and text; the hash also permutes them. A source's target, in
words, gives whole passes over its blocks and a rest, which takes blocks in order up to the word where the rest ends. So
quotas are exact. The tree splits the output shards in halves again and again; at each node the blocks that go left are
drawn from all sources at once, multivariate-hypergeometrically, so every shard gets an exact count of blocks of
every source. A shard takes the next such run of each source's permuted blocks, and orders its rows by a hash.

Targets are filled like water: sources in the order of their cap by weight, with running totals. Of the tree, the driver
draws only the part over groups of GROUP sources; a task a group draws the same tree inside its group, given the group's
counts, which is the same distribution. Blocks grow in number with the rows, so none holds much over BLOCK_ROWS rows.

Nulls and ties: a null source is a source of its own, last in order; a null text has size 0; a null
id hashes as such; repeated rows are mixed each on their own; a source without words has target 0;
an empty table gives no rows. Columns of the mixed table keep their names; with extras, mix_pass and mix_shard replace
columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, running_totals

#: Blocks of a source at least, and rows of a block aimed at beyond.
BLOCKS = 4096
BLOCK_ROWS = 1 << 16
#: Sources that one task splits over the shards.
GROUP = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARDS = 256
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: Sequence[float], ratio: float, most: float, scratch: Scratch) -> DataFrame:
    """sources (mix_source, words): adds place (in the sources' order, from 0) and target.

    The target is ratio times all words, shared by weight, none above most times its words, the excess shared again: level
    times weight or the cap, whichever is less. In the order of cap by weight the capped ones come first.
    """
    placed = running_totals(sources, [F.col("mix_source").startswith("~"), F.col("mix_source")], {"place": F.lit(1)}, scratch)
    share = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    capped = placed.withColumn("weight", share).withColumn("cap", F.lit(float(most)) * F.col("words"))
    sums = running_totals(capped, [F.col("cap") / F.col("weight"), F.col("place")], {"caps": F.col("cap"), "used": F.col("weight")}, scratch)
    whole = sums.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = whole["words"] or 0, whole["weight"] or 0.0
    level = (F.lit(ratio * words) - F.col("caps")) / (F.lit(weight) - F.col("used"))
    # The first source whose cap is not below the level sets it for all after.
    found = sums.select(level.alias("level"), (F.col("cap") / F.col("weight")).alias("reach"), "place").where("level <= reach").agg(F.min(F.struct("reach", "place", "level")).alias("x")).first()["x"]
    goal = F.col("cap") if found is None else F.least("cap", F.lit(found["level"]) * F.col("weight"))
    return sums.select("mix_source", "words", "place", goal.alias("target"))


def split_tree(quotas: Sequence[int], shards: int, seed: Sequence[int], totals: Sequence[int] | None = None) -> np.ndarray:
    """counts[shard, column]: each node sends a multivariate-hypergeometric draw of its blocks left.

    totals are the shards' sums, equal to within one a node if not given. All quotas are below 10^9 in sum.
    """
    counts = np.zeros((shards, len(quotas)), np.int64)
    own_totals = None if totals is None else np.concatenate([[0], np.cumsum(totals)])

    def node(low: int, high: int, own: np.ndarray) -> None:
        if high - low == 1:
            counts[low] = own
            return
        mid = (low + high) // 2
        rng = np.random.default_rng([*seed, low, high])
        count = int(own.sum()) * (mid - low) // (high - low) if own_totals is None else int(own_totals[mid] - own_totals[low])
        left = rng.multivariate_hypergeometric(own, count, method="marginals") if count else np.zeros_like(own)
        node(low, mid, left)
        node(mid, high, own - left)

    node(0, shards, np.asarray(quotas, np.int64))
    return counts


def shard_cuts(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (mix_source, place, quota): (mix_source, cuts), the running counts of its blocks by shard."""
    spark = quotas.sparkSession
    grouped = quotas.withColumn("part", F.floor(F.col("place") / GROUP))
    # A row for GROUP sources
    parts = grouped.groupBy("part").agg(F.sum("quota").alias("quota")).orderBy("part").collect()
    counts = split_tree([r["quota"] for r in parts], shards, [seed])
    shares = spark.createDataFrame([(r["part"], [int(x) for x in counts[:, i]]) for i, r in enumerate(parts)], "part long, totals array<long>")

    def split(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        inside = split_tree(own["quota"].tolist(), shards, [seed, int(own["part"].iloc[0])], own["totals"].iloc[0])
        return pd.DataFrame({"mix_source": own["mix_source"].to_numpy(), "cuts": list(np.cumsum(inside, axis=0).T)})

    return grouped.join(F.broadcast(shares), "part").groupBy("part").applyInPandas(split, "mix_source string, cuts array<long>")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(
    rows: DataFrame,
    keyed: DataFrame,
    weights: Sequence[float],
    ratio: float,
    most: float,
    shards: int,
    seed: int,
    whole: bool,
    scratch: Scratch,
) -> DataFrame:
    """rows with mix_id, mix_source, mix_size and mix_hash, keyed the same without further columns: adds block, source_size, target and draws.

    draws: array of (pass, words, shard). With whole, a document that the rest ends in is taken if its middle lies
    before that end; else it is taken up to that word.
    """
    spark = rows.sparkSession
    total = keyed.count()
    if not total:
        none = "array<struct<pass:int,words:bigint,shard:int>>"
        return rows.limit(0).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("block", "int"), ("source_size", "long"), ("target", "double"), ("draws", none))])
    own_block = F.pmod("mix_hash", F.lit(max(BLOCKS, total // BLOCK_ROWS))).cast("int").alias("block")
    blocks = keyed.groupBy("mix_source", own_block).agg(F.sum("mix_size").alias("words"))
    blocks = blocks.withColumn(
        "before", F.coalesce(F.sum("words").over(W.partitionBy("mix_source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    blocks = scratch.keep(blocks)
    plan = targets(blocks.groupBy("mix_source").agg(F.sum("words").alias("words")), weights, ratio, most, scratch)
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int")
    plan = plan.select("mix_source", "place", F.col("words").alias("source_size"), "target", passes.alias("passes"))
    plan = scratch.keep(plan.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))
    planned = blocks.join(plan, "mix_source")
    units = planned.select("mix_source", "place", "block", F.explode(F.expr("filter(sequence(0, passes), p -> p < passes or before < rest)")).alias("pass"))
    units = scratch.keep(units)
    # A source without a quota has no units and needs no cuts.
    cuts = shard_cuts(units.groupBy("mix_source", "place").agg(F.count("*").alias("quota")), shards, seed)
    order = W.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "pass", "block")
    dealt = (
        units.withColumn("rank", F.row_number().over(order) - 1)
        .join(cuts, "mix_source")
        .withColumn("shard", F.expr("size(filter(cuts, c -> c <= rank))"))
        .groupBy("mix_source", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("pass", "shard"))).alias("shards"))
    )
    dealt = scratch.keep(planned.join(dealt, ["mix_source", "block"], "left").drop("words", "place"))
    inside = W.partitionBy("mix_source", "block").orderBy(F.xxhash64(F.lit(seed), "mix_hash"), "mix_id", "mix_size")
    start = F.col("before") + F.coalesce(F.sum("mix_size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if whole:
        last = F.when(F.col("start") + F.col("mix_size") / 2 < F.col("rest"), F.col("mix_size"))
    else:
        last = F.when(F.col("start") < F.col("rest"), F.least(F.col("mix_size"), F.col("rest") - F.col("start")))
    return (
        rows.withColumn("block", own_block)
        .join(dealt, ["mix_source", "block"])
        .withColumn("start", start)
        .withColumn("last", last)
        .withColumn(
            "draws",
            F.expr(
                "transform(filter(sequence(0, passes), p -> p < passes or last is not null), p -> named_struct("
                "'pass', p, 'words', if(p < passes, mix_size, last), 'shard', shards[p]))"
            ),
        )
        .drop("before", "shards", "start", "passes", "rest", "last")
    )


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: bool) -> DataFrame:
    source, text, number = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    return docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")] if carry else []),
        number.alias("mix_id"),
        # "~" marks the null source, "=" all others
        F.when(source.isNull(), "~").otherwise(F.concat(F.lit("="), source)).alias("mix_source"),
        size_of(text).alias("mix_size"),
        F.xxhash64(F.lit(seed), number, text).alias("mix_hash"),
    )


def taken_words(
    docs: DataFrame, weights=WEIGHTS, ratio: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Each document's size, its source's size and target, its block and its draws, down to the word."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(keyed_rows(docs, id_col, text_col, source_col, seed, carry=False))
    out = draws(rows, rows, weights, ratio, most, shards, seed, False, scratch)
    return out.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", "block", "draws")


def mix(
    docs: DataFrame, weights=WEIGHTS, ratio: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extras: bool = True,
) -> DataFrame:
    """The mixed table: whole documents, once a draw, shuffled within shards; with extras, also mix_pass and mix_shard."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = scratch.keep(keyed_rows(docs, id_col, text_col, source_col, seed, carry=False))
    rows = keyed_rows(docs, id_col, text_col, source_col, seed, carry=True)
    out = draws(rows, keyed, weights, ratio, most, shards, seed, True, scratch)
    out = out.select("mix_row", F.explode("draws").alias("draw"), F.xxhash64(F.lit(seed), "draw.pass", "mix_hash").alias("mix_order"))
    out = out.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "mix_order")
    added = ("mix_pass", "mix_shard")
    fields = [F.col("mix_row")[c].alias(c) for c in docs.columns if not extras or c not in added]
    return out.select(*fields, *([F.col("draw.pass").alias("mix_pass"), F.col("draw.shard").alias("mix_shard")] if extras else []))
