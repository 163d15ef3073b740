"""Balanced label propagation: linked documents drift to one shard under capacity quotas.

Rows of equal text are a group. Groups move whole as one unit; a group of over a PARTS-th of a shard is cut into units of about
that size, so that no unit is too large to move and no key is hot. Units are linked through hubs: the
units of one cut group, those whose texts start alike, and those whose texts end alike (or what links the caller gives), so a hub of any size
costs one edge a unit and no pairs, and chains of such links have neighbours of neighbours.

Units start on the shard that their hash names. In each round every hub counts its units' rows by shard, and each unit wishes for the shard
that its hubs' most common labels speak for with most rows, if it has room and more than the unit's own. A shard admits the wishes with most support first, and only while its
linked rows stay within the round's quota: the room is dealt to blocks of units, each with its part, so the quota is strict. The labels then are
the shards but for the last repair: shards above their exact count give their rows of least support, those without links first, to the ones below.

Tables that are broadcast hold a row a shard, or a row a large hub: those of over a PARTS-th of a shard's rows, of which there are at
most PARTS x shards a kind of link. All other joins and windows are dealt by hash, in blocks of about BLOCK rows.

Nulls and ties: a null text has the size of none (16 with the fixed part), CRC-32 0, and is linked to the
other nulls; a null id keeps its row; repeated rows are dealt once each; an empty table gives no rows; ties go to the
smaller shard; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 4
#: A unit is at most about this part of a shard.
PARTS = 8
#: Rows of a block: of the windows that admit, rank and number.
BLOCK = 16_384
#: Part by which a shard's quota may pass its exact count in the first round; it falls to nothing in the last.
SLACK = 1.0
#: Characters of a text's start and end that link.
EDGE = 80


def ends(text: Column) -> list[Column]:
    """A text's start and end in small letters and single blanks; none for texts that are hardly longer than one of them."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    long = F.length(text) > 2 * EDGE
    return [F.when(long, plain(F.substring(text, 1, EDGE))), F.when(long, plain(F.right(text, F.lit(EDGE))))]


def large(df: DataFrame, key: str, least: int, weight: Column) -> DataFrame:
    """key, n of those with a weight of over least: a bounded number of them, as the weights of all have a sum."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(weight).alias("n")).where(F.col("n") > least)


def units_of(rows: DataFrame, least: int) -> DataFrame:
    """rows with unit: their group's hash, or of large groups one of the parts, and group where the group is large."""
    big = F.broadcast(large(rows, "same", least, F.lit(1)).withColumnRenamed("n", "members"))
    rows_of = rows.join(big, "same", "left")
    twins = rows_of.where(F.col("members").isNotNull() & F.col("key").isNotNull()).select(F.xxhash64("same", "key").alias("twins"))
    twins = F.broadcast(large(twins, "twins", least, F.lit(1)).select("twins", F.lit(True).alias("many")))
    # By id, so that shards do not hang on the input's order; rows without one, and many rows of one id and text, are told apart by their place.
    own = F.when(F.col("key").isNotNull() & F.col("many").isNull(), F.xxhash64("key")).otherwise(F.col("pick"))
    own = F.pmod(own, F.ceil(F.col("members") / F.lit(least)).cast("long"))
    return rows_of.join(twins, F.xxhash64("same", "key") == F.col("twins"), "left").select(
        *rows.columns, F.when(F.col("members").isNull(), F.col("same")).otherwise(F.xxhash64("same", own)).alias("unit"),
        F.when(F.col("members").isNotNull(), F.col("same")).alias("group"),
    )


def propagate(units: DataFrame, shards: int, total: int, least: int, rounds: int, scratch: Scratch) -> DataFrame:
    """units (unit, n, hubs, label): labels after the rounds, within quotas, with support (rows of its hubs' kind at its label)."""
    edges = scratch.keep(units.select("unit", "n", F.explode("hubs").alias("hub")))
    counted = edges.groupBy("hub").agg(F.count("*").alias("units"), F.sum("n").alias("rows")).where("units > 1")
    big = scratch.keep(counted.where(F.col("rows") > least).select("hub"))
    few = scratch.keep(counted.where(F.col("rows") <= least).select("hub"))
    # Edges of large hubs meet their votes by a broadcast, the others by a shuffle.
    near = scratch.keep(edges.join(F.broadcast(big), "hub", "left_semi"))
    far = scratch.keep(edges.join(few, "hub", "left_semi"))
    # Only linked rows count against the quota: the others can go anywhere, and the repair lets them make room.
    tied = near.union(far).select("unit").distinct().withColumn("tied", F.lit(True))
    labels = scratch.keep(units.join(tied, "unit", "left").select(
        "unit", "n", "label", F.when(F.col("tied") | (F.col("n") > 1), F.col("n")).otherwise(0).cast("long").alias("load")
    ))
    support = labels.select("unit", F.lit(0).cast("long").alias("support"))
    blocks = max(1, total // (shards * BLOCK))
    for step in range(rounds):
        capacity = int(-(-total // shards) * (1 + SLACK * (rounds - 1 - step) / rounds))
        # A row a shard
        load = labels.groupBy(F.col("label").alias("wish")).agg(F.sum("load").alias("load"))
        room = labels.sparkSession.range(shards).select(F.col("id").cast("int").alias("wish")).join(load, "wish", "left")
        room = room.select("wish", F.floor(F.greatest(F.lit(0), F.lit(capacity) - F.coalesce("load", F.lit(0))) / F.lit(blocks)).alias("room"))
        room = F.broadcast(scratch.keep(room.where("room > 0")))

        def heard(own: DataFrame, small: bool, now: DataFrame = labels, room: DataFrame = room) -> DataFrame:
            placed = own.join(now.select("unit", "label"), "unit")
            votes = placed.groupBy("hub", "label").agg(F.sum("n").alias("n")).join(room.withColumnRenamed("wish", "label"), "label", "left")
            # The most common label that has room, and the votes of all labels: at most one a shard.
            top = votes.groupBy("hub").agg(
                F.max(F.when(F.col("room").isNotNull(), F.struct("n", (-F.col("label")).alias("low")))).alias("top"),
                F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"),
            )
            top = top.select("hub", (-F.col("top.low")).alias("wish"), F.col("top.n").alias("votes"), "by")
            return placed.join(F.broadcast(top) if small else top, "hub").select("unit", "wish", "votes", F.element_at("by", F.col("label")).alias("stay"))

        wishes = heard(near, True).union(heard(far, False)).groupBy("unit", "wish").agg(F.sum("votes").alias("votes"), F.sum("stay").alias("stay"))
        wishes = wishes.groupBy("unit").agg(F.max(F.when(F.col("wish").isNotNull(), F.struct("votes", (-F.col("wish")).alias("low")))).alias("top"), F.sum("stay").alias("stay"))
        wishes = wishes.select("unit", (-F.col("top.low")).alias("wish"), F.col("top.votes").alias("votes"), "stay")
        asked = scratch.keep(labels.join(wishes, "unit", "left"))
        block = F.pmod(F.xxhash64("unit", F.lit(step)), F.lit(blocks))
        moving = asked.where("wish <> label and votes > stay").join(room, "wish").withColumn("block", block)
        upto = F.sum("load").over(W.partitionBy("wish", "block").orderBy(F.desc("votes"), F.xxhash64("unit", F.lit(step)), "unit").rowsBetween(W.unboundedPreceding, W.currentRow))
        admitted = moving.withColumn("upto", upto).where("upto <= room").select("unit", F.col("wish").alias("new"))
        moved = scratch.keep(asked.join(admitted, "unit", "left").select(
            "unit", "n", F.coalesce("new", "label").alias("label"), "load",
            F.coalesce(F.when(F.col("new").isNotNull(), F.col("votes")).otherwise(F.col("stay")), F.lit(0)).cast("long").alias("support"),
            F.col("new").isNotNull().alias("went"),
        ))
        done = moved.where("went").isEmpty()
        scratch.drop(asked)
        labels, support = moved.select("unit", "n", "label", "load"), moved.select("unit", "support")
        if done:
            break
    return labels.join(support, "unit", "left").select("unit", "n", "label", F.coalesce("support", F.lit(0)).alias("support"))


def repair(rows: DataFrame, shards: int, total: int, scratch: Scratch) -> DataFrame:
    """rows (label, support, n, unit, key, ...): adds shard and slot; counts at most one apart, and only what is too much moves."""
    blocks = max(1, total // (shards * BLOCK))
    # In a shard, rows of most support first: they stay. Rows without any partner are the first to go.
    rank_of = F.least(F.floor(F.log2(F.col("support") + F.col("n"))), F.lit(40)).cast("int")
    placed = scratch.keep(rows.withColumn("block", F.struct("label", (-rank_of).alias("kind"), F.pmod("unit", F.lit(blocks)).alias("part"))))
    order = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # Shards x blocks x 41 rows at most: in proportion to the rows over BLOCK
    before = placed.groupBy("block").agg(F.count("*").alias("n"))
    before = before.select("block", F.coalesce(F.sum("n").over(order.partitionBy("block.label")), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("block").orderBy("unit", "key", "size", "pick")) - 1
    ranked = placed.withColumn("number", number).join(before, "block").withColumn("rank", F.col("before") + F.col("number"))
    # A row a shard: what it has, what it gets, and where its surplus and its gaps lie among all.
    have = placed.groupBy("label").agg(F.count("*").alias("have"))
    each = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("label")).join(have, "label", "left").select(
        "label", F.coalesce("have", F.lit(0)).alias("have"), (F.lit(total // shards) + (F.col("label") < total % shards).cast("int")).alias("due")
    )
    earlier = W.orderBy("label").rowsBetween(W.unboundedPreceding, -1)
    over, under = F.greatest(F.col("have") - F.col("due"), F.lit(0)), F.greatest(F.col("due") - F.col("have"), F.lit(0))
    each = scratch.keep(each.select("label", "have", "due", F.coalesce(F.sum(over).over(earlier), F.lit(0)).alias("surplus"), F.coalesce(F.sum(under).over(earlier), F.lit(0)).alias("gap"), under.alias("open")))
    gaps = [r for r in each.where("open > 0").orderBy("label").collect()]  # shards rows at most
    ranked = ranked.join(F.broadcast(each.select("label", "due", "surplus")), "label")
    place = F.col("surplus") + F.col("rank") - F.col("due")
    target = F.struct(F.lit(0).cast("int").alias("shard"), F.lit(0).cast("long").alias("slot"))
    for r in gaps:
        target = F.when(place >= r["gap"], F.struct(F.lit(r["label"]).alias("shard"), (place - r["gap"] + r["have"]).cast("long").alias("slot"))).otherwise(target)
    final = F.when(F.col("rank") < F.col("due"), F.struct(F.col("label").alias("shard"), F.col("rank").cast("long").alias("slot"))).otherwise(target)
    return ranked.withColumn("final", final).select("key", "size", "text_crc32", F.col("label").alias("wished"), "final.shard", "final.slot")


def balanced_shards(
    docs: DataFrame,
    shards: int,
    links: Sequence[Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """Each row's shard (0 to shards - 1) and slot in it. links: columns whose equal values link rows, besides equal texts; null links nothing."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.col(f"`{text_col}`").cast("string")
    kinds = ends(text) if links is None else list(links)
    hubs = [F.when(c.isNotNull(), F.xxhash64(F.lit(i), c)) for i, c in enumerate(kinds, 1)]
    rows = scratch.keep(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.lit(0), text).alias("same"), F.array_compact(F.array(*hubs, F.lit(None).cast("long"))).alias("hubs"),
        # Tells apart rows of one id and text, as far as anything does.
        F.xxhash64(F.lit(1), F.monotonically_increasing_id()).alias("pick"),
    ))
    total = rows.count()
    least = max(1, total // (shards * PARTS))
    rows = scratch.keep(units_of(rows, least))
    units = rows.groupBy("unit").agg(F.count("*").alias("n"), F.max("group").alias("group"), F.max("hubs").alias("hubs"))
    units = units.select("unit", "n", F.array_compact(F.concat("hubs", F.array("group"))).alias("hubs"), F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int").alias("label"))
    units = scratch.keep(units)
    labels = propagate(units, shards, total, least, rounds, scratch)
    placed = repair(rows.join(labels, "unit"), shards, total, scratch)
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
