"""Prefix trie of conversations: digest-keyed nodes, and subtree sums by pointer jumping.

Texts leave the rows at once: a turn becomes a digest and its count of words, so what is dealt out is about 60 bytes a turn. A prefix's
key is the exclusive or of its turns' digests, each taken together with its place: a running aggregate, which is added up in blocks of
a conversation, so a long conversation is no single task either. Keys have 120 bits; they tell apart what comes by chance, not what an
adversary builds.

roll_up() doubles: after round k a node knows the sums of what hangs less than 2**k below it and the ancestor 2**k above it. A round is one
aggregate to those ancestors (summed on the map side, so hubs are no matter) and one join for the ancestor of the ancestor, made only
for nodes that have one below the root. Rounds are the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Turns of a conversation that one window adds up.
BLOCK = 4096
KEY = ("k1", "k2")
#: A word, as the contract has it.
WORD = r"[^\x20\x09-\x0D]+"


def two_longs(text: Column) -> list[Column]:
    """Two numbers of 60 bits from a text's SHA-256."""
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, t1, t2 (digest of role and text), words. Rows of a null conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # The role's length keeps (role, text) apart from another cut of the same signs.
    t1, t2 = two_longs(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), t1.alias("t1"), t2.alias("t2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )


def positions(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with place, from 0, in their conversation by turn (null first), role and digest; ranges of the order number their rows, and counts of ranges go before."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "t1", "t2"]
    dealt = scratch.keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("conv_id", "part").count()
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("place", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:])) - 1)
    return numbered.join(sizes, ["conv_id", "part"]).withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def shared_openings(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) as rebuilt: conversation c opens with the first crc32(c) % most turns of c - c % group, then goes on with its own.

    rows: as positions() gives them. A base's opening of at most most - 1 turns meets at most group conversations. conversations has
    every conv_id with its number of rebuilt turns, zero included.
    """
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = convs.withColumn("h", taken.cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    openings = rows.where(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "role", "t1", "t2", "words", "place")
    first = convs.join(openings, "base").where("place < h").select("conv_id", "t1", "t2", "words", "place")
    heads = convs.select("conv_id", "h")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    rest = rows.join(heads, "conv_id").where("place >= h").join(convs.select("conv_id", "head"), "conv_id")
    rest = rest.select("conv_id", "t1", "t2", "words", (F.col("place") - F.col("h") + F.col("head")).alias("place"))
    turns = F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return first.unionByName(rest), convs.select("conv_id", turns.alias("turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), k1, k2 (key of the prefix), p1, p2 (key of the prefix before), words of the last turn."""
    own = {f"o{i}": F.xxhash64(F.lit(i), "place", "t1", "t2") for i in (1, 2)}
    rows = turns.withColumns(own).withColumn("block", F.floor(F.col("place") / BLOCK))
    within = W.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"w{i}": F.expr(f"bit_xor(o{i})").over(within) for i in (1, 2)})
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = turns.withColumns(own).groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("block")).agg(*[F.expr(f"bit_xor(o{i})").alias(f"b{i}") for i in (1, 2)])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.expr(f"bit_xor(b{i})").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    rows = rows.join(blocks, ["conv_id", "block"])
    keys = [F.col(f"w{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)]
    before = [k.bitwiseXOR(F.col(f"o{i}")) for i, k in enumerate(keys, 1)]
    # The root's key is (0, 0), which no turn is left with.
    return rows.select("conv_id", (F.col("place") + 1).alias("depth"), *[k.alias(f"k{i}") for i, k in enumerate(keys, 1)], *[p.alias(f"p{i}") for i, p in enumerate(before, 1)], "words")


def roll_up(nodes: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """k1, k2 and the sums of the node's whole subtree; nodes: k1, k2, depth, p1, p2 (null at the root) and each node's own values."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = scratch.keep(nodes.select(*KEY, "depth", F.col("p1").alias("j1"), F.col("p2").alias("j2"), *sums)), 1
    while step <= deepest:
        sent = now.where(F.col("depth") >= step).groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        grown = now.join(sent, list(KEY), "left").select(*KEY, "depth", "j1", "j2", *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums])
        if step * 2 <= deepest:
            far = grown.where(F.col("depth") > 2 * step)
            jumps = now.where(F.col("depth") > step).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("f1"), F.col("j2").alias("f2"))
            far = far.join(jumps, ["j1", "j2"]).select(*KEY, "depth", F.col("f1").alias("j1"), F.col("f2").alias("j2"), *sums)
            # At twice the step the root is known without a join, and nothing is above it.
            root = F.when(F.col("depth") == 2 * step, F.lit(0).cast("long"))
            near = grown.where(F.col("depth") <= 2 * step).select(*KEY, "depth", root.alias("j1"), root.alias("j2"), *sums)
            grown = far.unionByName(near)
        grown = scratch.keep(grown)
        scratch.drop(now)
        now, step = grown, step * 2
    return now.select(*KEY, *sums)


def id_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the node's decimal ids in numerical order; ends: k1, k2, conv_id.

    Ranges of ids join a node's ids to pieces of text first; a task then streams the pieces of its nodes in order through the hash,
    so a node with very many ids costs a few long pieces and no memory.
    """
    dealt = ends.repartitionByRange("conv_id").withColumn("part", F.spark_partition_id())
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = dealt.groupBy(*KEY, "part").agg(F.array_join(ids, ",").alias("piece"))
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *own, piece in zip(*[batch.column(c).to_pylist() for c in (*KEY, "piece")]):
                if own != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*KEY, "ends_sha256"])
                out = []
        if key:
            out.append((*key, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*KEY, "ends_sha256"])

    return pieces.select(*KEY, "piece").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a node, the root (depth 0) first among them: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, place, t1, t2, words. conversations: conv_id, turns (their number), for those without turns. No conversations, no nodes.
    """
    rows = scratch.keep(prefixes(turns))
    members = rows.groupBy("depth", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    nothing = F.lit(None).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", "n_convs", nothing.alias("p1"), nothing.alias("p2"), F.lit(0).cast("long").alias("words"))
    nodes = scratch.keep(members.unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select(*KEY, "depth", "p1", "p2", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = roll_up(own, ["n_leaves", "saved_tokens"], scratch)
    # A conversation's last prefix is the node it ends at; one without turns ends at the root.
    last = rows.join(conversations, (rows["conv_id"] == conversations["conv_id"]) & (rows["depth"] == conversations["turns"])).select(rows["conv_id"], *KEY)
    turnless = conversations.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    ends = id_digests(last.unionByName(turnless))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(parents, ["p1", "p2"])
    every = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", nothing))
    out = every.join(totals, list(KEY)).join(ends, list(KEY), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with shared openings: the registered query.

    Rows are ordered by turn (null first), then role and digest of role and text; null roles and texts are empty; repeated rows are turns of
    their own; a null conv_id is none. An empty table gives no rows.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    rows = scratch.keep(positions(turn_rows(conversations), scratch))
    turns, convs = shared_openings(rows)
    return prefix_trie(scratch.keep(turns), scratch.keep(convs), scratch)


def trie_sql() -> str:
    """The query's SQL: prefixes as strings of turn digests, ancestors by cutting them."""
    # The usual reflected polynomial, bit by bit.
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"
    return f"""
WITH r AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor({crc}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM r)
), t AS (
  SELECT c.conv_id, 0 AS part, place, t, words FROM c JOIN r ON r.conv_id = c.base WHERE place < h
  UNION ALL SELECT c.conv_id, 1, place, t, words FROM c JOIN r ON r.conv_id = c.conv_id WHERE place >= h
), p AS (
  SELECT conv_id, words, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING) AS k FROM t
), m AS (
  SELECT conv_id, k, words FROM p UNION ALL SELECT conv_id, '', 0 FROM c
), n AS (
  SELECT k, length(k) // 64 AS depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MIN(words) AS words FROM m GROUP BY k
), ch AS (
  SELECT left(k, CAST(depth * 64 - 64 AS BIGINT)) AS k, COUNT(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)
), up AS (
  SELECT left(k, a * 64) AS k, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM v, unnest(range(0, depth + 1)) AS u(a)
), s AS (
  SELECT k, CAST(SUM(leaf) AS BIGINT) AS n_leaves, CAST(SUM(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY k
), e AS (
  SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(k, length(k)) AS k FROM m GROUP BY conv_id) GROUP BY k
)
SELECT v.conv_id, v.depth, parent.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN s USING (k) LEFT JOIN e USING (k) LEFT JOIN n parent ON v.depth > 0 AND parent.k = left(v.k, CAST(v.depth * 64 - 64 AS BIGINT))"""
