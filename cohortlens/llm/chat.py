"""Chat formatting from event logs: fold streamed deltas, edits and regenerations into messages, then render and mask them.

A log has a row an event: conv_id, seq (its order), kind, message (an id within the conversation), role, text. Kinds:

* message: opens a message with its role and first text; of several with one id the first counts as the opening;
* delta: adds text at the message's end;
* edit: replaces the message's text, deltas after it add to the new one;
* regenerate: empties the message's text (text, if any, is the new start), and takes away the messages opened between the opening of
  this one and the event, as they answered what is gone; it does so whether or not its message still stands.

Everything is window, array and string functions; no Python runs on rows. A log is dealt by conversation once, and every window and
group after that keeps to this dealing. Sequence ties are ordered by kind, message, role and text. An event that comes twice (equal
in all fields) counts once. Events of a null kind or an unknown one, of messages that were never opened, or before their opening, are
passed over. A null conv_id is a conversation of its own; null roles and texts are empty. An empty log gives no rows. A conversation
must fit one row, since its rendering is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The control strings of the template.
TURN, END, USER, USER_END, ROLE, ROLE_END = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"
CONTROLS = (TURN, END, USER, USER_END, ROLE, ROLE_END)
#: Characters of an assistant's streamed delta in log_of().
DELTA = 256
SPAN = "array<struct<turn:int,start:long,skip:int,length:int>>"


def log_of(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log of a table conv_id, turn, role, text: rows by turn (null first), then role and text; assistants stream their text.

    Every row is a message of its own, repeated rows too.
    """
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("message", (F.row_number().over(order) - 1).cast("long"))
    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    parts = F.when(F.col("role") == "assistant", F.concat(F.array(F.lit("")), cuts)).otherwise(F.array("text"))
    rows = rows.select("conv_id", "message", "role", F.posexplode(parts).alias("place", "text"))
    kind = F.when(F.col("place") == 0, "message").otherwise("delta")
    return rows.select("conv_id", (F.shiftleft("message", 32) + F.col("place")).alias("seq"), kind.alias("kind"), "message", "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the messages that stand when the log ends, in the order of their opening."""
    fields = ["seq", "kind", "message", "role", "text"]
    log = log.select("conv_id", *fields).where(F.col("kind").isin("message", "delta", "edit", "regenerate") & F.col("message").isNotNull())
    conv, own = W.partitionBy("conv_id"), W.partitionBy("conv_id", "message")
    in_order = [F.col(f).asc_nulls_first() for f in fields]
    before = F.lag(F.struct(*fields)).over(conv.orderBy(*in_order))
    log = log.withColumn("twice", F.coalesce(before.eqNullSafe(F.struct(*fields)), F.lit(False))).where("not twice").drop("twice")
    log = log.withColumn("at", F.row_number().over(conv.orderBy(*in_order)))
    log = log.withColumn("opened", F.min(F.when(F.col("kind") == "message", F.col("at"))).over(own)).where("at >= opened")
    resets = (F.col("kind").isin("edit", "regenerate")) | (F.col("at") == F.col("opened"))
    log = log.withColumn("from", F.max(F.when(resets, F.col("at"))).over(own))
    later = conv.orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    # The earliest message that a later regeneration goes back to.
    log = log.withColumn("back_to", F.min(F.when(F.col("kind") == "regenerate", F.col("opened"))).over(later))
    # A further opening of the same id adds nothing.
    counts = (F.col("at") >= F.col("from")) & ((F.col("kind") != "message") | (F.col("at") == F.col("opened")))
    part = F.when(counts, F.struct("at", F.coalesce("text", F.lit("")).alias("text")))
    opening = F.col("at") == F.col("opened")
    messages = log.groupBy("conv_id", "message").agg(
        F.min("opened").alias("opened"), F.max(F.when(opening, F.coalesce("role", F.lit("")))).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "").alias("text"),
        F.min(F.when(opening, F.col("back_to"))).alias("back_to"),
    )
    messages = messages.where("back_to is null or back_to >= opened")
    place = (F.row_number().over(conv.orderBy("opened")) - 1).cast("int")
    return messages.select("conv_id", place.alias("place"), "role", "text")


def escape(text: Column) -> Column:
    """No control string stands in what comes out, and unescape() gives the text back: a backslash goes in after a control string's first sign."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted and loss, from fold()'s messages.

    A turn is <s>[INST] text [/INST] for users, <s>text</s> for assistants, <s>[ROLE] role [/ROLE] text</s> for others. loss is the mask:
    a span an assistant's turn, with its start and length in formatted, in code points, and the same place in its own turn (skip, without the <s>).
    """
    lit, body = F.lit, escape(F.col("text"))
    head = F.when(F.col("role") == "user", lit(f"{USER} ")).when(F.col("role") == "assistant", lit("")).otherwise(F.concat(lit(f"{ROLE} "), escape(F.col("role")), lit(f" {ROLE_END} ")))
    tail = F.when(F.col("role") == "user", lit(f" {USER_END}")).otherwise(lit(END))
    rows = messages.select("conv_id", "place", "role", head.alias("head"), body.alias("body"), tail.alias("tail"))
    rows = rows.withColumn("piece", F.concat(lit(TURN), "head", "body", "tail"))
    earlier = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(earlier), lit(0)))
    skip = F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(
        F.col("place").alias("turn"), (F.col("start") + len(TURN) + skip).cast("long").alias("start"), skip.alias("skip"), F.length("body").alias("length")
    ))
    turns = F.sort_array(F.collect_list(F.struct("place", "piece", span.alias("span"))))
    rows = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), turns.alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).cast(SPAN)
    return rows.select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss"))


def turn_of(piece: Column) -> Column:
    """struct(role, text) of a turn without its <s>."""
    cut = lambda start, less: F.substring(piece, F.lit(start + 1), F.length(piece) - less)
    user = F.struct(F.lit("user").alias("role"), unescape(cut(len(USER) + 1, len(USER) + len(USER_END) + 2)).alias("text"))
    assistant = F.struct(F.lit("assistant").alias("role"), unescape(cut(0, len(END))).alias("text"))
    begin = len(ROLE) + 1
    role_ends = F.call_function("instr", piece, F.lit(f" {ROLE_END} "))
    text_at = role_ends + len(ROLE_END) + 2
    other = F.struct(
        unescape(F.substring(piece, F.lit(begin + 1), role_ends - begin - 1)).alias("role"),
        unescape(F.substring(piece, text_at, F.length(piece) - text_at + 1 - len(END))).alias("text"),
    )
    return F.when(F.startswith(piece, F.lit(f"{USER} ")), user).when(F.startswith(piece, F.lit(f"{ROLE} ")), other).otherwise(assistant)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (role, text), loss_text (all text under the mask, unescaped), formatted_chars, told from formatted and loss alone."""
    pieces = F.slice(F.split("formatted", TURN), 2, F.length("formatted"))
    rows = formatted.select("conv_id", "loss", F.length("formatted").cast("long").alias("formatted_chars"), pieces.alias("pieces"))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.get("pieces", s["turn"]), s["skip"] + 1, s["length"])))
    return rows.select(
        "conv_id", F.size("pieces").cast("long").alias("n_turns"), F.transform("pieces", turn_of).alias("turns"),
        F.array_join(masked, "").alias("loss_text"), "formatted_chars",
    )


def digests(read: DataFrame) -> DataFrame:
    """What the query returns of read_back()."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", "n_turns", F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are made of control strings."""
    odd = f"{END}{USER} ok {USER_END}"
    probe = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return conversations.select(*columns).union(probe)


def format_sql() -> str:
    """The query's SQL: digests of the turns as they stand, and the length that the template gives them."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    marks = lambda c: f"length({c}) - length(replace({c}, chr(92), '')) + " + " + ".join(f"(length({c}) - length(replace({c}, {q(x)}, ''))) // {len(x)}" for x in CONTROLS)
    odd = q(f"{END}{USER} ok {USER_END}")
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {odd} UNION ALL SELECT -7, 1, 'assistant', {odd}
), s AS (
  SELECT *, length(text) + {marks("text")} + {len(TURN)} + CASE role WHEN 'user' THEN {len(USER) + len(USER_END) + 2} WHEN 'assistant' THEN {len(END)}
    ELSE length(role) + {marks("role")} + {len(ROLE) + len(ROLE_END) + len(END) + 3} END AS chars FROM r
), t AS (
  SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(SUM(chars) AS BIGINT) AS formatted_chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t"""
