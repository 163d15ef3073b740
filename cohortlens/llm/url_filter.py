"""URL verdicts: rules first, then the ratio of two character language models.

A rule (host, path) fits its host and all subdomains when the url's path starts with its path; the
longest fitting rule decides. For the rest, two variable-order Markov models over the characters of
host and path, up to ORDER - 1 characters of context with Witten-Bell smoothing, are counted from
the urls that a rule allows and from those that a rule blocks. A url's score is the mean difference of log-likelihoods
a character, with the longest context that the models know at each place. The threshold is the one that splits the
labelled urls held out of the counts best (every fifth by CRC-32). A url counts as often as it has rows.

The models' tables hold all grams. Tables of up to MOST grams, as counted, are broadcast; larger ones are joined with
the distinct grams of the urls, and of those values only the MOST most frequent are broadcast. Sums are of whole parts of
1 / SCALE nats, so both ways give equal scores.

Nulls and ties: a null url, or one without "://", has an empty host and path and is judged by the
models' end symbol alone; repeated rows are judged alike; a score equal to the threshold is allowed;
without labelled urls of both kinds every unruled url is allowed; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

ORDER = 4
#: Grams that are broadcast at most.
MOST = 100_000
SCALE = 1 << 30
#: Every so many labelled urls are held out to set the threshold.
HOLD = 5

#: Verdict, host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(rules, host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_grams(df: DataFrame, order: int) -> DataFrame:
    """df's columns but its text, once a place of the text: full, that character with the ones before it, order in all. Linear in the text."""
    chars = df.withColumn("chars", F.split(padded(F.col("text"), order), ""))
    # The array stands in a column of its own, so it is made once a text; each place reads its few characters.
    gram = F.transform(F.sequence(F.lit(order), F.size("chars")), lambda i: F.concat(*[F.get("chars", i - k) for k in range(order, 0, -1)]))
    return chars.select(*[c for c in df.columns if c != "text"], F.explode(gram).alias("full"))


def padded(text: Column, order: int) -> Column:
    return F.concat(F.lit("\u0002" * (order - 1)), text, F.lit("\u0003"))


def beside(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def weight(labelled: DataFrame, which: Column) -> Column:
    """The rows of a kind: a row stands for count rows, where there is that column."""
    rows = F.col("count") if "count" in labelled.columns else F.lit(1)
    return F.sum(F.when(which, rows).otherwise(0))


def models(labelled: DataFrame, order: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """labelled (text, good, perhaps count): grams (gram, ratio) and contexts (context, back), ratios of log probabilities."""
    rows = with_grams(labelled, order)
    counts = rows.groupBy("full").agg(
        weight(labelled, F.col("good")).alias("yes"), weight(labelled, ~F.col("good")).alias("no")
    )
    counts = counts.select(F.explode(F.array(*[F.expr(f"right(full, {k})") for k in range(1, order + 1)])).alias("gram"), "yes", "no")
    counts = counts.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counts = scratch.keep(counts.withColumn("context", F.expr("left(gram, length(gram) - 1)")))
    contexts = scratch.keep(
        counts.groupBy("context").agg(
            F.sum("yes").alias("all_yes"), F.count_if(F.col("yes") > 0).alias("kinds_yes"),
            F.sum("no").alias("all_no"), F.count_if(F.col("no") > 0).alias("kinds_no"),
        )
    )
    kinds = max(counts.where("length(gram) = 1").count(), 1)
    small = counts.count() <= most
    below = None
    levels = []
    for k in range(1, order + 1):
        level = counts.where(F.length("gram") == k).join(beside(contexts, small), "context")
        if below is None:
            level = level.withColumns({"low_yes": F.lit(1.0 / kinds), "low_no": F.lit(1.0 / kinds)})
        else:
            level = level.withColumn("suffix", F.expr("substring(gram, 2)")).join(
                beside(below.select(F.col("gram").alias("suffix"), F.col("p_yes").alias("low_yes"), F.col("p_no").alias("low_no")), small), "suffix"
            )
        p = {
            f"p_{c}": F.when(
                F.col(f"all_{c}") > 0,
                (F.col(c) + F.col(f"kinds_{c}") * F.col(f"low_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}")),
            ).otherwise(F.col(f"low_{c}"))
            for c in ("yes", "no")
        }
        below = scratch.keep(level.withColumns(p).select("gram", "p_yes", "p_no"))
        levels.append(below)
    table = levels[0]
    for level in levels[1:]:
        table = table.union(level)
    share = {c: F.when(F.col(f"all_{c}") > 0, F.col(f"kinds_{c}") / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(1.0) for c in ("yes", "no")}
    return (
        scratch.keep(table.select("gram", F.log(F.col("p_yes") / F.col("p_no")).alias("ratio"))),
        scratch.keep(contexts.select("context", F.log(share["yes"] / share["no"]).alias("back"))),
    )


def scores(texts: DataFrame, model: DataFrame, contexts: DataFrame, order: int, most: int = MOST) -> DataFrame:
    """texts (text, distinct): (text, score)."""
    # Grams carry a digest, not the whole text.
    keyed = texts.select("text", F.md5(F.encode("text", "UTF-8")).alias("key"))
    rows = with_grams(keyed, order)
    if model.count() > most:
        rows = with_values(rows, model, contexts, order, most)
        value = F.col("value")
    else:
        value = F.lit(0.0)
        for k in range(1, order + 1):
            rows = rows.withColumn("g", F.expr(f"right(full, {k})")).withColumn("c", F.expr(f"left(g, {k - 1})"))
            rows = rows.join(F.broadcast(model.select(F.col("gram").alias("g"), F.col("ratio").alias(f"r{k}"))), "g", "left")
            rows = rows.join(F.broadcast(contexts.select(F.col("context").alias("c"), F.col("back").alias(f"b{k}"))), "c", "left").drop("g", "c")
            value = F.coalesce(F.col(f"r{k}"), F.coalesce(F.col(f"b{k}"), F.lit(0.0)) + value)
    found = rows.groupBy("key").agg((F.sum(F.round(value * SCALE).cast("long")) / SCALE / F.count("*")).alias("score"))
    return keyed.join(found, "key").select("text", "score")


def with_values(rows: DataFrame, model: DataFrame, contexts: DataFrame, order: int, most: int) -> DataFrame:
    """rows (key, full): with value. Every distinct gram, and every distinct end of one, is looked up once."""
    scratch = Scratch(rows.sparkSession, "url-values")
    asked = {order: scratch.keep(rows.groupBy(F.col("full").alias("gram")).agg(F.count("*").alias("n")))}
    for k in range(order - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.expr("substring(gram, 2)").alias("gram")).distinct()
    below = None
    for k in range(1, order + 1):
        level = asked[k].join(model.where(F.length("gram") == k), "gram", "left")
        if below is None:
            # One context only.
            empty = contexts.where("context = ''").first()
            low = F.lit(0.0 if empty is None else empty["back"])
        else:
            level = level.withColumn("context", F.expr(f"left(gram, {k - 1})")).withColumn("suffix", F.expr("substring(gram, 2)"))
            level = level.join(contexts, "context", "left")
            level = level.join(below.select(F.col("gram").alias("suffix"), F.col("value").alias("low")), "suffix")
            low = F.coalesce("back", F.lit(0.0)) + F.col("low")
        below = level.select("gram", *(["n"] if k == order else []), F.coalesce("ratio", low).alias("value"))
    values = scratch.keep(below)
    # A gram of nearly every url is among those broadcast, so no task gets all its rows.
    common = scratch.keep(values.orderBy(F.desc("n"), "gram").limit(most).select(F.col("gram").alias("full"), "value"))
    rare = values.join(F.broadcast(common.select(F.col("full").alias("gram"))), "gram", "left_anti").select(F.col("gram").alias("full"), "value")
    near = rows.join(F.broadcast(common), "full")
    far = rows.join(F.broadcast(common.select("full")), "full", "left_anti").join(rare, "full")
    return near.unionByName(far)


def best_threshold(held: DataFrame) -> float:
    """held (good, score, perhaps count): the hundredth that parts good from bad best; of equals, the one nearest to 0."""
    bins = held.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        weight(held, F.col("good")).alias("yes"), weight(held, ~F.col("good")).alias("no")
    )
    upward = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # Bins: scores are bounded by the logarithm of the smallest probability, so a few thousand.
    rated = bins.select(
        "bin",
        (
            F.coalesce(F.sum("no").over(upward), F.lit(0)) / F.greatest(F.sum("no").over(everything), F.lit(1))
            - F.coalesce(F.sum("yes").over(upward), F.lit(0)) / F.greatest(F.sum("yes").over(everything), F.lit(1))
        ).alias("gain"),
    )
    top = rated.orderBy(F.desc("gain"), F.abs("bin"), "bin").first()
    return 0.0 if top is None else top["bin"] / 100.0


def judge_urls(
    pages: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = ORDER,
    most: int = MOST,
) -> DataFrame:
    """Every row's host, path, deciding rule (or null), verdict and, where the models decided, score."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = scratch.keep(rows.withColumn("found", longest_rule(rules, F.col("host"), F.col("path"))))
    text = F.concat("host", "path").alias("text")
    labelled = scratch.keep(
        rows.where("found is not null").select(text, (F.col("found.verdict") == "allow").alias("good")).groupBy("text", "good").count()
    )
    held = F.pmod(F.crc32(F.encode("text", "UTF-8")), F.lit(HOLD)) == 0
    model, contexts = models(labelled.where(~held), order, most, scratch)
    threshold = best_threshold(
        scores(labelled.where(held).select("text").distinct(), model, contexts, order, most).join(labelled.where(held), "text")
    )
    unruled = rows.where("found is null").withColumn("text", F.concat("host", "path"))
    judged = unruled.join(scores(unruled.select("text").distinct(), model, contexts, order, most), "text", "left").drop("text")
    # Ruled rows need no score; joined by a null text they would all meet in one task.
    judged = judged.unionByName(rows.where("found is not null"), allowMissingColumns=True)
    return judged.select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(
            F.col("found.verdict"), F.when(F.coalesce("score", F.lit(threshold)) >= threshold, "allow").otherwise("block")
        ).alias("verdict"),
        "score",
    )
