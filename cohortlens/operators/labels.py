"""Label sets: membership, eligibility, support, co-occurrence, reconciled targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import has_code


def label_matrix(df: DataFrame, codes: str, groups: dict[str, list[str]]) -> DataFrame:
    """Adds one 0/1 column a label: whether the pipe text has one of its codes."""
    return df.withColumns({name: has_code(F.col(codes), wanted).cast("byte") for name, wanted in groups.items()})


def one_hot(df: DataFrame, record: Sequence[str], label: str, labels: list[str]) -> DataFrame:
    """Long labels to one 0/1 column each; the list is given, so no pass finds it."""
    return df.groupBy(*record).pivot(label, labels).agg(F.lit(1)).na.fill(0)


def co_occurrence(df: DataFrame, record: Sequence[str], label: str) -> DataFrame:
    """a, b, both, a_total, b_total, jaccard for every pair of labels that meet in a record, a < b.

    Pairs form inside each record's label set, whose size the label list bounds.
    """
    sets = df.groupBy(*record).agg(F.sort_array(F.collect_set(label)).alias("s"))
    pair = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both"))
    totals = df.select(*record, label).distinct().groupBy(label).agg(F.count("*").alias("total"))
    out = both.join(totals.select(F.col(label).alias("a"), F.col("total").alias("a_total")), "a").join(
        totals.select(F.col(label).alias("b"), F.col("total").alias("b_total")), "b"
    )
    return out.withColumn("jaccard", F.col("both") / (F.col("a_total") + F.col("b_total") - F.col("both")))


def density(df: DataFrame, record: Sequence[str], label: str, focus: list[str]) -> DataFrame:
    """Mean labels a record, share of records with over one label, share with over one of focus."""
    per = df.groupBy(*record).agg(F.countDistinct(label).alias("n"), F.count_if(F.col(label).isin(focus)).alias("f"))
    return per.agg(
        F.count("*").alias("records"), F.avg("n").alias("mean_labels"), F.avg((F.col("n") > 1).cast("double")).alias("share_several"),
        F.avg((F.col("f") > 1).cast("double")).alias("share_focus_several"),
    )


def reconciled(df: DataFrame, record: Sequence[str], target: str, competing: list[str], label: str = "label", y: str = "y") -> DataFrame:
    """record, y, y_any, keep: the union target (target or a competing label) and the restricted mask (no competing label)."""
    own = F.coalesce(F.max(F.when(F.col(label) == target, F.col(y))), F.lit(0))
    other = F.coalesce(F.max(F.when(F.col(label).isin(competing), F.col(y))), F.lit(0))
    return df.groupBy(*record).agg(own.alias("y"), F.greatest(own, other).alias("y_union"), (other == 0).alias("keep"))


def eligibility(df: DataFrame, cohorts: list[str], least_pos: int, least_neg: int) -> DataFrame:
    """label, positives and negatives of each cohort, reasons (pipe text) and eligible. df: cohort, label, y."""
    wide = df.groupBy("label").pivot("cohort", cohorts).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    wide = wide.na.fill(0)
    reasons = []
    for c in cohorts:
        reasons += [F.when(F.col(f"{c}_pos") < least_pos, f"few_positives_{c}"), F.when(F.col(f"{c}_neg") < least_neg, f"few_negatives_{c}")]
    return wide.withColumn("reasons", F.concat_ws("|", *reasons)).withColumn("eligible", F.col("reasons") == "")


def common_labels(df: DataFrame, factor: str, levels: list[str], least: int) -> DataFrame:
    """cohort, label whose every level of the factor has at least so many positives and negatives."""
    ok = df.where(F.col(factor).isin(levels)).groupBy("cohort", "label", factor).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ok = ok.where((F.col("pos") >= least) & (F.col("neg") >= least))
    return ok.groupBy("cohort", "label").agg(F.countDistinct(factor).alias("n")).where(F.col("n") == len(levels)).select("cohort", "label")


def set_digest(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Order-free digest of a label set."""
    text = F.concat_ws(";", F.array_sort(F.collect_set(label)))
    return df.groupBy(*keys).agg(F.substring(F.sha2(text, 256), 1, 16).alias("digest"))


def summary(df: DataFrame, keys: Sequence[str], record: str, cluster: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"), F.countDistinct(record).alias("records"),
        F.countDistinct(cluster).alias("clusters"),
    )


def in_several(df: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that cross parts, such as a patient in several folds."""
    return df.groupBy(key).agg(F.countDistinct(part).alias("parts")).where("parts > 1")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def cohort_records(internal: str, fold: int) -> Column:
    """The internal cohort's held-out fold and all of the others."""
    return F.when(F.col("cohort") == internal, F.col("fold") == fold).otherwise(True)


def flat_runs(nested: DataFrame) -> DataFrame:
    """(model, digests by seed): run and digest, a row a run."""
    return nested.select("model", F.explode("digests").alias("seed", "digest")).select(F.concat_ws("-seed-", "model", "seed").alias("run"), "digest")


def failure_rates(df: DataFrame, keys: Sequence[str], failed: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(failed).alias("failed"), F.avg(F.col(failed).cast("double")).alias("rate"))


def rate_check(df: DataFrame, keys: Sequence[str], value: str, defining: Callable[[Column], Column]) -> DataFrame:
    """keys, used, defining_share, median over values that are neither null nor NaN."""
    from .discrimination import quantiles

    v = F.when(~F.isnan(value), F.col(value))
    shares = df.groupBy(*keys).agg(F.count(v).alias("used"), F.avg(F.when(v.isNotNull(), defining(v).cast("double"))).alias("defining_share"))
    return shares.join(quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("median")), list(keys), "left")


def without_codes(df: DataFrame, codes: str, excluded: list[str]) -> DataFrame:
    """Rows whose pipe text has none of the excluded codes as a whole code; a code that only contains one stays."""
    return df.where(~has_code(F.col(codes), excluded))


def expansion(df: DataFrame, values: dict[str, list[str]], y: str = "y") -> DataFrame:
    """Every combination of the given values with its rows, positives and negatives, zero where there are none."""
    counts = df.groupBy(*values).agg(F.count("*").alias("rows"), F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    cells = df.sparkSession.range(1).select()
    for name, own in values.items():
        cells = cells.select("*", F.explode(F.array(*map(F.lit, own))).alias(name))
    return cells.join(counts, list(values), "left").na.fill(0, ["rows", "pos", "neg"])


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """keys, values: each value once, in the order of its first row. Rows are summed to first places before they meet."""
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("at"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", value))), lambda s: s[value])
    return first.groupBy(*keys).agg(listed.alias("values"))


def label_map(df: DataFrame, keys: Sequence[str], label: str, value: Column) -> DataFrame:
    """keys, by_label: a map from label to value, labels in order."""
    own = df.groupBy(*keys, label).agg(value.alias("value"))
    return own.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "value")))).alias("by_label"))


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in a given order, from 1; what it lacks comes after all of it."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")
