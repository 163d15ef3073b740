"""Provenance as tables: ancestry of commits, guards before an evaluation, and the chain receipt - run - checkpoint - inputs.

Guards don't stop at the first fault: each returns every broken rule, so one pass over the tables tells all of them; settled()
turns what a guard returns into a failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expect import Unmet
from .lineage import cut


def reach(parents: DataFrame, starts: DataFrame, most_rounds: int = 64) -> DataFrame:
    """start, node: every start with itself and all its ancestors. parents: child, parent; starts: start.

    Jumps double: after round k the table of jumps leads 2**k generations up, and a start knows all ancestors less than 2**k away, so
    rounds are the logarithm of the longest history. Unknown starts reach themselves alone; repeated edges, null ends and loops of one
    commit are passed over.
    """
    jumps = parents.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    known = cut(starts.where("start is not null").select("start", F.col("start").alias("node")).distinct())
    count = known.count()
    for _ in range(most_rounds):
        jumps = cut(jumps)
        further = known.join(jumps.withColumnRenamed("child", "node"), "node").select("start", F.col("parent").alias("node"))
        known = cut(known.unionByName(further).distinct())
        grown = known.count()
        if grown == count:
            return known
        count = grown
        far = jumps.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        jumps = jumps.join(far, "parent").select("child", F.col("far").alias("parent")).distinct()
    raise Unmet("the history is longer than the rounds allow")


def ancestry(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """pairs (ancestor, descendant) with holds: whether the first is an ancestor of the second, or the same commit."""
    up = reach(parents, pairs.select(F.col("descendant").alias("start"))).select(F.col("start").alias("descendant"), F.col("node").alias("ancestor"), F.lit(True).alias("holds"))
    return pairs.join(up, ["ancestor", "descendant"], "left").withColumn("holds", F.coalesce("holds", F.lit(False)))


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def settled(report: DataFrame, what: str) -> None:
    """Fails with the first broken rows of a report that has a column broken (names of rules)."""
    if found := report.where(F.size("broken") > 0).limit(5).collect():
        raise Unmet(f"{what}: {[r.asDict() for r in found]}")


def registration_guard(seals: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """path and broken: a registered file, its seal and the committed blob have one digest. seals, files, blobs: path, digest."""
    rows = seals.select("path", F.col("digest").alias("sealed")).join(files.select("path", F.col("digest").alias("found")), "path", "left")
    rows = rows.join(blobs.select("path", F.col("digest").alias("committed")), "path", "left")
    rules = {
        "file_there": F.col("found").isNotNull(), "blob_there": F.col("committed").isNotNull(), "file_as_sealed": F.col("found") == F.col("sealed"),
        "blob_as_sealed": F.col("committed") == F.col("sealed"), "file_as_committed": F.col("found") == F.col("committed"),
    }
    return rows.select("path", broken(rules).alias("broken"))


def evaluation_guard(seals: DataFrame, blobs: DataFrame, parents: DataFrame) -> DataFrame:
    """seal_id and the broken rules of each seal, before anything protected is scored.

    seals: seal_id, study, registration_study, registration, choices_registration, choices (commits), path, sealed_digest, worktree_digest and
    completed (whether the evaluation ran). blobs: commit, path, digest of what commits hold. parents: child, parent.
    """
    commits = parents.select(F.col("child").alias("id")).union(parents.select("parent")).union(blobs.select("commit")).where("id is not null").distinct()
    there = lambda c: commits.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_known"))
    rows = seals.join(there("choices"), "choices", "left").join(there("registration"), "registration", "left")
    rows = rows.join(blobs.select(F.col("commit").alias("choices"), "path", F.col("digest").alias("committed")), ["choices", "path"], "left")
    pairs = seals.select(F.col("registration").alias("ancestor"), F.col("choices").alias("descendant")).distinct()
    line = ancestry(pairs, parents).select(F.col("ancestor").alias("registration"), F.col("descendant").alias("choices"), "holds")
    rows = rows.join(line, ["registration", "choices"], "left")
    rules = {
        "registration_known": F.col("registration_known"), "choices_known": F.col("choices_known"), "worktree_as_sealed": F.col("worktree_digest") == F.col("sealed_digest"),
        "commit_as_sealed": F.col("committed") == F.col("sealed_digest"), "descends_from_registration": F.col("holds"),
        "names_registration": F.col("choices_registration") == F.col("registration"), "names_study": F.col("study") == F.col("registration_study"), "not_yet_run": ~F.col("completed"),
    }
    return rows.select("seal_id", broken(rules).alias("broken"))


def run_rules(epochs: int) -> dict[str, Column]:
    """Of a run's manifest: complete, all its epochs, nothing protected touched, not a limited development run."""
    return {
        "run_there": F.col("run_status").isNotNull(), "run_complete": F.col("run_status") == "complete", "all_epochs": F.col("completed_epochs") == epochs,
        "nothing_protected": ~F.col("protected_accessed"), "not_limited": F.col("limited").isNotNull() & ~F.col("limited"),
    }


def checkpoint_rules() -> dict[str, Column]:
    """Of a checkpoint: the sealed one, of the run's model and seed, and of the epoch that the run chose (its own count is from 0)."""
    return {
        "checkpoint_there": F.col("checkpoint_epoch").isNotNull(), "checkpoint_model": F.col("checkpoint_model") == F.col("model"),
        "checkpoint_seed": F.col("checkpoint_seed") == F.col("seed"), "checkpoint_epoch": F.col("checkpoint_epoch") + 1 == F.col("best_epoch"),
    }


def receipt_rules() -> dict[str, Column]:
    """Of a cohort's receipt: complete, of the sealed choices, over the bound records and targets, as many as found."""
    return {
        "receipt_complete": F.col("receipt_status") == "complete", "receipt_choices": F.col("receipt_choices") == F.col("sealed_choices"),
        "records_bound": F.col("receipt_records_digest") == F.col("bound_records_digest"), "targets_bound": F.col("receipt_targets_digest") == F.col("bound_targets_digest"),
        "record_count": F.col("receipt_records") == F.col("bound_records"),
    }


def provenance_chain(passes: DataFrame, runs: DataFrame, checkpoints: DataFrame, receipts: DataFrame, bound: DataFrame, epochs: int) -> DataFrame:
    """cohort, model, seed and broken: every rule that a scored pass breaks on its way from receipt to run, checkpoint and bound inputs.

    passes: cohort, model, seed, checkpoint (digest). runs: model, seed, run_status, completed_epochs, best_epoch, protected_accessed, limited. checkpoints:
    checkpoint, checkpoint_model, checkpoint_seed, checkpoint_epoch. receipts: cohort, receipt_*. bound: cohort, sealed_choices, bound_*. A
    missing link breaks the rules that need it.
    """
    rows = passes.join(runs, ["model", "seed"], "left").join(checkpoints, ["checkpoint"], "left").join(receipts, ["cohort"], "left").join(bound, ["cohort"], "left")
    return rows.select("cohort", "model", "seed", broken(run_rules(epochs) | checkpoint_rules() | receipt_rules()).alias("broken"))


def broken_counts(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rule, passes: how many rows break each rule."""
    return report.select(*keys, F.explode("broken").alias("rule")).groupBy(*keys, "rule").agg(F.count("*").alias("passes"))
