"""Runs that skip what is there: sources against a manifest, and jobs against a table of finished ones."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.expect import Unmet


def source_states(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """name, binding, expected, digest, state. manifest: name, sealed (null where none), observed. found: name, digest.

    A sealed digest binds a source, else the one observed at registration does. verified: there as expected; missing: to be fetched; failed: there
    and not what is sealed; changed: not what was observed, which is told and kept.
    """
    expected = F.coalesce("sealed", "observed")
    rows = manifest.join(found, "name", "left").withColumn("expected", expected).withColumn("binding", F.when(F.col("sealed").isNotNull(), "sealed").otherwise("observed"))
    state = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("expected"), "verified").when(F.col("binding") == "sealed", "failed").otherwise("changed")
    return rows.select("name", "binding", "expected", "digest", state.alias("state"))


def refresh(manifest: DataFrame, look: Callable[[], DataFrame], fetch: Callable[[DataFrame], None], force: bool = False) -> DataFrame:
    """Fetches what is not verified and gives the states after that; a sealed source that still differs fails. Nothing to fetch, nothing is called."""
    due = source_states(manifest, look())
    due = due if force else due.where("state <> 'verified'")
    if not due.isEmpty():
        fetch(due.select("name", "expected"))
    states = source_states(manifest, look())
    if bad := states.where("state in ('failed', 'missing') and binding = 'sealed' or state = 'missing'").limit(5).collect():
        raise Unmet(f"sources are not the registered ones: {[r.asDict() for r in bad]}")
    return states


def unfinished(wanted: DataFrame, runs: DataFrame, epochs: int) -> DataFrame:
    """wanted (model, seed) without a complete, unlimited run of all epochs. runs: model, seed, status, completed_epochs, maximum_epochs, limited."""
    whole = (F.col("status") == "complete") & (F.col("completed_epochs") == epochs) & (F.col("maximum_epochs") == epochs) & ~F.coalesce("limited", F.lit(True))
    return wanted.join(runs.where(whole).select("model", "seed").distinct(), ["model", "seed"], "left_anti")


def bound_path(root: str, given: str, declared: str) -> str:
    """The declared path below the root; another one given is refused."""
    at = lambda p: posixpath.normpath(p if "://" in p or p.startswith("/") else f"{root.rstrip('/')}/{p}")
    if at(given) != at(declared):
        raise Unmet(f"{given} is not the bound path {at(declared)}")
    return at(declared)
