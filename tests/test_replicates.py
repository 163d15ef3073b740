"""Replicates: weights stay off the driver, are made once a cluster, and meet sums, not copies of rows."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B


def scored(spark, n=400, scores=4):
    rows = [("AB"[i % 2], i % 30, float(i % scores + 1) / (scores + 1), int(i * 7 % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "cohort string, cluster_id long, p double, y int")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_broadcast(spark):
    clusters = scored(spark).select("cohort", "cluster_id")
    for weights in (B.multinomial_weights(clusters, "cohort", 20, 5, every=10), B.spread_registered_weights(clusters, "cohort", 20, 5, every=10)):
        own = plan(weights).split("== Initial Plan ==")[0]
        assert not any("BroadcastHashJoin [cohort" in line and "place" in line for line in own.splitlines())


def test_contrasts_read_their_rows_once(spark):
    df = spark.createDataFrame([("F", 0, 0.5), ("O", 0, 0.25), ("P", 0, None), ("O", 1, 0.5)], "cohort string, replicate int, v double").repartition(2)
    change = B.contrast(df, ["replicate"], "cohort", "F", "O", "v")
    assert plan(change).split("== Initial Plan ==")[0].count("Scan ExistingRDD") == 1
    assert [(r["replicate"], r["change"]) for r in change.collect()] == [(0, 0.25)]
    shifts = B.against(df, ["replicate"], "cohort", "F", "v")
    assert "Join" not in plan(shifts)
    assert sorted((r["cohort"], r["change"]) for r in shifts.collect()) == [("O", -0.25), ("P", None)]


def test_rows_of_a_common_score_are_summed_before_they_move(spark):
    df = scored(spark, 4000).repartition(2)
    out = B.score_sums(df, ["cohort"], 5, "cluster_id", None, None)
    rows = out.where("pos_w is not null").toPandas()
    assert out.count() < 200
    pdf = df.toPandas()
    w = B.hash_weights(pdf["cluster_id"].to_numpy(), 5)
    total = sum(B.unpacked(bytes(r), 5).astype(float) for r in rows["pos_w"])
    assert total.tolist() == (w * pdf["y"].to_numpy()[:, None]).sum(axis=0).tolist()


def test_rungs_copy_no_rows(spark):
    df = scored(spark).withColumn("label", F.lit("a"))
    rungs = spark.createDataFrame([(c, "a", r, s, 0.0) for c in "AB" for r, s in (("none", None), ("half", 0.5))], "cohort string, label string, rung string, slope double, offset double")
    out = B.rung_replicates(df, rungs, ["none", "half"], ["cohort", "label"], 3)
    assert plan(out).split("== Initial Plan ==")[0].count("Generate") == 1


def test_sums_of_fractional_labels_and_wide_weights():
    values, slot = np.array([[0.25, 1.0], [0.75, 0.0]]), np.array([0, 1])
    matrix = np.array([[300, 1], [2, 3]], np.int64)
    assert B.row_sums(values, matrix, slot).tolist() == (values @ matrix).tolist()
    for v in ([0, 255], [0, 300], [1, 70_000], [0.5, 2], [-1, 2], [1, 2**40]):
        assert B.unpacked(B.packed(np.array(v, float)), 2).tolist() == v


def test_registered_draws_meet_rows_by_spans(spark, monkeypatch):
    """Blocks of several spans and batches, and sums that are passed on early, give the single stream's replicates; no row of a cluster has weights."""
    for name, value in (("SPAN", 4), ("BLOCKS", 60), ("SUMS", 1 << 9), ("WAITING", 50)):
        monkeypatch.setattr(B, name, value)
    df = scored(spark, 900, 40).withColumns({"label": F.when(F.col("p") > 0.3, "l").otherwise("m"), "y": F.when(F.col("p") < 0.9, F.col("y")).otherwise(0.25)})
    clusters = df.select("cohort", "cluster_id").distinct()
    placed = B.cluster_places(clusters, "cohort", "cluster_id")
    out = B.registered_auroc(df.join(placed, ["cohort", "cluster_id"]), ["cohort", "label"], placed.groupBy("cohort").agg(F.count("*").alias("n")), 17, 9)
    one = B.replicate_auroc(df, ["cohort", "label"], 17, weights=B.registered_weights(clusters, "cohort", 17, 9))
    key = lambda t: sorted((r["cohort"], r["label"], r["replicate"], round(r["auroc"], 9)) for r in t.collect())
    assert key(out) == key(one) and len(key(out)) == 2 * 2 * 17
    assert "array<tinyint>" not in plan(out)
