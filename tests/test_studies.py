"""Feature baselines, fused resamples, provenance, cached inference, incremental runs and array stores against brute force and tampering."""

import json
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import baseline as BL
from cohortlens.operators import bootstrap as B
from cohortlens.operators import discrimination as D
from cohortlens.operators import fitting
from cohortlens.operators import inference as I
from cohortlens.operators import labels
from cohortlens.operators import provenance as P
from cohortlens.operators.expect import Unmet
from cohortlens.sources import arrays, files, incremental


def brute_auroc(p, y, w=None):
    p, y = np.asarray(p, float), np.asarray(y)
    w = np.ones(len(p)) if w is None else np.asarray(w, float)
    a, b = y == 1, y == 0
    if not (w[a].sum() and w[b].sum()):
        return None
    won = (p[a][:, None] > p[b]) + 0.5 * (p[a][:, None] == p[b])
    return float(w[a] @ won @ w[b] / (w[a].sum() * w[b].sum()))


# --- quantiles and features of any range


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in np.round(rng.normal(0, 1e4, 900), -2)] + [("b", 2.0), ("c", None), ("c", float("nan")), ("d", 0.0), ("d", -0.0), ("d", 7.0)] + [("e", 5.0)] * 500 + [("e", 6.0)]
    probs = [0.0, 0.025, 0.3, 0.5, 0.99, 1.0]
    found = {r["k"]: r for r in D.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()}
    assert set(found) == {"a", "b", "d", "e"}
    for k, r in found.items():
        own = [v for n, v in rows if n == k]
        assert r["n"] == len(own) and np.allclose(r["q"], np.quantile(own, probs))
    assert D.quantiles(spark.createDataFrame(rows, "k string, v double"), [], "v", [0.5]).first()["n"] == sum(v is not None and v == v for _, v in rows)


FEATURES = "cohort string, f double, g double, y_a int, y_b int, other boolean"


def feature_rows(seed=2, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        f = float(np.round(rng.normal(50, 20)))
        rows.append((("in", "out")[i % 2], f if i % 7 else None, float("nan") if i % 5 == 0 else -f + float(rng.integers(0, 9)), int(f > 60), int(rng.random() < 0.3), i % 11 == 0 if i % 3 else None))
    return rows


def test_validation_tells_a_feature_turned_round(spark):
    rows = feature_rows()
    df = spark.createDataFrame(rows, FEATURES)
    checks = [BL.Check("f", "a", 1), BL.Check("f", "a", -1), BL.Check("g", "b", 1)]
    found = {(r["cohort"], r["feature"], r["label"], r["sign"]): r for r in BL.feature_validation(df, ["cohort"], checks).collect()}
    for cohort in ("in", "out"):
        own = [(r[1], r[3]) for r in rows if r[0] == cohort and r[1] is not None]
        right, wrong = found[cohort, "f", "a", 1.0], found[cohort, "f", "a", -1.0]
        assert right["used"] == len(own) and right["auroc"] == pytest.approx(brute_auroc(*zip(*own)))
        assert right["auroc"] > 0.9 and wrong["auroc"] == pytest.approx(1 - right["auroc"])
    none = spark.createDataFrame([("in", None, None, 1, 0, True)], FEATURES)
    assert [(r["auroc"], r["used"]) for r in BL.feature_validation(none, ["cohort"], checks[:1]).collect()] == [(None, 0)]


def test_rate_checks_and_failures(spark):
    rows = feature_rows()
    df = spark.createDataFrame(rows, FEATURES)
    found = {(r["cohort"], r["label"]): r for r in BL.rate_checks(df, ["cohort"], [BL.RateCheck("f", "a", 1, 65.0, "above"), BL.RateCheck("f", "b", -1, 40.0, "below")], F.col("other")).collect()}
    for cohort in ("in", "out"):
        own = [r for r in rows if r[0] == cohort]
        for label, at, side, sign in (("a", 3, lambda v: v > 65, 1), ("b", 4, lambda v: v < 40, -1)):
            positives = [r[1] for r in own if r[at] == 1]
            kept = [r for r in own if r[at] == 1 or not r[5]]
            r = found[cohort, label]
            assert r["positives"] == len(positives) and r["rows_left"] == len(kept)
            assert r["defining_share"] == pytest.approx(np.mean([v is not None and side(v) for v in positives]))
            assert r["median"] == pytest.approx(np.median([v for v in positives if v is not None]))
            assert r["restricted_auroc"] == pytest.approx(brute_auroc(*zip(*[(sign * x[1], x[at]) for x in kept if x[1] is not None])))
        rates = {r["feature"]: r["rate"] for r in BL.failure_rates(df.where(F.col("cohort") == cohort), [], ["f", "g"]).collect()}
        assert rates == pytest.approx({"f": np.mean([r[1] is None for r in own]), "g": np.mean([r[2] != r[2] for r in own])})


def test_label_fits_equal_one_model_at_a_time(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = {"a": (x[:, 0] + rng.normal(size=600) > 0.3).astype(int), "b": (x @ [1, -2, 0.5] + rng.normal(size=600) > 0).astype(int), "one": np.ones(600, int)}
    rows = [(*map(float, r), int(a), int(b) if i % 9 else None, 1) for i, (r, a, b) in enumerate(zip(x, y["a"], y["b"]))]
    df = spark.createDataFrame(rows, "u double, v double, w double, y_a int, y_b int, y_one int").repartition(5)
    fits = BL.fit_labels(df, ["u", "v", "w"], ["a", "b", "one"], (0.01, 1.0))
    for (label, c), beta in fits.items():
        if label == "one":
            assert beta.tolist() == [0, 0, 0, 20]
            continue
        keep = np.array([r[3 if label == "a" else 4] is not None for r in rows])
        data, target = np.column_stack([x, np.ones(600)])[keep], y[label][keep]
        mu = 1 / (1 + np.exp(-data @ beta))
        gradient = data.T @ (mu - target) + np.append(beta[:-1] / c, 0)
        assert np.abs(gradient).max() < 1e-6
    assert np.abs(fits["b", 0.01]).max() < np.abs(fits["b", 1.0]).max()
    # Scores as expressions, and the choice: of equals the stronger penalty.
    scored = BL.long_scores(df, ["u", "v", "w"], fits, []).where("label = 'a' and c = 1.0")
    assert sorted(r["p"] for r in scored.collect()) == pytest.approx(sorted(1 / (1 + np.exp(-np.column_stack([x, np.ones(600)]) @ fits["a", 1.0]))))
    same = {(label, c): fits[label, 1.0] for label, c in fits}
    assert sorted(BL.choose(df, ["u", "v", "w"], same, (0.01, 1.0))) == [("a", 0.01), ("b", 0.01), ("one", 0.01)]


def test_uncommitted_shifts_are_refused(spark):
    own = spark.createDataFrame([("O", "a", 0.1), ("O", "b", 0.2)], "cohort string, label string, value double")
    with pytest.raises(Unmet):
        BL.compare_shifts(own, own.where("label = 'a'"), ["a", "b"], {"a": "x"})
    assert BL.compare_shifts(own, own, ["a", "b"], {"a": "x"})["class_means"].collect()[0]["labels"] == 1


# --- resamples


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(4)
    rows = [("FO"[i % 2], i % 37, ("a", "b")[i % 3 % 2], int(rng.random() < 0.4), float(rng.integers(0, 21) / 20)) for i in range(700)]
    return rows, spark.createDataFrame(rows, "cohort string, cluster_id long, label string, y int, p double")


def weights_by_hand(clusters, replicates):
    return B.hash_weights(np.array(clusters), replicates)


def test_fused_scan_equals_brute_force(spark, scores):
    rows, df = scores
    cuts = (0.0, 0.35, 0.5, 1.0)
    found = {(r["cohort"], r["label"], r["replicate"]): r for r in B.replicate_scan(df.repartition(5), ["cohort", "label"], cuts, 6).collect()}
    for cohort, label in {(r[0], r[2]) for r in rows}:
        own = [r for r in rows if (r[0], r[2]) == (cohort, label)]
        w, y, p = weights_by_hand([r[1] for r in own], 6), np.array([r[3] for r in own]), np.array([r[4] for r in own])
        for rep in range(6):
            r = found[cohort, label, rep]
            assert r["auroc"] == pytest.approx(brute_auroc(p, y, w[:, rep]))
            for i, t in enumerate(cuts):
                assert r[f"tp_{i}"] == pytest.approx(w[(p >= t) & (y == 1), rep].sum()) and r[f"fp_{i}"] == pytest.approx(w[(p >= t) & (y == 0), rep].sum())


def test_rungs_meet_their_weights_once(spark, scores):
    rows, df = scores
    maps = {"none": (None, None), "half": (0.5, 0.0), "up": (1.0, 1.2)}
    keys = sorted({(r[0], r[2]) for r in rows})
    rungs = spark.createDataFrame([(c, label, k, s, o) for c, label in keys for k, (s, o) in maps.items()], "cohort string, label string, rung string, slope double, offset double")
    found = {(r["cohort"], r["label"], r["rung"], r["replicate"]): r["ece"] for r in B.rung_replicates(df, rungs, list(maps), ["cohort", "label"], 5).collect()}
    for cohort, label in keys:
        own = [r for r in rows if (r[0], r[2]) == (cohort, label)]
        w, y, p = weights_by_hand([r[1] for r in own], 5), np.array([r[3] for r in own]), np.array([r[4] for r in own])
        for name, (s, o) in maps.items():
            q = np.clip(p, 1e-7, 1 - 1e-7)
            q = p if s is None else 1 / (1 + np.exp(-(s * np.log(q / (1 - q)) + o)))
            at = np.minimum((q * 15 + 1e-12).astype(int), 14)
            for rep in range(5):
                want = sum(abs((w[at == b, rep] * (q - y)[at == b]).sum()) for b in range(15)) / w[:, rep].sum()
                assert found[cohort, label, name, rep] == pytest.approx(want)


def test_registered_draws_in_any_task_are_the_single_stream(spark, scores):
    rows, df = scores
    clusters = df.select("cohort", "cluster_id").distinct()
    replicates, every = 23, 5
    for cohort in "FO":
        own = sorted({r[1] for r in rows if r[0] == cohort})
        stream = np.concatenate(list(B.registered_stream(len(own), replicates, 9)))
        spread = B.spread_registered_weights(clusters, "cohort", replicates, 9, every=every).where(F.col("cohort") == cohort).collect()
        made = np.full(stream.shape, -1)
        for r in spread:
            made[r["batch"] * every : r["batch"] * every + len(r["weights"]), own.index(r["cluster_id"])] = r["weights"]
        assert (made == stream).all()
    one = B.replicate_auroc(df, ["cohort", "label"], replicates, weights=B.registered_weights(clusters, "cohort", replicates, 9))
    many = B.replicate_auroc_in_batches(df, ["cohort", "label"], B.spread_registered_weights(clusters, "cohort", replicates, 9, every=every), replicates, every)
    key = lambda t: sorted((r["cohort"], r["label"], r["replicate"], round(r["auroc"], 9)) for r in t.collect())
    assert key(one) == key(many)


def test_cluster_places_are_dense_and_in_order(spark):
    rows = spark.createDataFrame([(c, i * i) for c in "ab" for i in range(300)], "cohort string, cluster_id long").repartition(7)
    assert sorted((r["cohort"], r["place"], r["cluster_id"]) for r in B.cluster_places(rows, "cohort", "cluster_id").collect()) == [(c, i, i * i) for c in "ab" for i in range(300)]


def test_ladder_rungs_are_the_ladder(spark, scores):
    rows, df = scores
    df = df.withColumns({"model": F.lit("m"), "fold": (F.col("cluster_id") % 10 + 1).cast("int")})
    rungs = fitting.ladder_rungs(df, ["model"], "F")
    assert {r["rung"] for r in rungs.select("rung").distinct().collect()} == set(fitting.RUNGS)
    assert fitting.calibration_ladder(df, ["model"], "F").count() == len(rows) * len(fitting.RUNGS)


# --- provenance


def test_reach_over_merges_and_long_chains(spark):
    edges = [(i, i - 1) for i in range(1, 70)] + [(100, 5), (100, 40), (101, 100), (7, 7), (8, None), (None, 3), (200, 201), (201, 200)] + [(9, 8)] * 3
    df = spark.createDataFrame(edges, "child long, parent long")
    pairs = [(0, 69), (69, 0), (41, 101), (40, 101), (100, 101), (5, 5), (999, 69), (69, 999), (200, 201), (201, 200)]
    found = {(r["ancestor"], r["descendant"]): r["holds"] for r in P.ancestry(spark.createDataFrame(pairs, "ancestor long, descendant long"), df).collect()}
    assert found == {(0, 69): True, (69, 0): False, (41, 101): False, (40, 101): True, (100, 101): True, (5, 5): True, (999, 69): False, (69, 999): False, (200, 201): True, (201, 200): True}


SEAL = dict(seal_id=1, study="s", registration_study="s", registration="r", choices_registration="r", choices="c", path="f", sealed_digest="d", worktree_digest="d", completed=False)


@pytest.mark.parametrize("change,rules", [
    ({}, []), ({"completed": True}, ["not_yet_run"]), ({"completed": None}, ["not_yet_run"]), ({"study": "t"}, ["names_study"]), ({"choices_registration": "q"}, ["names_registration"]),
    ({"worktree_digest": "e"}, ["worktree_as_sealed"]), ({"sealed_digest": "e", "worktree_digest": "e"}, ["commit_as_sealed"]), ({"registration": "side", "choices_registration": "side"}, ["descends_from_registration"]),
    ({"registration": "x", "choices_registration": "x"}, ["registration_known", "descends_from_registration"]), ({"choices": "x"}, ["choices_known", "commit_as_sealed", "descends_from_registration"]),
])
def test_guard_names_every_broken_rule(spark, change, rules):
    kinds = ", ".join(f"{k} {'boolean' if k == 'completed' else 'long' if k == 'seal_id' else 'string'}" for k in SEAL)
    seals = spark.createDataFrame([tuple((SEAL | change).values())], kinds)
    parents = spark.createDataFrame([("c", "m"), ("m", "r"), ("side", "r")], "child string, parent string")
    blobs = spark.createDataFrame([("c", "f", "d")], "commit string, path string, digest string")
    report = P.evaluation_guard(seals, blobs, parents)
    assert report.first()["broken"] == rules
    if rules:
        with pytest.raises(Unmet):
            P.settled(report, "guard")
    else:
        P.settled(report, "guard")


# --- inference


def make_passes(score):
    return [I.Pass("m", s, f"digest-{s}", score(s)) for s in (1, 2, 3)]


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    records = spark.createDataFrame([(i, "a", i % 2) for i in range(20)], "record_id long, label string, y int")
    called = []

    def score(s, dies=False):
        def run(df):
            called.append(s)
            if dies and s == 2:
                raise RuntimeError("executor lost")
            return df.withColumn("p", F.col("record_id") / (20.0 * s))

        return run

    root = f"file://{tmp_path}/inference"
    with pytest.raises(RuntimeError):
        I.score_cohort(spark, records, make_passes(lambda s: score(s, True)), root, "O", "choices")
    with pytest.raises(Unmet):
        I.cohort_scores(spark, make_passes(score), root, "O", "choices")
    assert called == [1, 2]
    assert I.score_cohort(spark, records, make_passes(score), root, "O", "choices") == 2
    assert called == [1, 2, 2, 3]
    assert I.score_cohort(spark, records, make_passes(score), root, "O", "choices") == 0 and len(called) == 4
    out = I.ensembles(I.cohort_scores(spark, make_passes(score), root, "O", "choices"), {"m": 2.0}).collect()
    assert len(out) == 20 and {r["seeds"] for r in out} == {3}
    for r in out:
        mean = np.mean([np.float32(r["record_id"] / (20.0 * s)) for s in (1, 2, 3)], dtype=float)
        assert r["p"] == pytest.approx(mean, abs=1e-6)
    with pytest.raises(Unmet):
        I.score_cohort(spark, records, make_passes(score), root, "O", "other choices")
    with pytest.raises(Unmet):
        I.score_cohort(spark, records, [I.Pass("m", 1, "another", score(1))], root, "O", "choices")
    # A second cohort has receipts of its own.
    assert I.score_cohort(spark, records, make_passes(score)[:1], root, "P", "choices") == 1
    path = I.Receipts(spark, root).table().where("seed = 1 and cohort = 'O'").first()["path"]
    spark.createDataFrame([(0, "a", 0, 0.5)], "record_id long, label string, y int, p float").write.mode("append").parquet(path)
    with pytest.raises(Unmet):
        I.cohort_scores(spark, make_passes(score), root, "O", "choices")


@pytest.mark.parametrize("wrong", ["p + 2", "cast(null as double)", "cast('NaN' as double)"])
def test_scores_that_are_none_are_refused(spark, tmp_path, wrong):
    records = spark.createDataFrame([(1, "a", 1)], "record_id long, label string, y int")
    bad = [I.Pass("m", 1, "d", lambda df: df.withColumn("p", F.lit(0.5)).withColumn("p", F.expr(wrong)))]
    with pytest.raises(Unmet):
        I.score_cohort(spark, records, bad, f"file://{tmp_path}/x", "O", "c")
    fewer = [I.Pass("m", 1, "d", lambda df: df.where("false").withColumn("p", F.lit(0.5)))]
    with pytest.raises(Unmet):
        I.score_cohort(spark, records, fewer, f"file://{tmp_path}/x", "O", "c")
    assert I.Receipts(spark, f"file://{tmp_path}/x").table().count() == 0


# --- incremental runs and stores


def test_a_second_run_fetches_nothing(spark):
    manifest = spark.createDataFrame([("a", "1", "1"), ("b", None, "2"), ("c", "3", "3")], "name string, sealed string, observed string")
    have, fetched = {"a": "1"}, []
    look = lambda: spark.createDataFrame(list(have.items()) or [(None, None)], "name string, digest string").where("name is not null")

    def fetch(due, wrong=None):
        for r in due.collect():
            fetched.append(r["name"])
            have[r["name"]] = wrong or r["expected"]

    states = {r["name"]: r["state"] for r in incremental.refresh(manifest, look, fetch).collect()}
    assert sorted(fetched) == ["b", "c"] and set(states.values()) == {"verified"}
    incremental.refresh(manifest, look, fetch)
    assert sorted(fetched) == ["b", "c"]
    have["b"] = "changed upstream"
    assert {r["name"]: r["state"] for r in incremental.refresh(manifest, look, lambda due: None).collect()}["b"] == "changed"
    have["c"] = "not what is sealed"
    with pytest.raises(Unmet):
        incremental.refresh(manifest, look, lambda due: None)


def test_bound_paths():
    assert incremental.bound_path("/data/", "store/../store/x", "store/x") == "/data/store/x"
    with pytest.raises(Unmet):
        incremental.bound_path("/data", "/elsewhere/x", "store/x")


def test_array_store(spark, tmp_path):
    signals = np.arange(7 * 2 * 5, dtype="<f4").reshape(7, 2, 5) / 4
    signals.tofile(tmp_path / "signals.bin")
    np.tile(np.arange(3, dtype="u1"), (7, 1)).tofile(tmp_path / "targets.bin")
    np.ones(7, "u1").tofile(tmp_path / "status.bin")
    root = f"file://{tmp_path}"
    spark.createDataFrame([(i, i % 3) for i in range(7)], "position long, fold int").write.parquet(f"{root}/metadata.parquet")
    rows = {r["position"]: r for r in arrays.read_store(spark, root, 2, 5, 3).collect()}
    assert all(r["signal"] == signals[i].tolist() and r["targets"] == [0, 1, 2] and r["fold"] == i % 3 for i, r in rows.items()) and len(rows) == 7
    with pytest.raises(Unmet):
        arrays.read_array(spark, f"{root}/signals.bin", "<f4", [2, 5], 8)
    with pytest.raises(Unmet):
        arrays.read_array(spark, f"{root}/signals.bin", "<f4", [2, 6])
    with pytest.raises(Unmet):
        arrays.read_store(spark, root, 2, 5, 4)
    (tmp_path / "status.bin").write_bytes(bytes([1, 1, 0, 1, 1, 1, 1]))
    os.remove(tmp_path / ".status.bin.crc") if os.path.exists(tmp_path / ".status.bin.crc") else None
    with pytest.raises(Unmet):
        arrays.read_store(spark, root, 2, 5, 3)


def test_a_large_array_is_read_in_ranges(spark, tmp_path):
    np.arange(200_000, dtype="<i4").tofile(tmp_path / "a.bin")
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", "100000")
    try:
        df = arrays.read_array(spark, f"file://{tmp_path}/a.bin", "<i4", [2])
        assert df.select(F.spark_partition_id()).distinct().count() > 4
        assert df.where("values[0] <> 2 * position or values[1] <> 2 * position + 1").count() == 0 and df.count() == 100_000
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")


@pytest.mark.parametrize("mean,sd", [([0.0] * 11, [1.0] * 12), ([0.0] * 12, [1.0] * 11 + [0.0]), ([0.0] * 11 + [float("inf")], [1.0] * 12)])
def test_normalization(spark, tmp_path, mean, sd):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"per_lead_mean_mv": [0.5] * 12, "per_lead_standard_deviation_mv": [2.0] * 12}))
    assert arrays.read_normalization(spark, f"file://{good}") == ([0.5] * 12, [2.0] * 12)
    bad.write_text(json.dumps({"per_lead_mean_mv": mean, "per_lead_standard_deviation_mv": sd}))
    with pytest.raises(Unmet):
        arrays.read_normalization(spark, f"file://{bad}")


def test_multinomial_draws_do_not_hang_on_batches(spark, scores):
    rows, df = scores
    clusters = df.select("cohort", "cluster_id").distinct()
    made = {}
    for every in (3, 100):
        own = defaultdict(dict)
        for r in B.multinomial_weights(clusters, "cohort", 7, 5, every=every).collect():
            for i, w in enumerate(r["weights"]):
                own[r["cohort"], r["batch"] * every + i][r["cluster_id"]] = w
        made[every] = dict(own)
    assert made[3] == made[100] and len(made[3]) == 14
    for (cohort, _), w in made[3].items():
        assert sum(w.values()) == len(w) == len({r[1] for r in rows if r[0] == cohort})


def test_hash_draws_of_far_clusters_are_no_shifts_of_each_other():
    """Clusters whose identifiers differ by what the replicates' factor undoes had one sequence, shifted."""
    far = B.hash_draws(np.array([5, 5 + 1018331]), 4000)
    assert len(np.intersect1d(far[0], far[1])) < 3
    assert (B.hash_draws(np.array([5]), 10, 30) == far[:1, 30:40]).all()


def test_places_of_whole_rows(spark):
    rows = [("k", i % 5, i) for i in range(200)] + [("l", 0, 0)]
    df = spark.createDataFrame(rows, "k string, a long, b long").repartition(6)
    found = {(r["k"], r["a"], r["b"]): r["place"] for r in B.places(df, ["k"], ["a", "b"]).collect()}
    assert found == {r: i for i, r in enumerate(sorted(r for r in rows if r[0] == "k"))} | {("l", 0, 0): 0}


def test_labels_in_shapes(spark):
    df = spark.createDataFrame([(1, "a|sign"), (2, "a|signup"), (3, None), (4, "")], "id long, codes string")
    assert [r["id"] for r in labels.without_codes(df, "codes", ["sign"]).orderBy("id").collect()] == [2, 3, 4]
    rows = spark.createDataFrame([("x", 1, 5, 0), ("y", 1, 1, 1), ("x", 1, 0, 0), ("z", 1, 9, 1)], "v string, k int, t int, y int")
    assert labels.ordered_distinct(rows, ["k"], "v", ["t"]).first()["values"] == ["x", "y", "z"]
    cells = {(r["v"], r["k"]): (r["rows"], r["pos"]) for r in labels.expansion(rows, {"v": ["x", "q"], "k": [1, 2]}).collect()}
    assert cells == {("x", 1): (2, 0), ("x", 2): (0, 0), ("q", 1): (0, 0), ("q", 2): (0, 0)}


def test_curve_points_must_be_there(spark):
    curve = spark.createDataFrame([("a", 0.1 + 0.2, 1), ("a", 0.5, 2), ("b", 0.3, 3)], "k string, at double, v int")
    assert D.at_points(curve, ["k"], "at", [0.3]).count() == 2
    with pytest.raises(Unmet):
        D.at_points(curve, ["k"], "at", [0.5]).count()


def test_csv_floats_come_back_as_they_were(spark, tmp_path):
    values = [0.1, 1 / 3, 1e-310, 1.7976931348623157e308, -0.0, 123456789.123456789]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    files.write_sorted_csv(df, f"file://{tmp_path}/x", ["i"], ["i", "v"])
    back = {r["i"]: r["v"] for r in files.read_csv(spark, f"file://{tmp_path}/x", "i long, v double").collect()}
    assert [repr(back[i]) for i in range(len(values))] == [repr(v) for v in values]


def test_manifest_order_and_headline(spark, tmp_path):
    entry = lambda key, head: {"label_key": key, "snomed_codes": [key], "diagnosis": key.upper(), "headline_eligible": head, "positive_counts": {"F": 3}}
    (tmp_path / "m.json").write_text(json.dumps({"labels": [entry("b", True), entry("a", False), entry("c", True)]}))
    rows = files.read_manifest(spark, f"file://{tmp_path}/m.json").orderBy("position").collect()
    assert [r["label_key"] for r in rows] == ["b", "a", "c"] and [r["position"] for r in rows if r["headline_eligible"]] == [0, 2]
    assert rows[0]["positive_counts"] == {"F": 3}
