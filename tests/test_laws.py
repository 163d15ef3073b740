"""Laws that hold whatever the data: weights, ties, identities, closed forms, planted signals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import parse, scalar
from cohortlens.operators import bootstrap as B
from cohortlens.operators import calibration as C
from cohortlens.operators import discrimination as D
from cohortlens.operators import beats, expect, fitting, labels, shift, signals, utility
from cohortlens.sources import files
from cohortlens.streaming.windowed import windowed_bins


def table(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def pairs_auroc(y, p, w=None):
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    y, p = np.asarray(y), np.asarray(p)
    a, b = y == 1, y == 0
    win = (p[a][:, None] > p[b][None]) + 0.5 * (p[a][:, None] == p[b][None])
    ww = w[a][:, None] * w[b][None]
    return (win * ww).sum() / ww.sum()


def test_tied_weighted_auroc(spark):
    y, p = [1, 0, 0, 1, 0, 1, 1], [0.35, 0.35, 0.2, 0.6, 0.6, 0.6, 0.05]
    for w in ([3, 1, 1, 2, 5, 1, 2], [0, 2, 6, 1, 1, 3, 1]):
        df = table(spark, k=["a"] * 7, y=y, p=p, w=w)
        assert D.auroc(df, ["k"], weight="w").first()["auroc"] == pytest.approx(pairs_auroc(y, p, w))


def test_integer_weights_are_repeated_rows(spark):
    rng = np.random.default_rng(3)
    y, p, w = rng.integers(0, 2, 60), rng.integers(0, 9, 60) / 8, rng.integers(0, 3, 60)
    weighted = D.auroc(table(spark, k=["a"] * 60, y=y, p=p, w=w), ["k"], weight="w").first()["auroc"]
    repeated = D.auroc(table(spark, k=["a"] * int(w.sum()), y=np.repeat(y, w), p=np.repeat(p, w)), ["k"]).first()["auroc"]
    assert weighted == pytest.approx(repeated)


def test_one_class_is_null_and_macro_skips_it(spark):
    df = table(spark, k=["a", "a", "b", "b"], y=[0, 0, 0, 1], p=[0.1, 0.2, 0.3, 0.4])
    found = {r["k"]: r["auroc"] for r in D.auroc(df, ["k"]).collect()}
    assert found == {"a": None, "b": 1.0}
    got = D.macro(D.auroc(df, ["k"]), [], "auroc").first()
    assert (got["macro_auroc"], got["contributing"]) == (1.0, 1)


def test_f1_tie_takes_the_smallest(spark):
    # From 0.3 up two of two positives and two negatives, from 0.7 up one and none: F1 is 2 / 3 at both.
    df = table(spark, k=["a"] * 14, y=[0] * 10 + [1, 0, 0, 1], p=[0.02] * 10 + [0.3, 0.4, 0.5, 0.7])
    found = D.f1_thresholds(df, ["k"]).first()
    assert (found["threshold"], found["f1"]) == (0.3, pytest.approx(2 / 3))


def test_sensitivity_floor(spark):
    df = table(spark, k=["a"] * 7, y=[1, 0, 1, 1, 0, 1, 0], p=[0.95, 0.85, 0.75, 0.65, 0.45, 0.15, 0.05])
    assert D.sensitivity_floor(df, ["k"], 0.9).first()["threshold"] == 0.15
    assert D.sensitivity_floor(df, ["k"], 0.7).first()["threshold"] == 0.65


def test_operating_points(spark):
    row = D.operating_ratios(table(spark, tp=[18.0], fp=[7.0], tn=[60.0], fn=[6.0])).first()
    assert (row["sensitivity"], row["ppv"]) == (0.75, 0.72)
    assert D.operating_ratios(table(spark, tp=[0.0], fp=[0.0], tn=[5.0], fn=[0.0])).first()["sensitivity"] is None


def test_midranks_keep_auroc(spark):
    rng = np.random.default_rng(4)
    df = table(spark, k=["a"] * 80, y=rng.integers(0, 2, 80), p=rng.integers(0, 20, 80) / 19)
    ranked = D.midranks(df, ["k"]).withColumn("p", F.col("midrank"))
    assert D.auroc(ranked, ["k"]).first()["auroc"] == pytest.approx(D.auroc(df, ["k"]).first()["auroc"])


def test_bins_are_left_closed(spark):
    df = spark.createDataFrame([(0.0,), (1 / 15,), (0.999,), (1.0,)], "p double")
    assert [r[0] for r in df.select(C.bin_index(F.col("p"))).collect()] == [0, 1, 14, 14]


def test_equal_mass_keeps_ties_together(spark):
    df = table(spark, k=["a"] * 30, y=[0, 1] * 15, p=[0.5] * 20 + [0.9] * 10)
    assert C.equal_mass_bins(df, ["k"]).groupBy("p").agg(F.countDistinct("bin").alias("n")).where("n > 1").isEmpty()


def test_hash_weights_are_poisson(spark):
    w = spark.range(20_000).select(B.hash_weight(F.col("id"), F.lit(1)).alias("w")).toPandas()["w"]
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05


def test_hash_weights_are_the_same_in_tasks_and_in_sql(spark):
    ids = [0, 1, 7, 4294967295, 4294967291, 10**12, -5]
    rows = spark.createDataFrame([(i,) for i in ids], "c long").select("c", *[B.hash_weight(F.col("c"), F.lit(r)).alias(f"r{r}") for r in range(9)]).collect()
    assert [[r[f"r{k}"] for k in range(9)] for r in rows] == B.hash_weights(np.array(ids), 9).astype(int).tolist()


@pytest.mark.parametrize("kind", ["hash", "multinomial", "registered"])
def test_replicates_are_weighted_statistics(spark, monkeypatch, kind):
    """Every replicate equals the statistic of all pairs under its weights, however rows are cut into chunks."""
    monkeypatch.setattr(B, "CHUNK", 7)
    rng = np.random.default_rng(5)
    df = table(spark, cohort=["F"] * 200, cluster_id=np.arange(200) // 2 + 3, label=["l", "m"] * 100, y=rng.integers(0, 2, 200), p=rng.integers(0, 12, 200) / 11)
    weights = {"hash": lambda: None, "multinomial": lambda: B.multinomial_weights(df, "cohort", 8, 9).drop("batch"), "registered": lambda: B.registered_weights(df, "cohort", 8, 9, batch=3)}[kind]()
    if weights is None:
        by_cluster = dict(enumerate(B.hash_weights(np.arange(3, 103), 8), 3))
    else:
        by_cluster = {r["cluster_id"]: np.array(r["weights"]) for r in weights.collect()}
        assert (sum(by_cluster.values()) == 100).all()
    if kind == "registered":
        stream = np.random.default_rng(9).multinomial(100, np.full(100, 0.01), size=8)
        assert all((by_cluster.get(c, 0) == stream[:, c - 3]).all() for c in range(3, 103))
    got = {(r["label"], r["replicate"]): r["auroc"] for r in B.replicate_auroc(df.repartition(3), ["label"], 8, weights=weights).collect()}
    basis = df.groupBy("cohort", "cluster_id", "label").agg(F.sum("p").alias("sp"), F.count("*").alias("n"))
    sums = {(r["label"], r["replicate"]): (r["sp"], r["n"]) for r in B.replicate_sums(basis, ["label"], ["sp", "n"], 8, weights=weights).collect()}
    p = df.toPandas()
    zero = np.zeros(8)
    for label in "lm":
        own = p[p["label"] == label]
        for r in range(8):
            w = np.array([by_cluster.get(c, zero)[r] for c in own["cluster_id"]])
            assert got[label, r] == pytest.approx(pairs_auroc(own["y"], own["p"], w))
            assert sums[label, r] == pytest.approx(((w * own["p"]).sum(), w.sum()))


def test_running_sums_cross_buckets(spark):
    rng = np.random.default_rng(8)
    p = np.concatenate([[0.0, 1.0, 0.5], 1 / (1 + np.exp(-rng.normal(0, 5, 300)))])
    df = table(spark, k=["a"] * 303, p=p, n=rng.integers(1, 5, 303))
    for falling in (False, True):
        rows = D.running(df, ["k"], {"n": "upto"}, falling=falling).toPandas().sort_values("p", ascending=not falling)
        assert rows["upto"].tolist() == rows["n"].cumsum().tolist()
    assert D.running(df, ["k"], {"n": "u"}).count() == 303


def test_interval_ignores_undefined(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("a", float("nan")), ("a", None)], "k string, v double")
    row = B.interval(df, ["k"], "v").first()
    assert (row["lower"], row["upper"], row["defined"]) == pytest.approx((2.5, 97.5, 101))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.2]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "f string, i int, p double")
    q = {r["i"]: r["q"] for r in B.benjamini_hochberg(df, ["f"], "p", ["i"]).collect()}
    assert q == pytest.approx({0: 0.04, 1: 0.04 * 4 / 3, 2: 0.04 * 4 / 3, 3: 0.2})


def test_temperature_of_overconfident_scores_is_over_one():
    t = fitting.fit_temperature(np.array([0.01, 0.9, 0.1, 0.99]), np.array([0, 0, 1, 1.0]), np.array([1, 1, 0, 0.0]))
    assert t > 1


def test_affine_recovers_its_parameters():
    z = np.linspace(-3, 3, 61)
    p, q = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-(0.7 * z - 0.4)))
    slope, offset, _ = fitting.fit_affine(p, 1e4 * q, 1e4 * (1 - q))
    assert (slope, offset) == pytest.approx((0.7, -0.4), abs=1e-5)
    assert fitting.fit_affine(p, 0 * q, q) == (1.0, 0.0, False)


def test_em_recovers_a_shifted_prevalence():
    support, pos, neg = np.array([0.1, 0.3, 0.5, 0.7, 0.9]), np.array([0.05, 0.1, 0.2, 0.3, 0.35]), np.array([0.4, 0.3, 0.15, 0.1, 0.05])
    source, target = 0.12, 0.37
    p = source * pos / (source * pos + (1 - source) * neg)
    got, _ = fitting.em_prevalence(p, 1e5 * (target * pos + (1 - target) * neg), source)
    assert got == pytest.approx(target, abs=1e-4) and len(support) == 5


def test_shapley_sides_add_up(spark):
    df = table(spark, a=[0.9], b=[0.85], c=[0.88], d=[0.8])
    pos, neg = shift.shapley_sides(F.col("d"), F.col("b"), F.col("c"), F.col("a"))
    assert df.select((pos + neg).alias("s")).first()["s"] == pytest.approx(-0.1)


def test_standardization_to_the_same_mix_changes_nothing(spark):
    df = table(spark, cohort=["F"] * 6 + ["O"] * 6, s=list("aabbbb") + list("aabbbb"))
    rows, found = shift.standardization_weights(df, df.where("cohort = 'F'"), ["s"])
    assert {round(r["weight"], 9) for r in rows.collect()} == {1.0}
    assert all(r["left_out"] == 0 for r in found.collect())


def test_correlation_p(spark):
    rows = spark.createDataFrame([(0.5, 20), (None, 20), (1.0, 5), (0.5, 3), (0.3, 2)], "r double, n int")
    p = [r[0] for r in rows.select(shift.correlation_p(F.col("r"), F.col("n"))).collect()]
    # Three rows: the angle's share.
    assert p[0] == pytest.approx(0.024770, abs=1e-5) and p[1] is None and p[2] == pytest.approx(0, abs=1e-9) and p[3] == pytest.approx(2 / 3) and p[4] is None


def test_whole_codes_only(spark):
    df = spark.createDataFrame([("12|98",), ("712",), ("120|1",), ("12",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(scalar.has_code(F.col("c"), ["12"])).collect()] == [True, False, False, True, False, False]


def test_header_text(spark):
    text = "REC77 2 250 1500\nREC77.bin 16 400/mV 12 3 15 -90 0 V1\nREC77.bin 16 400/mV 12 3 -4 311 0 V2\n#Age: 38\n#Sex: Female\n#Dx: 111,2222\n"
    h = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(parse.header_record(F.col("t")).alias("h")).collect()
    got = h[0]["h"]
    assert (got["record"], got["leads"], got["samples"], got["lead_names"], got["diagnoses"]) == ("REC77", 2, 1500, ["V1", "V2"], ["111", "2222"])
    assert (got["age"], got["sex"]) == ("38", "Female")


def test_bands(spark):
    df = spark.createDataFrame([("39.9",), ("40",), ("65",), ("x",), (None,), ("-1",), ("300",)], "a string")
    assert [r[0] for r in df.select(scalar.age_band(F.col("a"))).collect()] == ["under_40", "40_to_64", "65_plus", "unknown", "unknown", "under_40", "65_plus"]
    assert df.select(scalar.age_band_strict(F.col("a"))).collect()[5][0] == "unknown"


def test_reconciled(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "b", 1)], "r int, label string, y int")
    got = {r["r"]: (r["y"], r["y_union"], r["keep"]) for r in labels.reconciled(df, ["r"], "a", ["b"]).collect()}
    assert got == {1: (1, 1, True), 2: (0, 1, False)}


def test_decision_curve_is_direct_counting(spark):
    rng = np.random.default_rng(6)
    df = table(spark, k=["a"] * 200, y=rng.integers(0, 2, 200), p=rng.integers(0, 101, 200) / 100)
    p = df.toPandas()
    for r in utility.decision_curve(df, ["k"]).collect():
        flag = p["p"] >= r["t"]
        assert (r["tp"], r["fp"]) == ((flag & (p["y"] == 1)).sum(), (flag & (p["y"] == 0)).sum())


def planted(rate, seconds=10, hz=100, qrs=0.012):
    t = np.arange(seconds * hz) / hz
    x = np.zeros_like(t)
    for beat in np.arange(0.5, seconds, 60 / rate):
        x += 1.2 * np.exp(-0.5 * ((t - beat) / qrs) ** 2) + 0.15 * np.exp(-0.5 * ((t - beat + 0.16) / 0.02) ** 2) + 0.3 * np.exp(-0.5 * ((t - beat - 0.25) / 0.04) ** 2)
    return x


def beat_rows(spark, *records):
    rows = spark.createDataFrame([(i, None if r is None else [[float(v) for v in lead] for lead in r]) for i, r in enumerate(records)], "id int, signal array<array<double>>")
    return [r.asDict() for r in beats.feature_table(rows, "id").orderBy("id").collect()]


SCALES = (0.8, 1.0, 0.2, -0.9, 0.3, 0.6, 0.3, 0.5, 0.7, 0.9, 0.8, 0.6)


def test_planted_rate_is_found(spark):
    rates = (50, 75, 110)
    broken = np.stack([planted(75)] * 12)
    broken[3, 7] = np.nan
    *found, silent, none, short, unclean = beat_rows(spark, *[np.stack([planted(r) * s for s in SCALES]) for r in rates], np.zeros((12, 1000)), None, np.stack([planted(75)] * 3), broken)
    for rate, got in zip(rates, found):
        assert got["heart_rate_bpm"] == pytest.approx(rate, rel=0.03)
        assert got["r_peak_detection_failed"] == 0.0 and got["t_amplitude_ii_mv"] == pytest.approx(0.3, abs=0.05)
        assert got["frontal_axis_degrees"] == pytest.approx(math.degrees(math.atan2(0.6, 0.8)), abs=2) and got["r_amplitude_i_mv"] == pytest.approx(0.96, abs=0.1)
        # At 110 a minute the last beat's T wave, the larger one, reaches into the part searched: no P wave is measured.
        assert (got["pr_interval_ms"] is None) == (got["pr_interval_missing"] == 1.0) == (rate == 110)
        assert rate == 110 or 120 <= got["pr_interval_ms"] <= 200
    for got in (silent, none, short, unclean):
        flags = {"r_peak_detection_failed": 1.0, "pr_interval_missing": 1.0, "qt_interval_missing": 1.0}
        assert {k: v for k, v in got.items() if v is not None and k != "id"} == flags


def test_wider_beats_measure_wider(spark):
    width = [r["qrs_duration_ms"] for r in beat_rows(spark, *[np.stack([planted(70, qrs=q)] * 12) for q in (0.012, 0.03)])]
    assert width[1] > width[0]


def test_array_quantiles_and_crossings(spark):
    x = F.col("x")
    rows = spark.createDataFrame([([3.0, 1.0, 2.0, 9.0],), ([],), ([5.0],)], "x array<double>")
    assert [r[0] for r in rows.select(beats.array_quantile(x, 0.2)).collect()] == [pytest.approx(np.quantile([3, 1, 2, 9], 0.2)), None, 5.0]


def told(spark, x, column):
    return spark.createDataFrame([([float(v) for v in x],)], "x array<double>").select(column.alias("r")).first()["r"]


def test_feet_are_the_nearest_crossings(spark):
    x = [0.0, 3.0, 1.0, 4.0, 8.0, 4.0, 1.0, 2.0, 0.0]
    every = told(spark, x, beats.level_crossings(F.col("x"), F.lit(2.0)))
    assert [(pytest.approx(r["at"]), r["up"]) for r in every] == [(2 / 3, True), (1.5, False), (2 + 1 / 3, True), (5 + 2 / 3, False), (7.0, True), (7.0, False)][: len(every)]
    got = told(spark, x, beats.feet(F.col("x"), F.lit(2.0), F.lit(4.0)))
    assert (got["left"], got["right"]) == (pytest.approx(2 + 1 / 3), pytest.approx(5 + 2 / 3))
    none = told(spark, [5.0, 6.0, 5.0], beats.feet(F.col("x"), F.lit(2.0), F.lit(1.0)))
    assert none["left"] is None and none["right"] is None


@pytest.mark.parametrize("wave,want", [
    ([0, 0, 0.02, 0.1, 0.2, 0.1, 0, 0, 0, 0], 2.25), ([0, 0, 0.02, -0.1, -0.2, -0.1, 0, 0, 0, 0], 2.25), ([0, 0, 0, 0.01, 0.03, 0.01, 0, 0, 0, 0], None), ([0.3, 0.2, 0.1, 0, 0, 0, 0, 0, 0, 0], None),
    ([0.15, 0.15, 0.15, 0.15, 0.2, 0.15, 0.15, 0.15, 0, 0], None),
])
def test_p_onset_is_the_foot_of_its_largest_deflection(spark, wave, want):
    """Searched is what lies from 0 up to 3 samples before the onset at 11; a small, an edge and a footless wave have none."""
    x = [*wave, 0, 0, 5, 0]
    got = told(spark, x, beats.p_onset(F.col("x"), F.lit(11.0), F.lit(20), 100.0))
    assert got == (None if want is None else pytest.approx(want, abs=1e-9))


def test_t_wave_ends_where_its_steepest_tangent_rests(spark):
    t = lambda x, high: told(spark, x, beats.t_wave(F.col("x"), F.lit(0.0), F.lit(high), 100.0))
    up = [9, 0, 0, 0, 0.1, 0.4, 0.5, 0.4, 0.1, 0.05, 0, 0]
    got = t(up, 12)
    assert got["amplitude"] == 0.5 and got["end"] == pytest.approx(7 + 0.4 / 0.3)
    down = t([-v for v in up], 12)
    assert down["amplitude"] == -0.5 and down["end"] == pytest.approx(got["end"])
    rising = t([9, 0, 0, 0, 0.1, 0.2, 0.3, 0.4], 8)
    assert rising["amplitude"] == 0.4 and rising["end"] is None
    assert t(up, 7) is None and t(up, 2) is None


def test_bounds_are_held_within_reach(spark):
    """An envelope that never comes back to its level has its bounds at the reach; a flat one has none."""
    beat = lambda x: spark.createDataFrame([([[float(v) for v in x]] * 12,)], "beat array<array<double>>")
    spike = [0.0] * 40 + [1.0, -1.0] + [0.0] * 58
    r = beats.with_bounds(beat(spike), 100.0).first()
    assert 36 <= r["onset"] <= 40 <= r["offset"] <= 45
    # Wide: the joint step is as large for 25 samples on each side.
    wide = [0.0] * 15 + [(-1.0) ** i for i in range(50)] + [0.0] * 35
    r = beats.with_bounds(beat(wide), 100.0).first()
    assert r["right"] - r["top"] <= 14 and r["top"] - r["left"] <= 14
    flat = beats.with_bounds(beat([1.0] * 100), 100.0).first()
    assert flat["onset"] is None and flat["offset"] is None


def test_recovery_equals_its_rows_one_by_one(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 300).round(3)
    y = (rng.uniform(size=300) < p**2).astype(int)
    df = spark.createDataFrame([("a", i, int(y[i]), float(p[i])) for i in range(300)], "key string, id int, y int, p double")
    got = {r["k"]: r for r in fitting.platt_recovery(df, ["key"], "id", [40, 90, 300], 4, 7).collect()}
    places = df.select("id", F.array(*[F.xxhash64(F.lit(7), F.lit(r), "id") for r in range(4)]).alias("h")).orderBy("id").collect()
    for k in (40, 90):
        errors = []
        for r in range(4):
            at = sorted(range(300), key=lambda i: (places[i]["h"][r], i))
            a, b = at[:k], at[k:]
            slope, offset, _ = fitting.fit_affine(p[a], y[a].astype(float), 1.0 - y[a])
            q = 1 / (1 + np.exp(-(slope * np.log(p[b] / (1 - p[b])) + offset)))
            errors.append(sum(abs((q - y[b])[np.minimum((q * 15).astype(int), 14) == n].sum()) for n in range(15)) / len(b))
        assert got[k]["held_out_ece"] == pytest.approx(np.mean(errors)) and got[k]["sd"] == pytest.approx(np.std(errors, ddof=1))
    assert got[300]["held_out_ece"] is None


def test_decoding_and_scoring(spark):
    raw = np.arange(24, dtype="<i2").reshape(2, 12).tobytes()
    got = signals.decode_int16(spark.createDataFrame([(1, bytearray(raw))], "id int, content binary")).first()["digital"]
    assert got[0] == [0, 12] and got[11] == [11, 23]
    wave = spark.createDataFrame([(1, [[float(i) for i in range(20)]])], "id int, signal array<array<double>>")
    out = signals.score_records(wave, "id", ["a"], lambda x: x.mean(axis=(1, 2))[:, None], length=20, width=10, count=3).first()
    assert out["p"] == pytest.approx(9.5)


def test_expectations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(expect.Unmet):
        expect.unique(df, ["k"])
    assert expect.content_digest(df, ["k", "v"]) == expect.content_digest(df.orderBy(F.desc("v")).repartition(3), ["k", "v"])
    assert expect.content_digest(df, ["k", "v"]) != expect.content_digest(df.withColumn("v", F.lit("a")), ["k", "v"])
    path = str(tmp_path / "receipt.json")
    expect.receipt_update(path, "c1", "F", seed_1="d1")
    assert expect.receipt_update(path, "c1", "F", seed_2="d2")["passes"] == {"seed_1": "d1", "seed_2": "d2"}
    with pytest.raises(expect.Unmet):
        expect.receipt_update(path, "c2", "F")
    expect.receipt_close(path)
    with pytest.raises(expect.Unmet):
        expect.receipt_update(path, "c1", "F")


def test_resumable_sink(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.append_new(spark.range(5), path, ["id"]) == 5
    assert files.append_new(spark.range(8), path, ["id"]) == 3
    assert spark.read.parquet(path).count() == 8


def test_code_groups(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",1|2,3\n1|2,1,0\n3,0,1\n")
    groups = files.read_code_groups(spark, str(tmp_path / "w.csv"))
    names = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "code string, name string")
    assert {r["key"]: r["name"] for r in files.code_names(groups, names).collect()} == {"1|2": "x / y", "3": "z"}


def test_stream_bins_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", m % 2, (m % 10) / 10) for m in range(40)], "ts string, y int, p double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_bins(stream, "ts", [], "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable(), q.stop()
    assert spark.sql("select sum(n) from bins").first()[0] == 40
