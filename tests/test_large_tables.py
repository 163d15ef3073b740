"""What keeps queries in proportion to large tables: no copies, no repeated work, bounded batches; and the results stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B
from cohortlens.operators import utility as U


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scored(spark, n=600, scores=7):
    rows = [("AB"[i % 2], i % 30, float(i % scores) / (scores - 1), int(i * 7 % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "cohort string, cluster_id long, p double, y int").repartition(3)


def test_threshold_replicates_equal_the_scan_and_deal_nothing(spark):
    df, at = scored(spark), (0.1, 0.5, 1.0)
    columns = ["cohort", "replicate", "pos", "neg", *[f"{k}_{i}" for i in range(3) for k in ("tp", "fp")]]
    out = B.threshold_replicates(df, ["cohort"], at, 5)
    scan = B.replicate_scan(df, ["cohort"], at, 5)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, scan.select(*columns).collect()))
    assert "hashpartitioning(cluster" not in plan(out)


def test_steps_of_a_grid(spark):
    values = [None, -1.0, 0.0, 0.1, 0.3 - 1e-12, 0.3, 0.5, 0.7, 1.0, float("nan")] + U.GRID
    df = spark.createDataFrame([(v,) for v in values], "p double")
    for grid in ([0.1, 0.3, 0.5], U.GRID, [0.5]):
        own = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("p")))
        step = U.steps_reached(F.col("p"), grid)
        assert df.where(step != own).count() == 0
        assert "lambda" not in plan(df.select(step))


def test_records_are_measured_once_and_dealt_first(spark, monkeypatch):
    from cohortlens.plans import baseline, records

    def few(df, record):
        return df.select(record).mapInArrow(lambda batches: batches, "vec_id long").select(record, *[F.lit(1.0).alias(n) for n in baseline.beats.FEATURES])

    monkeypatch.setattr(baseline.beats, "feature_table", few)
    out = baseline.q26_signal(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in plan(out)
    assert records.beat_signals(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_waves_come_in_small_batches(spark):
    from cohortlens.operators import beats

    rows = spark.range(0, 40, 1, 1).select("id", F.array_repeat(F.array_repeat(F.sin("id").cast("double"), 300), 12).alias("signal"))
    out = beats.filtered(rows, "id", "signal", 100.0)
    assert out.count() == 40
    assert int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) <= beats.BATCH_BYTES


def test_crowded_scores_share_no_single_bucket(spark):
    df = spark.range(0, 2000, 1, 2).select(F.lit("A").alias("cohort"), (F.col("id") % 50).alias("cluster_id"), (F.col("id") / 50_000 + 0.18).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    sizes = [r["count"] for r in B.score_sums(df, ["cohort"], 4, "cluster_id", None, None).groupBy("bucket").count().collect()]
    assert max(sizes) < 600


@pytest.mark.parametrize("own", ["id", "id div 400"])
def test_low_hashes_give_the_same_draws(spark, own):
    """With records of many rows, hashes come in clumps, so a bound may be met too rarely; then all rows are ranked."""
    from cohortlens.operators import fitting

    rows = spark.range(0, 4000, 1, 2).select("id", F.when(F.col("id") < 3900, "a").otherwise("b").alias("label"), F.expr(own).alias("record")).withColumn("repeat", F.explode(F.array(*map(F.lit, range(6)))))
    rows = rows.withColumn("drawn", F.xxhash64(F.lit(3), "repeat", "record"))
    order = fitting.W.partitionBy("label", "repeat").orderBy("drawn", "record", "id")
    plain = rows.withColumn("place", F.row_number().over(order)).where("place <= 150")
    out = fitting.first_drawn(rows, rows.where("repeat = 0").groupBy("label").agg(F.count("*").alias("n_all")), ["label"], ["record", "id"], 150, 6)
    columns = ["label", "repeat", "id", "place"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    assert "drawn" not in out.columns


def shuffled(spark, n):
    """Values from 1 to n in another order whenever they are read, as a cluster's shuffles bring them."""

    def task(batches):
        rng = np.random.default_rng()
        for batch in batches:
            yield batch.take(rng.permutation(batch.num_rows))

    return spark.range(1, n + 1, 1, 4).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / n).alias("p")).mapInArrow(task, "y int, p double").withColumn("k", F.lit("a"))


def test_quantiles_do_not_hang_on_the_order_of_rows(spark):
    """Sampled cuts differ by the order in which parts come; counts and totals must not meet in buckets of different cuts."""
    from cohortlens.operators import discrimination as D
    from cohortlens.operators import shift as S

    n = 600_000
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = shuffled(spark, n)
        found = D.quantiles(df, ["k"], "p", [0.1, 0.5, 0.99]).first()
        assert np.allclose(found["q"], np.quantile(np.arange(1, n + 1) / n, [0.1, 0.5, 0.99]), rtol=0, atol=1e-12)
        row, own = S.score_separation(df, ["k"]).first(), np.arange(2, n + 1, 2) / n
        assert np.allclose([row["median_pos"], row["median_neg"], row["neg_p99"]], [np.median(own - 1 / n), np.median(own), np.quantile(own, 0.99)], rtol=0, atol=1e-12)
        assert row["pos_below"] == (own - 1 / n < row["neg_p99"]).mean()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_score_separation_reads_its_rows_once(spark):
    from cohortlens.operators import shift as S

    read = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("a", 1, 0.9), ("a", 0, 0.2), ("a", 1, None), ("b", 1, float("nan")), ("b", 1, 0.5), ("c", 0, 0.5), ("d", None, 0.5), ("e", 0, None)]
    df = spark.createDataFrame(rows, "k string, y int, p double").coalesce(1).mapInArrow(task, "k string, y int, p double")
    found = {r["k"]: tuple(r)[1:] for r in S.score_separation(df, ["k"]).collect()}
    assert found == {"a": (0.9, 0.2, 0.2, 0.0), "b": (0.5, None, None, None), "c": (None, 0.5, 0.5, None), "d": (None,) * 4, "e": (None,) * 4}
    assert read.value == len(rows)


def test_only_the_median_beat_leaves_its_task(spark):
    """Waves are ten times as long as their median beat, and medians of boxed arrays took most of the features' time."""
    from cohortlens.operators import beats

    rng = np.random.default_rng(4)
    rows = [(i, [[float(v) for v in np.round(np.sin(np.arange(n) / 9.0 + k) + rng.normal(0, 0.1, n), 3)] for k in range(12)]) for i, n in enumerate((400, 90, 700))]
    df = spark.createDataFrame([*rows, (3, None), (4, [[0.0] * 50] * 12)], "id int, signal array<array<double>>")
    assert "wave" not in plan(beats.feature_table(df, "id"))
    waves = {r["id"]: r for r in beats.filtered(df, "id", "signal", 100.0).collect()}
    found = {r["id"]: r for r in beats.median_beats(df, "id", "signal", 100.0).collect()}
    assert [found[i]["beat"] for i in (3, 4)] == [None, None]
    for i, signal in rows:
        wave, peaks = np.array(waves[i]["wave"]), found[i]["peaks"]
        whole = [p for p in peaks if p >= beats.PRE and p + beats.POST <= wave.shape[1]] or peaks
        own = np.median([[lead.take(np.arange(p - beats.PRE, p + beats.POST), mode="clip") for p in whole] for lead in wave], axis=1)
        assert len(peaks) and np.allclose(found[i]["beat"], own, rtol=0, atol=1e-12)


def test_peaks_keep_their_distance():
    from cohortlens.operators import signals

    rng = np.random.default_rng(6)
    for distance in (1, 3, 30):
        x = np.round(rng.normal(0, 1, 500), 1)
        at = [i for i in range(1, 499) if x[i] > x[i - 1] and x[i] >= x[i + 1] and x[i] >= 0.2]
        kept = []
        for i in sorted(at, key=lambda i: (-x[i], i)):
            if all(abs(i - k) >= distance for k in kept):
                kept.append(i)
        assert signals.spaced_peaks(x, 0.2, distance).tolist() == sorted(kept)
    short = rng.normal(0, 1, (12, 30))
    assert np.array_equal(signals.bandpass(short, 5.0, 25.0, 100.0), np.stack([signals.bandpass(v, 5.0, 25.0, 100.0) for v in short]))
    wide = np.pad(short[0], 29, mode="reflect", reflect_type="odd")
    assert np.array_equal(signals.bandpass(short[0], 0.0, 50.0, 100.0), np.fft.irfft(np.fft.rfft(wide), len(wide))[29:59])
