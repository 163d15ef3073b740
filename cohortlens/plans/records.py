"""Queries on text records, signals, fits, scalar functions and sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse, scalar
from ..operators import discrimination as D
from ..operators import beats, expect, fitting, signals
from ..operators import calibration as C
from ..operators.lineage import cut
from ..sources.adapters import orders, people, predictions, predictions_of
from .registry import query, rounded

KEYS = ["cohort", "model", "label"]

HEADER = """SELECT c_custkey, concat('C', c_custkey, ' 2 500 5000', chr(10), 'f', c_custkey, '.mat 16 1000/mV 16 0 0 0 0 I', chr(10), 'f', c_custkey, '.mat 16 200(10)/mV 16 0 0 0 0 II', chr(10),
 '#Age: ', CAST(c_custkey % 90 AS VARCHAR(9)), chr(10), '#Sex: ', c_mktsegment, chr(10), '#Dx: ', CAST(c_nationkey + 100 AS VARCHAR(9)), ',', CAST(c_custkey % 7 AS VARCHAR(9)), ',x', chr(10)) AS text FROM customer"""


def headers(spark, sf_dir):
    text = HEADER.replace("chr(10)", "char(10)").replace("FROM customer", "FROM {customer}")
    return spark.sql(text, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


@query("f01_header_parse", f"""WITH h AS ({HEADER}), l AS (SELECT c_custkey, text, string_split(text, chr(10)) AS lines FROM h)
SELECT c_custkey, 'C' || c_custkey AS record, CAST(string_split(lines[1], ' ')[2] AS INT) AS leads, CAST(string_split(lines[1], ' ')[4] AS BIGINT) AS samples, string_split(lines[2], ' ')[1] AS signal_file,
 string_split(lines[2], ' ')[-1] || '|' || string_split(lines[3], ' ')[-1] AS lead_names, replace(lines[4], '#Age: ', '') AS age, replace(lines[5], '#Sex: ', '') AS sex,
 (SELECT string_agg(c, '|' ORDER BY TRY_CAST(c AS BIGINT) IS NULL, TRY_CAST(c AS BIGINT), c) FROM (SELECT DISTINCT unnest(string_split(replace(lines[6], '#Dx: ', ''), ',')) AS c)) AS diagnoses, sha256(text) AS digest FROM l""")
def f01(spark, sf_dir):
    rows = headers(spark, sf_dir).select("c_custkey", parse.header_record(F.col("text")).alias("h"))
    return rows.select("c_custkey", "h.record", "h.leads", "h.samples", "h.signal_file", parse.flat(F.col("h.lead_names")).alias("lead_names"), "h.age", "h.sex", parse.flat(F.col("h.diagnoses")).alias("diagnoses"), "h.digest")


@query("f03_gain_parts", f"""WITH h AS ({HEADER}), l AS (SELECT c_custkey, unnest([string_split(string_split(text, chr(10))[2], ' ')[3], string_split(string_split(text, chr(10))[3], ' ')[3]]) AS spec FROM h)
SELECT c_custkey, spec, CAST(regexp_extract(spec, '^([0-9.]+)', 1) AS DOUBLE) AS gain, coalesce(TRY_CAST(nullif(regexp_extract(spec, '\\((-?\\d+)\\)', 1), '') AS INT), 0) AS baseline, regexp_extract(spec, '/(.*)$', 1) AS unit FROM l""")
def f03(spark, sf_dir):
    lines = headers(spark, sf_dir).select("c_custkey", F.explode(F.slice(F.split("text", "\n"), 2, 2)).alias("line"))
    spec = lines.select("c_custkey", F.get(F.split("line", " "), F.lit(2)).alias("spec"))
    return spec.select("c_custkey", "spec", parse.gain_parts(F.col("spec")).alias("g")).select("c_custkey", "spec", "g.*")


@query("f04_record_names", "SELECT c_custkey, 'HR' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS name, CAST(substr('HR' || lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 3) AS BIGINT) AS back FROM customer")
def f04(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", parse.record_name(F.col("c_custkey")).alias("name"))
    return rows.withColumn("back", F.regexp_extract("name", r"(\d+)$", 1).cast("long"))


@query("f07_temperature", "SELECT cohort, model, label, record_id, round(1 / (1 + exp(-ln(q / (1 - q)) / CAST(1.3 AS DOUBLE))), 6) AS p FROM (SELECT *, LEAST(GREATEST(p, 1e-7), 1 - 1e-7) AS q FROM {PRED})")
def f07(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select(*KEYS, "record_id", scalar.temperature_scaled(F.col("p"), 1.3).alias("p")))


@query("f09_label_offsets", """SELECT cohort, model, label, record_id, round(CASE label WHEN 'large' THEN 1 / (1 + exp(-(ln(q / (1 - q)) * CAST(0.8 AS DOUBLE) - CAST(0.5 AS DOUBLE)))) ELSE p END, 6) AS p FROM (SELECT *, LEAST(GREATEST(p, 1e-7), 1 - 1e-7) AS q FROM {PRED})""")
def f09(spark, sf_dir):
    table = spark.createDataFrame([("large", 0.8, -0.5)], "label string, slope double, offset double")
    rows = predictions(spark, sf_dir).join(F.broadcast(table), "label", "left")
    return rounded(rows.select(*KEYS, "record_id", scalar.affine(F.col("p"), F.col("slope"), F.col("offset")).alias("p")))


@query("f10_prior_shift_offset", """WITH r AS (SELECT cohort, label, LEAST(GREATEST(AVG(y), 1e-6), 1 - 1e-6) AS q FROM {PRED} WHERE model = 'size' GROUP BY ALL) SELECT b.cohort, label, round(ln(b.q / (1 - b.q)) - ln(a.q / (1 - a.q)), 6) + 0 AS offset FROM r a JOIN r b USING (label) WHERE a.cohort = 'F' AND b.cohort <> 'F'""")
def f10(spark, sf_dir):
    rate = predictions(spark, sf_dir).where("model = 'size'").groupBy("cohort", "label").agg(F.avg("y").alias("q"))
    own = rate.where("cohort = 'F'").select("label", F.col("q").alias("q0"))
    return rounded(rate.where("cohort <> 'F'").join(own, "label").select("cohort", "label", scalar.prior_shift_offset(F.col("q0"), F.col("q")).alias("offset")))


@query("f16_axis_degrees", "SELECT vec_id, round(degrees(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE))), 4) + 0 AS axis FROM embeddings")
def f16(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    angle = scalar.axis_degrees(F.get("embedding", F.lit(1)).cast("double"), F.get("embedding", F.lit(0)).cast("double"))
    return e.select("vec_id", (F.round(angle, 4) + F.lit(0.0)).alias("axis"))


@query("f23_text_digest", "SELECT page_id, sha256(url) AS digest FROM pages")
def f23(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2("url", 256).alias("digest"))


@query("f24_json_lookup", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def f24(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "map<string,int>")["k"].alias("k"))


def lead_signals(spark, sf_dir):
    """Embeddings as signals: 4 leads of 16 samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lead = lambda i: F.slice("embedding", i * 16 + 1, 16)
    return e.select("vec_id", F.array(*[lead(i) for i in range(4)]).alias("signal"))


@query("a29_lead_moments", """WITH s AS (SELECT (CAST(i AS INT) - 1) // 16 AS lead, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings))
SELECT CAST(lead AS INT) AS lead, COUNT(*) AS n, round(AVG(x), 6) + 0 AS mean, round(stddev_pop(x), 6) AS sd, round(MIN(x), 6) AS low, round(MAX(x), 6) AS high FROM s GROUP BY lead""")
def a29(spark, sf_dir):
    out = signals.lead_moments(lead_signals(spark, sf_dir))
    return rounded(out.withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double")}))


@query("a28_signal_audit", """WITH f AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), r AS (SELECT vec_id, MAX(ABS(x)) AS peak FROM f GROUP BY vec_id)
SELECT (SELECT COUNT(*) FROM embeddings) AS records, COUNT(*) AS samples, COUNT(*) AS finite, round(CAST(MIN(x) AS DOUBLE), 6) AS low, round(CAST(MAX(x) AS DOUBLE), 6) AS high, (SELECT vec_id FROM r ORDER BY peak DESC, vec_id LIMIT 1) AS peak_record FROM f""")
def a28(spark, sf_dir):
    out = signals.audit(lead_signals(spark, sf_dir), "vec_id")
    return rounded(out.withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double")}))


@query("x07_windows", """SELECT vec_id, CAST(start AS INT) AS start, round(CAST(list_aggregate(list_transform(embedding[start + 1:start + 4], lambda x: CAST(x AS DOUBLE)), 'sum') AS DOUBLE), 5) + 0 AS first_lead FROM embeddings CROSS JOIN (SELECT unnest([0, 3, 6, 9, 12]) AS start)""")
def x07(spark, sf_dir):
    rows = signals.windows(lead_signals(spark, sf_dir), 16, 4, 5)
    total = F.aggregate(rows["signal"][0], F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.select("vec_id", "start", (F.round(total, 5) + F.lit(0.0)).alias("first_lead"))


@query("x05_standardized", "SELECT vec_id, round((CAST(embedding[17] AS DOUBLE) - CAST(0.01 AS DOUBLE)) / CAST(0.2 AS DOUBLE), 5) + 0 AS x FROM embeddings")
def x05(spark, sf_dir):
    rows = lead_signals(spark, sf_dir).select("vec_id", signals.standardize(F.transform("signal", lambda l: l.cast("array<double>")), [0.0, 0.01, 0.0, 0.0], [1.0, 0.2, 1.0, 1.0]).alias("s"))
    return rows.select("vec_id", (F.round(F.col("s")[1][0], 5) + F.lit(0.0)).alias("x"))


@query("x08_window_mean", "WITH w AS (SELECT vec_id, start, 1 / (1 + exp(-CAST(embedding[start + 1] AS DOUBLE))) AS p FROM embeddings CROSS JOIN (SELECT unnest([0, 3, 6, 9, 12]) AS start)) SELECT vec_id, round(AVG(p), 6) AS p FROM w GROUP BY vec_id")
def x08(spark, sf_dir):
    rows = signals.windows(lead_signals(spark, sf_dir), 16, 4, 5)
    return rounded(rows.select("vec_id", scalar.expit(F.col("signal")[0][0].cast("double")).alias("p")).groupBy("vec_id").agg(F.avg("p").alias("p")))


def beat_signals(spark, sf_dir):
    """Embeddings as twelve leads of 1,024 samples. A small file is one task, but its records take long: they are dealt over several tasks a core first."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    wide = F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 16))
    return e.select("vec_id", F.array(*[wide] * 12).alias("signal"))


@query("x20_signal_features")
def x20(spark, sf_dir):
    """Beat features of stand-in signals; the tests plant beats and find them again."""
    return beats.feature_table(beat_signals(spark, sf_dir), "vec_id")


@query("w05_differences", "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) + 0 AS change FROM events")
def w05(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(e.select("user_id", "event_id", (F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("change")))


@query("k07_best_checkpoint", """WITH r AS (SELECT o_custkey AS run, o_orderkey AS epoch, 1 / CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS auroc, round(o_totalprice / 50000) AS nll FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY auroc DESC, nll, epoch) AS k FROM r) SELECT run, epoch, round(auroc, 6) AS auroc, nll FROM k WHERE k = 1""")
def k07(spark, sf_dir):
    """Five values of the metric and a coarse likelihood, so that both tie."""
    auroc, nll = 1 / F.substring("o_orderpriority", 1, 1).cast("double"), F.round(F.col("o_totalprice") / 50000)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), auroc.alias("auroc"), nll.alias("nll"))
    return rounded(fitting.best_checkpoint(o, ["run"]), "auroc")


@query("a30_standardizer", "SELECT round(AVG(c_acctbal), 6) AS c_acctbal_centre, round(stddev_pop(c_acctbal), 6) AS c_acctbal_scale FROM customer")
def a30(spark, sf_dir):
    return rounded(fitting.standardizer(spark.read.parquet(f"{sf_dir}/customer.parquet"), ["c_acctbal"]))


DIRTY = """SELECT cohort, model, label, CASE WHEN record_id % 79 = 0 THEN 2 ELSE y END AS y, CASE WHEN record_id % 97 = 0 THEN NULL WHEN record_id % 89 = 0 THEN CAST('NaN' AS DOUBLE) WHEN record_id % 83 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN record_id % 73 = 0 THEN p - 2 ELSE p END AS p FROM {PRED}"""


@query("i08_prediction_report", f"SELECT cohort, model, label, COUNT(*) AS rows, COUNT(*) FILTER (WHERE p IS NULL) AS missing, COUNT(*) FILTER (WHERE isnan(p) OR isinf(p)) AS not_finite, COUNT(*) FILTER (WHERE p < 0 OR p > 1) AS out_of_range, COUNT(*) FILTER (WHERE y NOT IN (0, 1)) AS bad_labels FROM ({DIRTY}) GROUP BY ALL")
def i08(spark, sf_dir):
    """Scores with planted nulls, NaN, infinities and values out of range, and labels that are none."""
    n, p = F.col("record_id"), F.col("p")
    bad = F.when(n % 97 == 0, F.lit(None)).when(n % 89 == 0, F.lit(float("nan"))).when(n % 83 == 0, F.lit(float("inf"))).when(n % 73 == 0, p - 2).otherwise(p)
    rows = predictions(spark, sf_dir).withColumns({"y": F.when(n % 79 == 0, 2).otherwise(F.col("y")), "p": bad})
    return expect.prediction_report(rows, KEYS)


@query("u01_union_of_sections", "SELECT 'orders' AS section, cohort, CAST(COUNT(*) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS share FROM {ORDERS} GROUP BY cohort UNION ALL SELECT 'urgent', cohort, NULL, round(AVG(y_urgent), 6) FROM {ORDERS} GROUP BY cohort")
def u01(spark, sf_dir):
    o = orders(spark, sf_dir)
    a = o.groupBy("cohort").agg(F.count("*").cast("double").alias("n")).withColumn("section", F.lit("orders"))
    b = o.groupBy("cohort").agg(F.avg("y_urgent").alias("share")).withColumn("section", F.lit("urgent"))
    return rounded(a.unionByName(b, allowMissingColumns=True))


@query("e01_temperature_fit")
def e01(spark, sf_dir):
    return fitting.temperatures(predictions(spark, sf_dir).where("cohort = 'F' and fold = 9"), ["model"])


@query("e02_affine_fit")
def e02(spark, sf_dir):
    return fitting.affine_fits(predictions(spark, sf_dir), KEYS)


@query("e03_target_prevalence")
def e03(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    source = rows.where("cohort = 'F'").groupBy("model", "label").agg(F.avg("y").alias("source_prevalence"))
    return fitting.prevalences(rows.where("cohort <> 'F'"), source, KEYS, ["model", "label"])


@query("q23_calibration_ladder")
def q23(spark, sf_dir):
    rungs = fitting.calibration_ladder(predictions(spark, sf_dir), ["model"], "F")
    return C.calibration_summary(rungs, ["cohort", "model", "rung"])


@query("q25_recovery_curve")
def q25(spark, sf_dir):
    rows = predictions_of(cut(orders(spark, sf_dir).where("cohort = 'O'")))
    return fitting.platt_recovery(rows.where("label <> 'never'"), ["model", "label"], "record_id", [100, 250, 500, 1000], 50, 7)


@query("e08_logistic_baseline")
def e08(spark, sf_dir):
    # Each penalty's count, fit and check read the rows: written once.
    o = cut(orders(spark, sf_dir).where("cohort = 'F'").select("fold", "y_large", "p_size", "p_discount"))
    split = lambda c: o.where(c).select(F.col("y_large").alias("label"), "p_size", "p_discount")
    c, auroc, model = fitting.logistic_grid(split("fold <= 8"), split("fold = 9"), ["p_size", "p_discount"], "label", [0.01, 0.1, 1.0])
    return spark.createDataFrame([(float(c), float(auroc), *[float(x) for x in model.coefficients], float(model.intercept))], "c double, auroc double, size_weight double, discount_weight double, intercept double")


@query("q29_frozen_choices")
def q29(spark, sf_dir):
    """Thresholds by label and one temperature a model, from the validation fold only."""
    held = predictions(spark, sf_dir).where("cohort = 'F' and fold = 9")
    cuts = D.f1_thresholds(held, ["model", "label"]).groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "threshold")))).alias("thresholds"))
    return cuts.join(fitting.temperatures(held, ["model"]), "model").select("model", F.to_json("thresholds").alias("thresholds"), "temperature")
