"""Stand-ins for prediction, record and signal tables over the driver's tables.

Each is plain SQL that Spark and other engines read alike; `{name}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")

#: One row an order: cohort F is internal, O and P are external; the cluster is the customer.
ORDERS = """
SELECT o_orderstatus AS cohort, o_orderkey AS record_id, o_custkey AS cluster_id,
       CAST(o_orderkey % 10 + 1 AS INT) AS fold,
       MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y_returned,
       MAX(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS y_large,
       MAX(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS y_urgent,
       MAX(CASE WHEN l_quantity > 1000 THEN 1 ELSE 0 END) AS y_never,
       AVG(l_quantity) / CAST(50 AS DOUBLE) AS p_size,
       MAX(l_discount) * CAST(10 AS DOUBLE) AS p_discount
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
GROUP BY o_orderstatus, o_orderkey, o_custkey
"""

#: Long predictions: a row for each record, model and label.
PREDICTIONS = f"""
SELECT cohort, record_id, cluster_id, fold, model, label, y,
       CAST(CASE WHEN model = 'size' THEN p_size ELSE p_discount END AS DOUBLE) AS p
FROM (
  SELECT cohort, record_id, cluster_id, fold, p_size, p_discount, model, label,
         CASE label WHEN 'returned' THEN y_returned WHEN 'large' THEN y_large WHEN 'urgent' THEN y_urgent ELSE y_never END AS y
  FROM ({ORDERS}) o
  CROSS JOIN (SELECT 'returned' AS label UNION ALL SELECT 'large' UNION ALL SELECT 'urgent' UNION ALL SELECT 'never') l
  CROSS JOIN (SELECT 'size' AS model UNION ALL SELECT 'discount') m
) x
"""

#: One row a user and day with a set of codes, as pipe text.
USER_DAYS = """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, event_type AS code
FROM {events} GROUP BY user_id, CAST(CAST(ts AS DATE) AS VARCHAR(10)), event_type
"""

#: Customers as people: an age-like band value, a two-level factor.
PEOPLE = """
SELECT c_custkey AS person_id, CAST(c_custkey % 2 AS INT) AS sex_code,
       CAST(FLOOR((c_acctbal + 1000) / 110) AS INT) AS age, c_mktsegment AS segment, c_nationkey AS site
FROM {customer}
"""


def fill(text: str, **tables: str) -> str:
    """The SQL with table names, for an engine that has them as views."""
    names = {t: t for t in TABLES} | tables
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PREDICTIONS)


def predictions_of(own: DataFrame) -> DataFrame:
    """predictions() of orders() that were read before."""
    return own.sparkSession.sql(PREDICTIONS.replace(f"({ORDERS})", "{own}"), own=own)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, ORDERS)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, USER_DAYS)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PEOPLE)
