"""Raw-text tables derived from the driver tables by SQL that reads the same in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tabulith.functions import cells
from tabulith.operators import inference
from tabulith.session import scratch_folder, spread, tune
from tabulith.sources import cellstore

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SQL = {
    "fx_sales": """
SELECT o_orderkey AS row_index,
 CAST(o_custkey AS STRING) AS customer,
 '  ' || o_orderstatus || ' ' AS status,
 CASE o_orderkey % 4
  WHEN 0 THEN d
  WHEN 1 THEN substr(d,9,2) || '/' || substr(d,6,2) || '/' || substr(d,1,4)
  WHEN 2 THEN substr(d,9,2) || '-' || substr(d,6,2) || '-' || substr(d,3,2)
  ELSE replace(d,'-','/') || ' 10:30' END AS order_date,
 CASE o_orderkey % 5
  WHEN 0 THEN '$' || CAST(CAST(FLOOR(amt/1000) AS BIGINT) AS STRING) || ','
   || lpad(CAST(CAST(amt % 1000 AS DECIMAL(18,2)) AS STRING),6,'0')
  WHEN 1 THEN '€ ' || CAST(amt AS STRING)
  WHEN 2 THEN 'USD ' || CAST(amt AS STRING)
  WHEN 3 THEN CAST(amt AS STRING)
  ELSE 'N/A' END AS amount,
 CASE o_orderkey % 3
  WHEN 0 THEN CAST(o_orderkey % 500 AS STRING) || ' kg'
  WHEN 1 THEN CAST((o_orderkey % 500) * 1000 AS STRING) || ' g'
  ELSE 'lb ' || CAST(o_orderkey % 500 AS STRING) END AS weight,
 CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'null' WHEN 2 THEN '-' WHEN 3 THEN NULL
  ELSE o_orderpriority END AS note
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
 CAST(o_totalprice AS DECIMAL(18,2)) AS amt FROM orders) t""",
    "fx_people": """
SELECT c_custkey AS row_index, translate(c_name,'0123456789','abcdefghij') AS name,
 'Land ' || chr(65 + n_nationkey) AS nation, r_name AS region,
 lower(c_mktsegment) AS segment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS balance
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "fx_questions": """
SELECT row_index AS qid, CASE row_index % 8
 WHEN 0 THEN 'What is the total balance in ' || nation || '?'
 WHEN 1 THEN 'Which segment has the highest balance in ' || nation || '?'
 WHEN 2 THEN 'How many rows where segment is ' || segment || '?'
 WHEN 3 THEN 'top 3 nation by average balance'
 WHEN 4 THEN 'lowest balance in a single row for ' || segment
 WHEN 5 THEN 'average balance for ' || segment || ' and ' || nation
 WHEN 6 THEN 'Count rows per region for ' || segment
 ELSE 'Who lives in ' || nation || '?' END AS question
FROM fx_people""",
    "fx_mixed": """
SELECT event_id AS row_index, CASE event_id % 4
 WHEN 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING) WHEN 1 THEN event_type
 WHEN 2 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS v FROM events""",
    "fx_edits": """
SELECT o_orderkey AS row_index, CASE WHEN o_orderstatus = 'P' THEN 'amount' ELSE 'note' END
 AS column_name, CASE WHEN o_orderstatus = 'P' THEN '$' || CAST(o_custkey + k AS STRING)
 ELSE 'edited ' || o_orderstatus || CAST(k AS STRING) END AS value, k AS seq
FROM (SELECT *, explode_k AS k FROM (SELECT *, 1 AS explode_k FROM orders
 UNION ALL SELECT *, 2 AS explode_k FROM orders WHERE o_orderstatus <> 'F') u) s
WHERE o_orderpriority = '1-URGENT'""",
    "fx_vectors": """
SELECT label AS dataset_id, vec_id AS row_index, embedding FROM embeddings
WHERE NOT (element_at(embedding, 1) < -0.1 AND label < 7)""",
    "fx_vector_rows": "SELECT label AS dataset_id, vec_id AS row_index FROM embeddings",
    "fx_folders": """
SELECT s_suppkey AS folder_id, n_regionkey AS enterprise_id, s_name AS name,
 CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' ELSE 'private' END AS privacy,
 s_suppkey % 4 AS sort_order FROM supplier JOIN nation ON s_nationkey=n_nationkey""",
    "fx_memberships": """
SELECT c_custkey AS membership_id, c_custkey AS user_id, n_regionkey AS enterprise_id,
 CASE WHEN c_custkey % 50 = 1 AND n_regionkey < 3 THEN 'owner' WHEN c_custkey % 20 = 0 THEN 'admin'
  WHEN c_custkey % 20 = 5 THEN 'member' ELSE 'querier' END AS role,
 c_mktsegment = 'MACHINERY' AS has_token
FROM customer JOIN nation ON c_nationkey=n_nationkey
UNION ALL
SELECT c_custkey + 1000000000, c_custkey, (n_regionkey + 1) % 5, 'querier', false
FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_mktsegment = 'BUILDING'""",
    "fx_users": """
SELECT c_custkey AS user_id, lower(c_name) AS login, CASE c_custkey % 4 WHEN 0 THEN n_regionkey
 WHEN 1 THEN (n_regionkey + 2) % 5 ELSE NULL END AS last_active_enterprise_id
FROM customer JOIN nation ON c_nationkey=n_nationkey""",
    "fx_groups": """
SELECT n_nationkey AS group_id, n_regionkey AS enterprise_id, n_name AS name FROM nation""",
    "fx_group_members": """
SELECT n_nationkey AS group_id, c_custkey AS user_id
FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_acctbal > 4000
UNION ALL
SELECT (n_nationkey + 5) % 25, c_custkey
FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_mktsegment = 'FURNITURE'""",
    "fx_grants": """
SELECT s_suppkey AS folder_id, s_nationkey AS group_id FROM supplier WHERE s_acctbal > 2000
UNION ALL
SELECT s_suppkey, (s_nationkey + 5) % 25 FROM supplier WHERE s_acctbal > 6000""",
    "fx_datasets": """
SELECT p_partkey AS dataset_id, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE n_regionkey END
 AS enterprise_id, p_name AS name, replace(p_name,' ','_') || '.csv' AS source_filename,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE s_suppkey END AS folder_id, p_size AS row_count,
 p_partkey % 10 <> 3 AS is_index_ready
FROM part JOIN supplier ON p_partkey % 10 = s_suppkey JOIN nation ON s_nationkey=n_nationkey""",
    # Column catalog: five columns for each five consecutive parts, some differing only in case.
    "fx_columns": """
SELECT CAST(FLOOR(p_partkey / 5) AS BIGINT) AS dataset_id,
 CAST(p_partkey % 5 AS INT) AS column_index,
 CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' (total)'
  ELSE p_brand END AS original_name,
 CASE p_partkey % 4 WHEN 0 THEN replace(p_name,' ','_') WHEN 1 THEN replace(upper(p_name),' ','_')
  WHEN 2 THEN p_brand ELSE replace(p_name,' ','') END AS normalized_name
FROM part""",
    "fx_answers": """
SELECT n.nation AS qid, p.row_index + CASE WHEN n.k % 5 = 0 THEN 1 ELSE 0 END AS source_row_index,
 n.k, n.best + CASE WHEN n.k % 7 = 0 THEN 0.5 ELSE 0 END AS metric_value,
 p.name || CASE WHEN n.k % 6 = 0 THEN 'x' ELSE '' END AS answer_value
FROM (SELECT nation, CAST(MAX(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS best,
 MIN(row_index) AS k FROM fx_people GROUP BY nation) n
JOIN fx_people p ON p.nation = n.nation AND CAST(p.balance AS DOUBLE) = n.best""",
}

NEEDS = {"fx_questions": ["fx_people"], "fx_answers": ["fx_people"]}


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    for table in BASE:
        if re.search(rf"\b{table}\b", SQL[name]):
            base(spark, sf, table).createOrReplaceTempView(table)
    for needed in NEEDS.get(name, []):
        fixture(spark, sf, needed).createOrReplaceTempView(needed)
    return spark.sql(SQL[name])


def with_(*names: str, **extra: str) -> str:
    """WITH list of fixtures (dependencies first) and further named queries."""
    ordered: dict[str, str] = {}
    for name in names:
        for needed in NEEDS.get(name, []):
            ordered[needed] = SQL[needed]
        ordered[name] = SQL[name]
    ordered.update(extra)
    text = ",\n".join(f"{n} AS ({q})" for n, q in ordered.items())
    return "WITH " + text.replace("element_at(", "list_extract(") + "\n"


# ── cell tables ───────────────────────────────────────────────────────────────

SALES = "customer status order_date amount weight note".split()
PEOPLE = "name nation region segment balance".split()

# Inference runs once per table and session, as it does once per ingest.
_hints: dict[tuple, dict] = {}


def hints(spark: SparkSession, sf: str, name: str, columns: list[str]) -> dict:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _hints:
        _hints[key] = inference.infer_hints(spread(fixture(spark, sf, name)), columns)
    return _hints[key]


_stored: dict[tuple, str] = {}

PART_ROWS = 200_000


#: The table, and its key, whose rows a fixture's rows are in the order of.
ORDERED = {"fx_sales": ("orders", "o_orderkey"), "fx_people": ("customer", "c_custkey")}


def raw_rows(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Raw rows in row order, in parts of a bounded number of rows and at least one per core. The
    table below is put in order before texts are made of it: they are made once, and its own columns
    take less room in the shuffle."""
    table, key = ORDERED[name]
    rows = base(spark, sf, table)
    parts = max(spark.sparkContext.defaultParallelism, rows.count() // PART_ROWS)
    fixture(spark, sf, name)  # names the tables
    rows.repartitionByRange(parts, key).createOrReplaceTempView(table)
    made = spark.sql(SQL[name])
    base(spark, sf, table).createOrReplaceTempView(table)
    return made


def cell_table(spark: SparkSession, sf: str, name: str, columns: list[str]) -> DataFrame:
    """The table as ingest leaves it: parsed and stored once per session, the kinds of its columns
    inferred from what is stored, then read by every query."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        table = cells.normalize_row(
            raw_rows(spark, sf, name), columns, **hints(spark, sf, name, columns)
        )
        folder = scratch_folder(spark, name)
        cellstore.write_cells(table, folder, 1)
        cellstore.write_kinds(spark, folder, 1)
        _stored[key] = folder
    return cellstore.read_cells(spark, _stored[key], 1)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return cell_table(spark, sf, "fx_sales", SALES)


def people(spark: SparkSession, sf: str) -> DataFrame:
    return cell_table(spark, sf, "fx_people", PEOPLE)
