"""Filters, projection, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import rules as R
from checks.fixtures import base, fixture, people, sales, with_
from tabulith.functions import cells
from tabulith.operators import filters, paging
from tabulith.session import scratch_folder
from tabulith.sources import cellstore

SALES_WITH = with_("fx_sales", cells=R.SALES_CELLS)
PEOPLE_WITH = with_("fx_people", cells=R.PEOPLE_CELLS)
FLAT = "SELECT row_index, customer, status, order_date, amount, weight, note FROM cells WHERE "

QUERIES: dict = {}
ORACLES: dict = {}


def sales_filter(name: str, conditions: list[dict], where: str) -> None:
    QUERIES[name] = lambda s, sf: cells.flatten_normalized(
        filters.filter_rows(sales(s, sf), conditions))
    ORACLES[name] = SALES_WITH + FLAT + where


def one(column, operator, value=None, joiner="AND"):
    return {"column": column, "operator": operator, "value": value, "logical_operator": joiner}


NUM = R.sql_number("amount")
sales_filter("filter_eq", [one("Status", "==", "F")], "status = 'F'")
sales_filter("filter_ne", [one("note", "NEQ", "5-LOW")], "note <> '5-LOW'")
sales_filter("filter_compare_number", [one("amount", "GT", "$200,000.5")], f"{NUM} > 200000.5")
for name, op in {"ge": ">=", "lt": "<", "le": "<="}.items():
    sales_filter(f"filter_number_{name}", [one("weight", op, "100")], f"{R.sql_number('weight')} {op} 100")
sales_filter("filter_compare_date", [one("order_date", "gte", "2060-01-01")], "order_date >= '2060-01-01'")
sales_filter("filter_in", [one("status", "in", " F, P ,,")], "status IN ('F','P')")
sales_filter("filter_between_number", [one("amount", "between", "1,000 AND 200000".replace("1,000", "1000"))],
             f"{NUM} BETWEEN 1000 AND 200000")
sales_filter("filter_between_date", [one("order_date", "between", "1995-01-01, 1996-12-31")],
             "order_date BETWEEN '1995-01-01' AND '1996-12-31'")
sales_filter("filter_is_null", [one("note", "isnull")], "note IS NULL")
sales_filter("filter_is_not_null", [one("note", "not null")], "note IS NOT NULL")
sales_filter(
    "filter_bool_chain",
    [one("status", "=", "F"), one("note", "is_null", joiner="or"), one("amount", ">", "100000")],
    f"(status = 'F' OR note IS NULL) AND {NUM} > 100000",
)
sales_filter("filter_like", [one("note", "LIKE", "%-L_W")], "note LIKE '%-L_W'")
sales_filter("filter_not_like", [one("note", "not like", "%-L_W")], "note NOT LIKE '%-L_W'")


def part_cells(s, sf):
    return cells.normalize_row(
        base(s, sf, "part").select(F.col("p_partkey").alias("row_index"), "p_name", "p_type"),
        ["p_name", "p_type"])


QUERIES["filter_contains"] = lambda s, sf: cells.flatten_normalized(
    filters.filter_rows(part_cells(s, sf), [one("p_name", "contains", "D R_")]))
ORACLES["filter_contains"] = (
    "SELECT p_partkey AS row_index, p_name, p_type FROM part WHERE lower(p_name) LIKE '%d r_%'")
QUERIES["filter_not_contains"] = lambda s, sf: cells.flatten_normalized(
    filters.filter_rows(part_cells(s, sf), [one("P_NAME", "does not contain", "Ring")]))
ORACLES["filter_not_contains"] = (
    "SELECT p_partkey AS row_index, p_name, p_type FROM part WHERE lower(p_name) NOT LIKE '%ring%'")


def resolve_columns(s, sf):
    columns = fixture(s, sf, "fx_columns")
    ask = columns.select(
        "dataset_id",
        F.when(F.col("column_index") < 2, F.col("normalized_name"))
        .when(F.col("column_index") == 2, F.upper("normalized_name"))
        .when(F.col("column_index") == 3, F.concat(F.lit(" "), F.lower("original_name")))
        .otherwise(F.concat("normalized_name", F.lit("?"))).alias("requested"),
    )
    return filters.resolve_columns(ask, columns)


QUERIES["resolve_columns"] = resolve_columns
ORACLES["resolve_columns"] = with_("fx_columns", ask="""
 SELECT dataset_id, CASE WHEN column_index < 2 THEN normalized_name WHEN column_index = 2 THEN upper(normalized_name)
  WHEN column_index = 3 THEN ' ' || lower(original_name) ELSE normalized_name || '?' END AS requested FROM fx_columns""",
    scored="""SELECT a.dataset_id, a.requested,
 (SELECT count(*) FROM fx_columns c WHERE c.dataset_id = a.dataset_id AND c.normalized_name = trim(a.requested)) AS n_exact,
 (SELECT count(*) FROM fx_columns c WHERE c.dataset_id = a.dataset_id AND lower(c.normalized_name) = lower(trim(a.requested))) AS n_folded,
 (SELECT min(c.normalized_name) FROM fx_columns c WHERE c.dataset_id = a.dataset_id AND lower(c.normalized_name) = lower(trim(a.requested))) AS folded,
 (SELECT count(DISTINCT c.normalized_name) FROM fx_columns c WHERE c.dataset_id = a.dataset_id AND lower(c.original_name) = lower(trim(a.requested))) AS n_header,
 (SELECT min(c.normalized_name) FROM fx_columns c WHERE c.dataset_id = a.dataset_id AND lower(c.original_name) = lower(trim(a.requested))) AS header
 FROM ask a""") + """
SELECT dataset_id, requested, CASE WHEN n_exact > 0 THEN trim(requested) WHEN n_folded = 1 THEN folded
  WHEN n_folded > 1 THEN NULL WHEN n_header = 1 THEN header END AS resolved,
 CASE WHEN n_exact > 0 THEN 'exact' WHEN n_folded = 1 THEN 'folded' WHEN n_folded > 1 THEN 'ambiguous'
  WHEN n_header = 1 THEN 'header' ELSE 'unknown' END AS status FROM scored"""

QUERIES["project_columns"] = lambda s, sf: filters.project_columns(
    sales(s, sf), ["Amount", "status", "amount", "NOTE"])
ORACLES["project_columns"] = with_("fx_sales") + "SELECT row_index, amount, status, note FROM fx_sales"


def positions(df, *columns):
    return df.select("row_index", *columns)


def placed(df, *columns):
    """The rows of an ordered result with their places from 0."""
    rows = df.select("row_index", *columns)
    at = rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return df.sparkSession.createDataFrame(at, rows.schema.add("place", "long"))


QUERIES["sort_rows"] = lambda s, sf: placed(
    paging.sort_rows(sales(s, sf), "amount", "desc"), F.col("amount.normalized").alias("amount"))
ORACLES["sort_rows"] = SALES_WITH + (
    f"SELECT row_index, amount, row_number() OVER (ORDER BY {NUM} DESC NULLS LAST, row_index) - 1 AS place FROM cells")
QUERIES["paginate"] = lambda s, sf: positions(
    paging.paginate(sales(s, sf), "order_date", "asc", limit=30, offset=20,
                    conditions=[one("status", "=", "F")]),
    F.col("order_date.normalized").alias("order_date"), "row_count")
ORACLES["paginate"] = SALES_WITH + """SELECT row_index, order_date, (SELECT count(*) FROM cells WHERE status = 'F') AS row_count
 FROM cells WHERE status = 'F' ORDER BY order_date NULLS LAST, row_index LIMIT 30 OFFSET 20"""
QUERIES["paginate_deep"] = lambda s, sf: positions(
    paging.paginate(sales(s, sf), "amount", "desc", limit=40, offset=12_000),
    F.col("amount.normalized").alias("amount"), "row_count")
ORACLES["paginate_deep"] = SALES_WITH + f"""SELECT row_index, amount, (SELECT count(*) FROM cells) AS row_count
 FROM cells ORDER BY {NUM} DESC NULLS LAST, row_index LIMIT 40 OFFSET 12000"""
QUERIES["filter_row_indices"] = lambda s, sf: paging.filter_row_indices(
    sales(s, sf), [one("note", "is null")], 50)
ORACLES["filter_row_indices"] = SALES_WITH + """SELECT row_index, (SELECT count(*) FROM cells WHERE note IS NULL) AS total_match_count,
 (SELECT count(*) FROM cells WHERE note IS NULL) > 50 AS truncated FROM cells WHERE note IS NULL ORDER BY row_index LIMIT 50"""


def asked_rows(s, sf):
    """Each customer's requested list: its own order keys, newest first, and one missing key."""
    orders = base(s, sf, "orders")
    asked = orders.groupBy(F.col("o_custkey").alias("request_id")).agg(
        F.concat(F.sort_array(F.collect_list("o_orderkey"), asc=False), F.array(F.lit(-1).cast("bigint"))).alias("indices"))
    return orders.select(F.col("o_orderkey").alias("row_index"), "o_orderstatus"), asked


def shown_requests(found):
    return found.select("request_id", F.col("position").cast("bigint").alias("position"), "row_index", "o_orderstatus", "found")


QUERIES["rows_by_indices"] = lambda s, sf: shown_requests(paging.rows_by_indices(*asked_rows(s, sf)))
QUERIES["requested_rows"] = lambda s, sf: shown_requests(paging.requested_rows(*asked_rows(s, sf)))
ORACLES["rows_by_indices"] = ORACLES["requested_rows"] = """
WITH k AS (SELECT o_custkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS position,
  o_orderkey AS row_index, o_orderstatus, true AS found FROM orders)
SELECT * FROM k UNION ALL SELECT request_id, count(*), -1, NULL, false FROM k GROUP BY request_id"""
QUERIES["rows_by_listed_indices"] = lambda s, sf: paging.rows_by_indices(
    sales(s, sf), [70, 3, 3, 900, 0, 12, 70], ["Amount", "status"]).withColumn("position", F.col("position").cast("bigint"))
ORACLES["rows_by_listed_indices"] = with_("fx_sales") + """, asked AS (
 SELECT unnest(range(7)) AS position, unnest([70, 3, 3, 900, 0, 12, 70]) AS row_index)
SELECT position, row_index, amount, status FROM asked JOIN fx_sales USING (row_index)"""


def searched_by_signature(s, sf):
    """The people stored with signatures; what the search reads is narrowed down by them."""
    folder = scratch_folder(s, "signed")
    cellstore.write_cells(people(s, sf), folder, 1)
    cellstore.write_signatures(s, folder, 1, block_rows=64)
    stored, signed = cellstore.read_cells(s, folder, 1), cellstore.read_signatures(s, folder, 1)
    return cells.flatten_normalized(filters.search_any_cell(stored, " nd C", signed))


QUERIES["search_any_cell_signed"] = searched_by_signature
QUERIES["search_any_cell"] = lambda s, sf: cells.flatten_normalized(
    filters.search_any_cell(people(s, sf), " nd C"))
ORACLES["search_any_cell_signed"] = ORACLES["search_any_cell"] = PEOPLE_WITH + """SELECT row_index, name, nation, region, segment, balance FROM cells
 WHERE contains(lower(concat_ws(chr(1), name, nation, region, segment, balance)), 'nd c')"""


def mixed(s, sf):
    return cells.normalize_row(fixture(s, sf, "fx_mixed"), ["v"])


PLAIN = r"CASE WHEN regexp_matches(trim(v), '^[-+]?[0-9]*\.?[0-9]+$') THEN TRY_CAST(trim(v) AS DOUBLE) END"
QUERIES["slice_sort"] = lambda s, sf: placed(
    paging.slice_sort(mixed(s, sf), "v", "desc"), F.col("v.normalized").alias("v"))
ORACLES["slice_sort"] = with_("fx_mixed") + (
    f"SELECT row_index, v, row_number() OVER (ORDER BY {PLAIN} DESC NULLS FIRST, v DESC NULLS FIRST, row_index) - 1 AS place FROM fx_mixed")
QUERIES["table_slice"] = lambda s, sf: paging.table_slice(
    people(s, sf), 10, 40, "balance", "asc", "build").select(
        "row_index", F.col("balance.normalized").alias("balance"), "row_count")
ORACLES["table_slice"] = PEOPLE_WITH + """SELECT row_index, balance, (SELECT count(*) FROM cells WHERE segment = 'building') AS row_count
 FROM cells WHERE segment = 'building' ORDER BY CAST(balance AS DOUBLE), balance, row_index LIMIT 40 OFFSET 10"""
QUERIES["adaptive_sort"] = lambda s, sf: placed(
    paging.adaptive_sort(fixture(s, sf, "fx_sales"), "order_date", "desc"), "order_date")
# Half the values read as numbers and half as dates, so neither reaches its share: text.
ORACLES["adaptive_sort"] = with_("fx_sales") + (
    "SELECT row_index, order_date, row_number() OVER (ORDER BY coalesce(trim(order_date), '') = '', "
    "lower(trim(order_date)) DESC NULLS LAST, row_index) - 1 AS place FROM fx_sales")
