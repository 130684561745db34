"""Aggregates. Sums are rounded: engines add in different orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import rules as R
from checks.fixtures import base, people, sales, with_
from tabulith.functions import cells
from tabulith.operators import aggregation

SALES_WITH = with_("fx_sales", cells=R.SALES_CELLS)
NUM, WEIGHT = R.sql_number("amount"), R.sql_number("weight")
BIG = [{"column": "amount", "operator": ">", "value": "1000"}]


def shown(df, digits=2):
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def query(metrics, *args, **kwargs):
    return lambda s, sf: shown(aggregation.aggregate(sales(s, sf), metrics, *args, **kwargs))


def m(agg, column=None):
    return {"agg": agg, "column": column}


QUERIES = {
    "agg_flagship": query([m("sum", "amount")], "status", conditions=BIG, limit=5),
    "agg_count": query([m("count", "note")]),
    "agg_count_nothing": query([m("count")], conditions=[{"column": "status", "operator": "=", "value": "?"}]),
    "agg_sum": query([m("sum", "amount")]),
    "agg_avg": query([m("avg", "weight")]),
    "agg_min": query([m("min", "amount")]),
    "agg_max": query([m("max", "amount")]),
    "agg_group_by": query([m("count")], "note"),
    "agg_multi_metric": query([m("sum", "amount"), m("count"), m("sum", "amount"), m("avg", "weight"), m("max", "customer")], "status"),
    "agg_top_groups": lambda s, sf: shown(aggregation.top_groups(sales(s, sf), [m("sum", "amount")], "customer", 10)),
    "agg_bottom_groups": lambda s, sf: shown(aggregation.bottom_groups(sales(s, sf), [m("min", "amount")], "customer", 10)),
    "agg_annotated": query([m("sum", "amount")], "status", annotate=True),
    "agg_annotated_unit": query([m("max", "weight")], "status", annotate=True),
}


def by_part(part):
    def run(s, sf):
        orders = base(s, sf, "orders").select(
            F.col("o_orderkey").alias("row_index"),
            F.col("o_orderdate").cast("date").cast("string").alias("day"),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
        table = cells.normalize_row(orders, ["day", "price"])
        return shown(aggregation.aggregate(table, [m("sum", "price"), m("count")], "day", part, limit=500))
    return run


QUERIES["agg_group_by_date_part"] = by_part("month")
QUERIES["agg_group_by_quarter"] = by_part("quarter")
QUERIES["agg_group_by_year"] = by_part("year")


def drilldown(s, sf):
    table = sales(s, sf)
    groups = aggregation.aggregate(table, [m("sum", "amount")], "order_date", "month", limit=3)
    return aggregation.drilldown(table, groups, "order_date", "month").select(
        "row_index", "group_value", F.col("order_date.normalized").alias("order_date"))


def drilldown_null(s, sf):
    table = sales(s, sf)
    groups = aggregation.aggregate(table, [m("count")], "note", limit=1)
    return aggregation.drilldown(table, groups, "note").select("row_index", "group_value")


QUERIES["drilldown"] = drilldown
QUERIES["drilldown_null_group"] = drilldown_null

ORDER = " ORDER BY aggregate_value {d} NULLS LAST, group_value NULLS LAST LIMIT {n}"


def grouped(values: str, key: str, n: int = 50, d: str = "DESC", where: str = "true", extra: str = "") -> str:
    return SALES_WITH + (
        f"SELECT {key} AS group_value, {values}{extra} FROM cells WHERE {where} GROUP BY 1"
        + ORDER.format(d=d, n=n))


def total(values: str, where: str = "true") -> str:
    return SALES_WITH + f"SELECT NULL::VARCHAR AS group_value, {values} FROM cells WHERE {where}"


ORACLES = {
    "agg_flagship": grouped(f"round(sum({NUM}),2) AS aggregate_value", "status", 5, where=f"{NUM} > 1000"),
    "agg_count": total("count(*) AS aggregate_value"),
    "agg_count_nothing": total("count(*) AS aggregate_value", "status = '?'"),
    "agg_sum": total(f"round(sum({NUM}),2) AS aggregate_value"),
    "agg_avg": total(f"round(avg({WEIGHT}),2) AS aggregate_value"),
    "agg_min": total(f"round(min({NUM}),2) AS aggregate_value"),
    "agg_max": total(f"round(max({NUM}),2) AS aggregate_value"),
    "agg_group_by": grouped("count(*) AS aggregate_value", "note"),
    "agg_multi_metric": grouped(
        f"round(sum({NUM}),2) AS aggregate_value, round(sum({NUM}),2) AS sum_amount, count(*) AS \"count\", "
        f"round(sum({NUM}),2) AS sum_amount_2, round(avg({WEIGHT}),2) AS avg_weight, "
        f"max({R.sql_number('customer')}) AS max_customer", "status"),
    "agg_top_groups": grouped(f"round(sum({NUM}),2) AS aggregate_value", "customer", 10),
    "agg_bottom_groups": grouped(f"round(min({NUM}),2) AS aggregate_value", "customer", 10, "ASC"),
    "agg_annotated": grouped(
        f"round(sum({NUM}),2) AS aggregate_value", "status",
        extra=", (SELECT amount_currency FROM cells WHERE amount_number IS NOT NULL AND amount_currency IS NOT NULL ORDER BY row_index LIMIT 1) AS metric_currency, NULL::VARCHAR AS metric_unit"),
    "agg_annotated_unit": grouped(
        f"round(max({WEIGHT}),2) AS aggregate_value", "status",
        extra=", NULL::VARCHAR AS metric_currency, (SELECT weight_unit FROM cells ORDER BY row_index LIMIT 1) AS metric_unit"),
    "drilldown": SALES_WITH + f""", g AS (SELECT left(order_date,7) AS group_value, sum({NUM}) AS v FROM cells GROUP BY 1
  ORDER BY v DESC NULLS LAST, 1 NULLS LAST LIMIT 3)
SELECT row_index, left(order_date,7) AS group_value, order_date FROM cells WHERE left(order_date,7) IN (SELECT group_value FROM g)""",
    "drilldown_null_group": SALES_WITH + """, g AS (SELECT note AS group_value, count(*) AS v FROM cells GROUP BY 1
  ORDER BY v DESC, 1 NULLS LAST LIMIT 1)
SELECT row_index, note AS group_value FROM cells, g WHERE note IS NOT DISTINCT FROM g.group_value""",
}
for name, expr in {
    "agg_group_by_date_part": "strftime(o_orderdate, '%Y-%m')",
    "agg_group_by_quarter": "strftime(o_orderdate, '%Y') || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR)",
    "agg_group_by_year": "strftime(o_orderdate, '%Y')",
}.items():
    ORACLES[name] = (
        f"SELECT {expr} AS group_value, round(sum(o_totalprice),2) AS aggregate_value, "
        "round(sum(o_totalprice),2) AS sum_price, count(*) AS \"count\" FROM orders GROUP BY 1"
        + ORDER.format(d="DESC", n=500))
