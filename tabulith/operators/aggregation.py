"""Grouped and ungrouped aggregates over cell tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tabulith.functions import cells
from tabulith.functions.dates import date_part_bucket
from tabulith.operators.filters import filter_rows, resolve_column
from tabulith.operators.inference import column_marks

_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def _metric(df: DataFrame, agg: str, column: str | None) -> Column:
    if agg == "count":
        return F.count(F.lit(1))
    if agg not in _AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    if not column:
        raise ValueError(f"{agg} needs a column")
    return _AGGREGATES[agg](cells.plain_number(df, column))


def output_keys(metrics: list[dict]) -> list[str]:
    """agg_column names; a repeated name gets _2, _3, …"""
    used: list[str] = []
    for m in metrics:
        column = m.get("column")
        base = m["agg"]
        if column:
            base += "_" + re.sub(r"[^a-zA-Z0-9]+", "_", column).strip("_").lower()
        key, n = base, 2
        while key in used:
            key, n = f"{base}_{n}", n + 1
        used.append(key)
    return used


def group_key(column: str, date_part: str | None = None) -> Column:
    text = F.col(f"`{column}`.normalized")
    return date_part_bucket(text, date_part) if date_part else text


def aggregate(
    df: DataFrame,
    metrics: list[dict],
    group_by: str | None = None,
    date_part: str | None = None,
    conditions: list[dict] | None = None,
    sort_order: str = "desc",
    limit: int | None = None,
    annotate: bool = False,
) -> DataFrame:
    """`metrics` are {agg, column}; the first is `aggregate_value`, and with more than one
    metric each also has a column of its own. NULL is a group. Without `group_by` one row
    comes back even when nothing matches. `annotate` adds currency and unit of the first metric.
    """
    if not metrics:
        raise ValueError("at least one metric is needed")
    metrics = [
        {"agg": m["agg"].strip().lower(),
         "column": resolve_column(df, m["column"]) if m.get("column") else None}
        for m in metrics
    ]
    matched = filter_rows(df, conditions)
    values = [_metric(df, m["agg"], m["column"]).alias(f"__m{i}") for i, m in enumerate(metrics)]
    if group_by:
        key = group_key(resolve_column(df, group_by), date_part)
        grouped = matched.groupBy(key.alias("group_value")).agg(*values)
    else:
        grouped = matched.agg(F.lit(None).cast("string").alias("group_value"), *values)

    columns = [F.col("group_value"), F.col("__m0").alias("aggregate_value")]
    if len(metrics) > 1:
        columns += [F.col(f"__m{i}").alias(k) for i, k in enumerate(output_keys(metrics))]
    if annotate:
        first = metrics[0]["column"]
        if first:
            # One scan for both; its result is a row.
            marks = column_marks(df, [first]).select(F.struct("currency", "unit").alias("m")).scalar()
            columns += [marks["currency"].alias("metric_currency"), marks["unit"].alias("metric_unit")]
        else:
            columns += [F.lit(None).cast("string").alias(n)
                        for n in ("metric_currency", "metric_unit")]
    if group_by:
        value = F.col("__m0")
        order = value.asc_nulls_last() if sort_order == "asc" else value.desc_nulls_last()
        grouped = grouped.orderBy(order, F.col("group_value").asc_nulls_last())
        if limit is not None:
            grouped = grouped.limit(max(1, limit))
    return grouped.select(*columns)


def top_groups(df: DataFrame, metrics: list[dict], group_by: str, limit: int = 10, **more) -> DataFrame:
    return aggregate(df, metrics, group_by, sort_order="desc", limit=limit, **more)


def bottom_groups(
    df: DataFrame, metrics: list[dict], group_by: str, limit: int = 10, **more
) -> DataFrame:
    return aggregate(df, metrics, group_by, sort_order="asc", limit=limit, **more)


def drilldown(
    df: DataFrame,
    groups: DataFrame,
    group_by: str,
    date_part: str | None = None,
    conditions: list[dict] | None = None,
) -> DataFrame:
    """Source rows of the given `group_value`s, the NULL group included."""
    key = group_key(resolve_column(df, group_by), date_part)
    rows = filter_rows(df, conditions).withColumn("__key", key)
    wanted = groups.select(F.col("group_value").alias("__wanted")).distinct()
    return rows.join(
        wanted, F.col("__key").eqNullSafe(F.col("__wanted")), "left_semi"
    ).withColumnRenamed("__key", "group_value")
