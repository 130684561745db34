"""Sorting, paging and row selection.

A sort that feeds a limit becomes one top-k per task and a merge; nothing is sorted whole. A page
far down is found by counting: see `page_of`.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tabulith.functions import cells, dates
from tabulith.functions.numbers import sort_number
from tabulith.operators import inference
from tabulith.operators.filters import (
    column_kinds, filter_rows, project_columns, resolve_column, search_any_cell,
)


def _sort_key(df: DataFrame, column: str, sort_as: str) -> Column:
    kind = column_kinds(df, [column])[column] if sort_as == "auto" else sort_as
    text = F.col(f"`{column}`.normalized")
    # ISO text sorts in date order.
    return cells.plain_number(df, column) if kind == "number" else text


#: A page that ends within so many rows is one top-k; one further down is looked for by counting.
NEAR, RANGES, SAMPLE = 10_000, 64, 4096


class Key(NamedTuple):
    """One key of an order."""

    value: Column
    down: bool = False
    nulls_first: bool = False

    def order(self, name: str) -> Column:
        c = F.col(name)
        if self.down:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def _place(key: Key, name: str, bounds: list) -> Column:
    """The range a row falls in, in the order of the key: between two bounds, on a bound, or NULL.
    A search by halves: a row is compared with few of the bounds."""
    c = F.col(name)

    def among(first: int, last: int) -> Column:
        if first == last:
            return F.lit(2 * first)
        half = (first + last) // 2
        return (F.when(c < bounds[half], among(first, half)).when(c == bounds[half], 2 * half + 1)
                .otherwise(among(half + 1, last)))

    at = among(0, len(bounds))
    at = F.lit(2 * len(bounds)) - at if key.down else at
    return F.when(c.isNull(), 0 if key.nulls_first else 2 * len(bounds) + 2).otherwise(at + 1)


def _range_counts(rows: DataFrame, place: Column) -> DataFrame:
    """(place, n) of the ranges that hold rows; a row's place is worked out once."""
    return rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def _parts(rows: DataFrame, keys: list[Key], at: int, n: int, skip: int, limit: int) -> list[DataFrame]:
    """DataFrames that hold the rows `skip` to `skip + limit` of the `n` rows, whose keys before
    `at` are all equal."""
    if not skip and limit >= n:
        return [rows]
    ordered = rows.orderBy(*[k.order(f"__key{i}") for i, k in enumerate(keys)]).offset(skip).limit(limit)
    if skip + limit <= NEAR or at == len(keys):
        return [ordered]
    name = f"__key{at}"
    some = rows.select(name).where(F.col(name).isNotNull()).sample(min(1.0, SAMPLE / n), seed=1)
    found = sorted({r[0] for r in some.limit(4 * SAMPLE).collect() if r[0] == r[0]})
    bounds = sorted({found[i * len(found) // RANGES] for i in range(RANGES)}) if found else []
    place = _place(keys[at], name, bounds)
    counts = sorted(_range_counts(rows, place).collect())
    out, whole, before = [], [], 0
    for i, count in counts:
        first, last = max(0, skip - before), min(count, skip + limit - before)
        before += count
        if first >= last:
            continue
        if first == 0 and last == count:
            whole.append(i)
            continue
        inside = rows.where(place == i)
        # A bound or NULL is one value: the next key goes on.
        one = i % 2 == 0
        if not one and not bounds:
            out.append(ordered)
            continue
        out += _parts(inside, keys, at + one, count, first, last - first)
    if whole:
        out.append(rows.where(place.between(whole[0], whole[-1])))
    return out


def page_of(df: DataFrame, keys: list[Key], limit: int, offset: int) -> DataFrame:
    """The rows `offset` to `offset + limit` in the order of `keys`, the last one unique per row.

    A page far down is narrowed down key by key: bounds from a bounded sample cut the key's values
    into ranges, the ranges are counted in one aggregate, and only those at the ends of the page
    are looked into further; what lies before it counts by its number alone. So no task holds the
    rows before a page. The bounds decide how many rounds that takes, not what comes out.
    """
    limit, offset = max(1, limit), max(0, offset)
    names = [f"__key{i}" for i in range(len(keys))]
    rows = df.withColumns({n: k.value for n, k in zip(names, keys)})
    order = [k.order(n) for n, k in zip(names, keys)]
    if offset + limit <= NEAR:
        return rows.orderBy(*order).offset(offset).limit(limit).drop(*names)
    found = _parts(rows, keys, 0, rows.count(), offset, limit) or [rows.limit(0)]
    return reduce(DataFrame.unionByName, found).orderBy(*order).drop(*names)


def sort_rows(
    df: DataFrame, sort_by: str | None = None, sort_order: str = "asc", sort_as: str = "auto"
) -> DataFrame:
    """NULLs last either way; ties by row_index."""
    if sort_by is None:
        return df.orderBy("row_index")
    key = _sort_key(df, resolve_column(df, sort_by), sort_as)
    key = key.desc_nulls_last() if sort_order == "desc" else key.asc_nulls_last()
    return df.orderBy(key, "row_index")


def paginate(
    df: DataFrame,
    sort_by: str | None = None,
    sort_order: str = "asc",
    sort_as: str = "auto",
    limit: int = 50,
    offset: int = 0,
    conditions: list[dict] | None = None,
) -> DataFrame:
    """One page of the matching rows; `row_count` on each is the number of all matches."""
    matched = filter_rows(df, conditions)
    total = matched.agg(F.count(F.lit(1)).alias("n")).scalar()
    keys = [Key(F.col("row_index"))]
    if sort_by is not None:
        keys.insert(0, Key(_sort_key(df, resolve_column(df, sort_by), sort_as), sort_order == "desc"))
    return page_of(matched, keys, limit, offset).withColumn("row_count", total)


def filter_row_indices(df: DataFrame, conditions: list[dict] | None, max_rows: int = 100) -> DataFrame:
    """First matching row indices, with the total and whether some were left out."""
    keep = max(1, int(max_rows))
    matched = filter_rows(df, conditions).select("row_index")
    total = matched.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = matched.orderBy("row_index").limit(keep)
    return page.select(
        "row_index", total.alias("total_match_count"), (total > keep).alias("truncated")
    )


def rows_by_indices(
    df: DataFrame, indices: list[int] | DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Rows in the requested order, repeats kept; `position` is the place in the request. With
    `columns` only those are returned, as original values.

    Many requests at once come as a table: see `requested_rows`, where a missing row is no error.
    """
    if isinstance(indices, DataFrame):
        return requested_rows(project_columns(df, columns) if columns else df, indices)
    if not indices or min(indices) < 0:
        raise ValueError("non-negative row indices expected")
    spark = df.sparkSession
    request = spark.createDataFrame([(i, x) for i, x in enumerate(indices)], "position int, row_index bigint")
    # The request is the caller's own list, so it may travel to every task.
    asked = F.broadcast(request)
    missing = request.join(df.select("row_index").join(asked, "row_index", "left_semi"), "row_index", "left_anti")
    missing = [r[0] for r in missing.select("row_index").distinct().orderBy("row_index").limit(10).collect()]
    if missing:
        raise ValueError(f"row index not found: {missing}")
    rows = project_columns(df, columns) if columns else df
    bounds = F.col("row_index").between(min(indices), max(indices))  # reaches the scan
    found = rows.where(bounds).join(asked, "row_index")
    return found.select("position", *rows.columns).orderBy("position")


def requested_rows(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Bulk form: (request_id, indices ARRAY<BIGINT>) to rows; a missing row has found = false."""
    asked = requests.select("request_id", F.posexplode("indices").alias("position", "row_index"))
    rows = df.withColumn("found", F.lit(True))
    return asked.join(rows, "row_index", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def _slice_keys(column: str, direction: str = "asc") -> list[Key]:
    text = F.col(f"`{column}`.normalized")
    plain = F.trim(text)
    number = F.when(plain.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), plain.try_cast("double"))
    down = direction.lower() in ("desc", "descending")
    return [Key(number, down, down), Key(text, down, down), Key(F.col("row_index"))]


def slice_order(column: str, direction: str = "asc") -> list[Column]:
    """Numeric-looking text as numbers, then text; NULLs last ascending, first descending."""
    def order(k: Key) -> Column:
        if k.down:
            return k.value.desc_nulls_first()
        return k.value.asc_nulls_last()

    return [order(k) for k in _slice_keys(column, direction)]


def slice_sort(df: DataFrame, column: str, direction: str = "asc") -> DataFrame:
    return df.orderBy(*slice_order(resolve_column(df, column), direction))


def table_slice(
    df: DataFrame,
    offset: int = 0,
    limit: int = 30,
    sort_column: str | None = None,
    sort_direction: str = "asc",
    search: str | None = None,
) -> DataFrame:
    """A page of the table, searched and sorted; `row_count` counts the rows searched for."""
    matched = search_any_cell(df, search) if search else df
    total = matched.agg(F.count(F.lit(1)).alias("n")).scalar()
    keys = _slice_keys(resolve_column(df, sort_column), sort_direction) if sort_column else [Key(F.col("row_index"))]
    return page_of(matched, keys, limit, offset).withColumn("row_count", total)


def adaptive_order(df: DataFrame, column: str, direction: str = "asc") -> list[Column]:
    kind = inference.verdicts(inference.infer_sort_kind(df, [column]))[column]
    text = F.col(f"`{column}`")
    key = {
        "number": lambda: sort_number(text),
        "date": lambda: dates.sort_date(text),
        "text": lambda: F.lower(F.nullif(F.trim(text), F.lit(""))),
    }[kind]()
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    fallback = F.lower(F.trim(text))
    if direction == "desc":
        return [blank.asc(), key.desc_nulls_last(), fallback.desc_nulls_last(), F.col("row_index")]
    return [blank.asc(), key.asc_nulls_last(), fallback.asc_nulls_last(), F.col("row_index")]


def adaptive_sort(df: DataFrame, column: str, direction: str = "asc") -> DataFrame:
    """Plain text column sorted by the kind most values have; blanks last, then row order."""
    return df.orderBy(*adaptive_order(df, column, direction))


