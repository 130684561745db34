"""Type inference: one aggregate over all rows and columns, a verdict row per column.

A caller who wants a verdict from the first rows alone says so with `sample_rows`.
Verdict tables have one row per column of the schema, so reading one on the driver is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, functions as F

from tabulith import fixed
from tabulith.functions import cells, dates, numbers
from tabulith.functions.text import is_nfc_suspect, starts_with_digit, strip, strip_column


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.where(F.col("row_index") < n)


def verdicts(df: DataFrame) -> dict:
    """A verdict table as {column: verdict}."""
    return {row[0]: row[1] for row in df.collect()}


def _per_column(
    sample: DataFrame, columns: list[str], stats: Callable[[Column], dict[str, Column]]
) -> DataFrame:
    """One aggregate computing the same statistics for every column, then a row per column."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        named = stats(F.col(f"`{c}`"))
        aggs += [a.alias(f"s{i}_{name}") for name, a in named.items()]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("column_index"),
                *[F.col(f"s{i}_{name}").alias(name) for name in named],
            )
        )
    return sample.agg(*aggs).select(F.inline(F.array(*rows)))


def _winner(priorities: list[str], weight: Callable[[str], Column] = F.col) -> Column:
    """Name of the largest count; later names win ties."""
    votes = [
        F.struct(weight(name).alias("votes"), F.lit(i).alias("priority"), F.lit(name).alias("name"))
        for i, name in enumerate(priorities)
    ]
    return F.greatest(*votes)["name"] if len(votes) > 1 else votes[0]["name"]


def _not_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) != ""


# ── raw text columns ──────────────────────────────────────────────────────────


def _raw_stats(df: DataFrame, columns: list[str], *every: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Statistics of raw texts, given each as it is and with its ends trimmed: once per value."""
    ends = df.select(*[
        F.struct(F.col(f"`{c}`").alias("raw"), strip_column(F.col(f"`{c}`").cast("string")).alias("text")).alias(c)
        for c in columns])
    return _per_column(ends, columns, lambda c: {
        name: stat for stats in every for name, stat in stats(c["raw"], c["text"]).items()})


def _date_stats(raw: Column, text: Column) -> dict[str, Column]:
    """A first part above 12 in any date-like value says that days come first, a second part above
    12 that months do; both together say nothing."""
    # Those with a part above 12 are some of them.
    dated = starts_with_digit(text) & dates.is_date_layout(text, True)
    return {
        "seen": F.count_if(dated),
        "day_first": F.coalesce(F.bool_or(dated & dates.first_above_12(text, True)), F.lit(False)),
        "month_first": F.coalesce(F.bool_or(dated & dates.second_above_12(text, True)), F.lit(False)),
        "suspect": F.coalesce(F.bool_or(is_nfc_suspect(raw)), F.lit(False)),
    }


def _money_stats(raw: Column, text: Column) -> dict[str, Column]:
    return {"money": F.count_if(numbers.looks_like_money(text, True))}


def _measurement_stats(raw: Column, text: Column) -> dict[str, Column]:
    return {
        "measured": F.count_if(numbers.looks_like_measurement(text, True)),
        "filled": F.count_if(text != ""),
    }


def _date_format(r: Row) -> str | None:
    if not r["seen"] or (r["day_first"] and r["month_first"]):
        return None
    return "mdy" if r["month_first"] else "dmy"


def infer_date_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """`date_format` dmy, mdy or NULL per column."""
    found = _raw_stats(df, columns, _date_stats).collect()
    return df.sparkSession.createDataFrame(
        [(r["column"], _date_format(r)) for r in found], "column string, date_format string"
    )


def infer_money_columns(
    df: DataFrame, columns: list[str], sample_rows: int | None = None
) -> DataFrame:
    sample = first_rows(df, sample_rows)
    stats = _raw_stats(sample, columns, _money_stats)
    return stats.select("column", (F.col("money") > 0).alias("is_money"))


def infer_measurement_columns(
    df: DataFrame, columns: list[str], sample_rows: int | None = None
) -> DataFrame:
    sample = first_rows(df, sample_rows)
    stats = _raw_stats(sample, columns, _measurement_stats)
    share = F.col("measured") / F.col("filled").cast("double")
    return stats.select(
        "column",
        F.when(F.col("filled") > 0, share >= fixed.MEASUREMENT_SHARE)
        .otherwise(False)
        .alias("is_measurement"),
    )


def infer_hints(df: DataFrame, columns: list[str], sample: DataFrame | None = None) -> dict:
    """Keyword arguments for `normalize_row`, from one aggregate over all rows. With `sample`, money
    and measurements are looked for in those rows only."""
    every = [_date_stats] if sample is not None else [_date_stats, _money_stats, _measurement_stats]
    found = _raw_stats(df, columns, *every)
    dates_ = {r["column"]: r for r in found.collect()}
    rest = dates_
    if sample is not None:
        rest = {r["column"]: r for r in _raw_stats(
            sample, columns, _money_stats, _measurement_stats).collect()}
    return {
        "date_formats": {c: _date_format(r) for c, r in dates_.items()},
        "unicode_columns": {c for c, r in dates_.items() if r["suspect"]},
        "money_columns": {c for c, r in rest.items() if r["money"] > 0},
        "measurement_columns": {
            c for c, r in rest.items() if r["filled"] and r["measured"] / r["filled"] >= fixed.MEASUREMENT_SHARE},
    }


_TYPES = fixed.TYPE_PRIORITY[1:]


def _type_votes(sample: DataFrame, columns: list[str], type_of) -> DataFrame:
    # A cell's type is worked out once, as a small number per column; numbers are counted.
    codes = {t: i for i, t in enumerate(_TYPES)}
    of = F.create_map(*[F.lit(x) for t, i in codes.items() for x in (t, i)])
    coded = sample.select(*[F.try_element_at(of, type_of(F.col(f"`{c}`"))).alias(c) for c in columns])
    stats = _per_column(coded, columns, lambda c: {t: F.count_if(c == i) for t, i in codes.items()})
    observed = sum((F.col(t) for t in _TYPES), F.lit(0))
    return stats.select(
        "column", F.when(observed == 0, "unknown").otherwise(_winner(_TYPES)).alias("inferred_type")
    )


def infer_context_types(
    df: DataFrame, columns: list[str], sample_rows: int | None = None, **hints
) -> DataFrame:
    """Type vote over the raw rows. The vote of a value is the type its cell gets."""
    sample = cells.normalize_row(first_rows(df, sample_rows), columns, **hints)
    return _type_votes(
        sample,
        columns,
        lambda c: F.when(c["normalized"].isNotNull(), F.coalesce(c["type"], F.lit("text"))),
    )


# ── cell tables ───────────────────────────────────────────────────────────────


def infer_types_stored(
    df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None
) -> DataFrame:
    """Typed records vote first; untyped text is read by the plain rules."""
    columns = columns or cells.value_columns(df)

    def type_of(c: Column) -> Column:
        text = c["normalized"]
        return (
            F.when(c["type"].isNotNull() | text.isNull(), c["type"])
            .when(dates.date_epoch(text, "swap").isNotNull(), "date")
            .when(numbers.currency_of(text).isNotNull() & numbers.has_number(text), "money")
            .when(numbers.looks_like_measurement(text), "measurement")
            .when(numbers.has_number(text), "number")
            .otherwise("text")
        )

    sample = first_rows(df, sample_rows)
    typed = sample.select(*[type_of(F.col(f"`{c}`")).alias(c) for c in columns])
    return _type_votes(typed, columns, lambda c: c)


def infer_column_kinds(
    df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None
) -> DataFrame:
    """text, number or date per column: a typed cell gives 2 votes, its text 1 more."""
    columns = columns or cells.value_columns(df)

    # A cell's votes as one small number, worked out once per row: the kind of its text and, from 4
    # on, of its type; counted per column.
    def code(c: Column) -> Column:
        text = c["normalized"]
        said = F.when(text.isNull(), 0).when(dates.is_iso_text(text), 1).when(numbers.has_number(text), 2).otherwise(3)
        typed = F.when(c["type"] == "date", 4).when(c["type"].isin("number", "money", "measurement"), 8).otherwise(0)
        return said + typed

    coded = first_rows(df, sample_rows).select(*[code(F.col(f"`{c}`")).alias(c) for c in columns])
    votes = _per_column(coded, columns, lambda c: {
        "date": F.count_if(c % 4 == 1) + 2 * F.count_if(F.floor(c / 4) == 1),
        "number": F.count_if(c % 4 == 2) + 2 * F.count_if(F.floor(c / 4) == 2),
        "text": F.count_if(c % 4 == 3),
    })
    return votes.select("column", _winner(["date", "number", "text"]).alias("kind"))


def detect_numeric_columns(
    df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None
) -> DataFrame:
    columns = columns or cells.value_columns(df)
    stats = _per_column(
        first_rows(df, sample_rows),
        columns,
        lambda c: {
            "hits": F.count_if(cells.numeric_value(c).isNotNull()),
            "rows": F.count(F.lit(1)),
        },
    )
    needed = F.greatest(F.lit(2), F.floor(F.col("rows") * fixed.NUMERIC_SHARE))
    return stats.select("column", (F.col("hits") >= needed).alias("is_numeric"))


def _sort_stats(df: DataFrame, columns: list[str], sample_rows: int | None = None) -> DataFrame:
    def stats(text: Column) -> dict[str, Column]:
        date = dates.sort_date(text).isNotNull()
        number = numbers.sort_number(text).isNotNull()
        return {
            "filled": F.count_if(_not_blank(text)),
            "numbers": F.count_if(number),
            "dates": F.count_if(~number & date),
            "all_dates": F.count_if(date),
        }

    return _per_column(first_rows(df, sample_rows), columns, stats)


def _share(name: str) -> Column:
    return F.coalesce(
        F.try_divide(F.col(name), F.col("filled")) >= fixed.SORT_SHARE, F.lit(False)
    )


def infer_sort_kind(df: DataFrame, columns: list[str]) -> DataFrame:
    """How to sort plain text columns: 60 % of the filled cells decide."""
    kind = F.when(_share("numbers"), "number").when(_share("dates"), "date").otherwise("text")
    return _sort_stats(df, columns).select("column", kind.alias("sort_kind"))


def detect_date_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return _sort_stats(df, columns).select("column", _share("all_dates").alias("is_date"))


_MARKS = {"currency": "money", "unit": "measurement"}


def column_marks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Currency and unit of the first cell that has one, per column, from one scan."""
    row = F.col("row_index")
    stats = _per_column(df, columns or cells.value_columns(df), lambda c: {
        field: F.min_by(c[field], F.when((c["type"] == kind) & c[field].isNotNull(), row))
        for field, kind in _MARKS.items()})
    return stats.select("column", *_MARKS)


def column_currency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Currency of the first money cell that names one."""
    return column_marks(df, columns).select("column", "currency")


def column_unit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Unit of the first measurement cell."""
    return column_marks(df, columns).select("column", "unit")
