"""The cell: STRUCT<original, normalized, type, number, currency, unit, epoch_seconds, plain>.

`plain` is what filters and aggregates read as the cell's number (`numbers.sql_number`), which
differs from `number`, the typed one. Being stored, it can be pruned to and filtered in the scan.

A *cell table* is `row_index` plus one cell struct per column; columns whose name starts with
two underscores are internal. Being a struct, a cell prunes and pushes down field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulith.functions import dates, numbers, text

CELL = (
    "struct<original:string,normalized:string,type:string,number:double,"
    "currency:string,unit:string,epoch_seconds:bigint,plain:double>"
)


def is_internal(name: str) -> bool:
    return name.startswith("__")


def value_columns(df: DataFrame) -> list[str]:
    """Names of the cell columns, in order."""
    return [
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() == "struct" and not is_internal(f.name)
    ]


_FIELDS = {"normalized": "string", "type": "string", "number": "double", "currency": "string",
           "unit": "string", "epoch_seconds": "bigint", "plain": "double"}


def _cell(original: Column, kinds: list[tuple[Column, dict[str, Column]]], rest: dict[str, Column]) -> Column:
    """A cell whose fields are those of the first of the `kinds` that holds, else of the `rest`.

    The choice is made field by field: a query that reads some fields works out those only.
    """
    def field(name: str, type_: str) -> Column:
        null = F.lit(None).cast(type_)
        last = rest.get(name, null)
        (test, values), *others = kinds
        out = F.when(test, values.get(name, null))
        for test, values in others:
            out = out.when(test, values.get(name, null))
        return out.otherwise(last).cast(type_)

    return F.struct(original.cast("string").alias("original"), *[field(n, t).alias(n) for n, t in _FIELDS.items()])


def normalize_row(
    df: DataFrame,
    columns: list[str],
    date_formats: dict[str, str | None] | None = None,
    money_columns: set[str] | None = None,
    measurement_columns: set[str] | None = None,
    unicode_columns: set[str] | None = None,
) -> DataFrame:
    """Raw text columns to cells. Other columns pass through; `unicode_columns` get NFC first.

    Stacked projections: trim each raw text, look for a date, then for a measurement, a number and
    last for words, each only where the kinds before it found nothing. So no parse is repeated per
    struct field, and a value is not read as what it cannot become.
    """
    date_formats = date_formats or {}
    money = money_columns or set()
    measured = [c for c in columns if c in (measurement_columns or set())]
    named = lambda kind, c: F.col(f"`__{kind}_{c}`")
    found = lambda kind, c: named(kind, c).isNotNull()

    staged = df.select("*", *[text.strip_column(F.col(f"`{c}`").cast("string")).alias(f"__trim_{c}") for c in columns])
    staged = staged.select("*", *[
        dates.date_epoch(named("trim", c), date_formats.get(c), stripped=True).alias(f"__epoch_{c}")
        for c in columns])
    if measured:
        parts = {c: numbers.measurement_parts(named("trim", c)) for c in measured}
        staged = staged.select("*", *[
            F.when(~found("epoch", c), p).alias(f"__{kind}_{c}")
            for c in measured for kind, p in zip(("unit", "quantity"), parts[c])])
        staged = staged.select("*", *[
            numbers.convert_unit(named("quantity", c), named("unit", c)).alias(f"__standard_{c}")
            for c in measured])
    standard = lambda c, k: F.col(f"`__standard_{c}`.{k}")

    def settled(c: str, number: bool) -> Column:
        """Whether the cell is a date, money or a measurement."""
        out = found("epoch", c)
        if number and c in money:
            out = out | found("number", c)
        if c in measured and (number or c not in money):
            out = out | standard(c, "number").isNotNull()
        return out

    staged = staged.select("*", *[
        F.when(~settled(c, False), numbers.parse_number(named("trim", c), stripped=True)).alias(f"__number_{c}")
        for c in columns])
    def words_of(c: str) -> Column:
        if c in (unicode_columns or set()):
            return text.normalize_text_value(F.col(f"`{c}`"), True)
        return text.normalize_trimmed(named("trim", c))

    staged = staged.select(
        "*",
        *[F.when(~settled(c, True), words_of(c)).alias(f"__text_{c}") for c in columns],
        *[numbers.format_measurement(standard(c, "number"), standard(c, "unit")).alias(f"__shown_{c}") for c in measured],
        *[numbers.two_decimals(named("number", c)).alias(f"__amount_{c}") for c in columns if c in money],
    )

    def build(c: str) -> Column:
        raw, epoch, number, words = (F.col(f"`{c}`"), *(named(k, c) for k in ("epoch", "number", "text")))
        date = {"normalized": dates.epoch_to_iso(epoch), "type": F.lit("date"), "epoch_seconds": epoch}
        kinds = [(epoch.isNotNull(), date)]  # an ISO date is no number to the filters' rule
        if c in money:
            kinds.append((number.isNotNull(), {
                "normalized": named("amount", c), "type": F.lit("money"), "number": number,
                "currency": numbers.currency_of(raw), "plain": named("amount", c).try_cast("double")}))
        if c in measured:
            value, unit, shown = standard(c, "number"), standard(c, "unit"), named("shown", c)
            kinds.append((value.isNotNull(), {
                "normalized": shown, "type": F.lit("measurement"), "number": value, "unit": unit,
                "plain": numbers.sql_number(shown)}))
        rest = {"normalized": words, "type": F.when(number.isNotNull(), F.lit("number")), "number": number,
                "plain": numbers.sql_number(words)}
        return _cell(raw, kinds, rest).alias(c)

    wanted = set(columns)
    return staged.select(
        *[build(c) if c in wanted else F.col(f"`{c}`") for c in df.columns]
    )


def plain_number(df: DataFrame, column: str) -> Column:
    """What filters and aggregates read as the number of a column's cells: the stored field, or for
    cells without it the rule itself."""
    if "plain" in df.schema[column].dataType.names:
        return F.col(f"`{column}`.plain")
    return numbers.sql_number(F.col(f"`{column}`.normalized"))


# ── accessors ─────────────────────────────────────────────────────────────────


def get_normalized(cell: Column) -> Column:
    return cell["normalized"]


def get_original(cell: Column) -> Column:
    return cell["original"]


def get_typed(cell: Column) -> Column:
    """Typed record, NULL for untyped text."""
    return F.when(
        cell["type"].isNotNull(),
        F.struct(*[cell[f].alias(f) for f in ("type", "number", "currency", "unit",
                                              "epoch_seconds")]),
    )


def numeric_value(cell: Column) -> Column:
    """The typed number, else what the loose rule reads in the normalized text."""
    return F.when(
        cell["type"].isin("number", "money", "measurement"), cell["number"]
    ).otherwise(numbers.parse_number(cell["normalized"]))


def preview_value(cell: Column) -> Column:
    return F.coalesce(F.nullif(cell["original"], F.lit("")), cell["normalized"])


def _flatten(df: DataFrame, field: str) -> DataFrame:
    cells = set(value_columns(df))
    return df.select(
        *[
            F.col(f"`{c}`.{field}").alias(c) if c in cells else F.col(f"`{c}`")
            for c in df.columns
            if not is_internal(c)
        ]
    )


def flatten_normalized(df: DataFrame) -> DataFrame:
    return _flatten(df, "normalized")


def flatten_original(df: DataFrame) -> DataFrame:
    return _flatten(df, "original")


def row_to_text(values: dict[str, Column]) -> Column:
    """`name: value | name: value`, blanks left out."""
    parts = [
        F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))
        for name, v in values.items()
        if not is_internal(name)
    ]
    return F.concat_ws(" | ", *parts)


def table_row_text(df: DataFrame) -> Column:
    return row_to_text({c: F.col(f"`{c}`.normalized") for c in value_columns(df)})


def decode_row_json(doc: Column, keys: list[str], side: str = "normalized") -> list[Column]:
    """Values of the named keys from a stored JSON row, in one of its historical shapes.

    The document may have been JSON-encoded twice; a cell may be a scalar, {o, n} or
    {original, normalized}. What cannot be read gives NULL.
    """
    wrapped = F.concat(F.lit("["), doc, F.lit("]"))
    plain = F.coalesce(F.get_json_object(wrapped, "$[0]"), F.lit("{}"))
    short = side[0]
    out = []
    for key in keys:
        path = f"$['{key}']"
        whole = F.get_json_object(plain, path)
        is_object = whole.startswith("{")
        nested = F.coalesce(
            F.get_json_object(plain, f"{path}.{side}"), F.get_json_object(plain, f"{path}.{short}")
        )
        out.append(F.when(is_object, nested).otherwise(whole).alias(key))
    return out
