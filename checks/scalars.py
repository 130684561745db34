"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import rules as R
from checks.fixtures import SALES, base, fixture, hints, raw_rows, sales, with_
from tabulith.functions import cells, dates, numbers, text
from tabulith.operators import headers
from tabulith.session import spread

QUERIES: dict = {}
ORACLES: dict = {}

SALES_WITH = with_("fx_sales", cells=R.SALES_CELLS)


def column_query(name, table, key, columns, sql, is_base=False):
    """Query `key` plus computed columns over every row of a table."""

    def run(spark, sf):
        df = base(spark, sf, table) if is_base else fixture(spark, sf, table)
        return spread(df).select(F.col(key), *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = run
    ORACLES[name] = sql


column_query(
    "normalize_header", "part", "p_partkey",
    lambda: {"header": text.normalize_header(
        F.concat(F.lit("  "), F.initcap("p_name"), F.lit(" ("), F.col("p_brand"),
                 F.col("p_type"), F.lit(")")))},
    # DuckDB's engine has no look-around either; the words of the test names are title case.
    r"""WITH h AS (SELECT p_partkey, upper(left(split_part(p_name,' ',1),1)) || substr(split_part(p_name,' ',1),2)
 || ' ' || upper(left(split_part(p_name,' ',2),1)) || substr(split_part(p_name,' ',2),2)
 || ' (' || p_brand || p_type || ')' AS h FROM part),
 a AS (SELECT p_partkey, regexp_replace(h, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g') AS h FROM h),
 b AS (SELECT p_partkey, lower(regexp_replace(h, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS h FROM a)
SELECT p_partkey, trim(regexp_replace(h, '[^a-z0-9]+', '_', 'g'), '_') AS header FROM b""",
    is_base=True,
)


def dedupe_headers(spark, sf):
    raw = base(spark, sf, "part").select(
        F.col("p_size").alias("file_id"), F.col("p_partkey").alias("column_index"),
        F.when(F.col("p_brand") == "Brand#7", F.lit(" ")).otherwise(F.col("p_name")).alias("header"),
    )
    return headers.dedupe_headers(raw, "file_id")


QUERIES["dedupe_headers"] = dedupe_headers
# The test names never carry a numeric suffix, so no advance past a taken name is needed here;
# the unit tests cover that.
ORACLES["dedupe_headers"] = r"""
WITH n AS (SELECT p_size AS file_id, p_partkey AS column_index,
 CASE WHEN p_brand = 'Brand#7' THEN 'col_' || CAST(p_partkey + 1 AS VARCHAR) ELSE replace(p_name, ' ', '_') END AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, base ORDER BY column_index) AS k FROM n)
SELECT file_id, column_index, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS normalized_name FROM r"""

column_query(
    "sanitize_name", "part", "p_partkey",
    lambda: {"name": text.sanitize_name(
        F.concat(F.lit(" "), F.col("p_name"), F.lit("!  #"), F.repeat(F.col("p_type"), F.lit(9)),
                 F.lit(".CSV ")))},
    r"""SELECT p_partkey, left(trim(regexp_replace(regexp_replace(p_name || '!  #' || repeat(p_type, 9),
 '[^A-Za-z0-9 _-]', '', 'g'), '\s+', ' ', 'g')), 64) AS name FROM part""",
    is_base=True,
)
column_query(
    "name_collision_key", "part", "p_partkey",
    lambda: {"key": text.name_collision_key(
        F.concat(F.upper("p_name"), F.lit("_-_"), F.col("p_brand"), F.lit(".tsv")))},
    r"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || '_-_' || p_brand,
 '[^A-Za-z0-9 _-]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key FROM part""",
    is_base=True,
)
column_query(
    "clean_description", "documents", "doc_id",
    lambda: {"description": text.clean_description(F.col("text"))},
    r"""SELECT doc_id, nullif(left(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'),
 '^\s+|\s+$', '', 'g'), 100), '') AS description FROM documents""",
    is_base=True,
)
column_query(
    "normalize_text_value", "fx_sales", "row_index",
    lambda: {"note_text": text.normalize_text_value(F.col("note")),
             "status_text": text.normalize_text_value(F.col("status"))},
    with_("fx_sales") + f"SELECT row_index, {R.text('note')} AS note_text, "
    f"{R.text('status')} AS status_text FROM fx_sales",
)


def unicode_forms(spark, sf):
    """NFC over every document, its accents first taken apart by plain replacement."""
    pairs = {"é": "é", "è": "è", "ê": "ê", "ü": "ü", "ö": "ö"}
    apart = F.col("text")
    for whole, parts in pairs.items():
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    docs = spread(base(spark, sf, "documents"))
    return docs.select("doc_id", text.normalize_text_value(apart, unicode_form=True).alias("value"))


QUERIES["normalize_text_nfc"] = unicode_forms
ORACLES["normalize_text_nfc"] = f"SELECT doc_id, {R.text('nfc_normalize(text)')} AS value FROM documents"

column_query(
    "parse_number", "fx_sales", "row_index",
    lambda: {n: numbers.parse_number(F.col(n)) for n in ("customer", "amount", "weight", "note")},
    with_("fx_sales") + "SELECT row_index, "
    + ", ".join(f"{R.number(n)} AS {n}" for n in ("customer", "amount", "weight", "note"))
    + " FROM fx_sales",
)
column_query(
    "sql_number", "fx_sales", "row_index",
    lambda: {n: numbers.sql_number(F.col(n)) for n in ("customer", "amount", "weight", "note")},
    with_("fx_sales") + "SELECT row_index, "
    + ", ".join(f"{R.sql_number(n)} AS {n}" for n in ("customer", "amount", "weight", "note"))
    + " FROM fx_sales",
)


def parse_money(spark, sf):
    df = spread(fixture(spark, sf, "fx_sales"))
    return df.select("row_index", numbers.parse_money(F.col("amount")).alias("m")).select(
        "row_index", "m.normalized", "m.number", "m.currency"
    )


QUERIES["parse_money"] = parse_money
ORACLES["parse_money"] = with_("fx_sales", p=f"SELECT row_index, {R.number('amount')} AS n, {R.currency('amount')} AS c FROM fx_sales") + """
SELECT row_index, CASE WHEN c IS NOT NULL AND n IS NOT NULL THEN printf('%.2f', n) END AS normalized,
 CASE WHEN c IS NOT NULL THEN n END AS number, CASE WHEN n IS NOT NULL THEN c END AS currency FROM p"""

column_query(
    "looks_like_money", "fx_sales", "row_index",
    lambda: {n: numbers.looks_like_money(F.col(n)) for n in ("amount", "weight", "note")},
    with_("fx_sales") + "SELECT row_index, "
    + ", ".join(f"{R.looks_like_money(n)} AS {n}" for n in ("amount", "weight", "note"))
    + " FROM fx_sales",
)


def parse_measurement(spark, sf):
    df = spread(fixture(spark, sf, "fx_sales"))
    return df.select("row_index", numbers.parse_measurement(F.col("weight")).alias("m")).select(
        "row_index", "m.normalized", F.round("m.number", 6).alias("number"), "m.unit"
    )


QUERIES["parse_measurement"] = parse_measurement
ORACLES["parse_measurement"] = SALES_WITH + (
    "SELECT row_index, weight AS normalized, round(weight_number, 6) AS number, "
    "weight_unit AS unit FROM cells"
)


def convert_unit(spark, sf):
    return spread(base(spark, sf, "part")).select(
        "p_partkey",
        *[
            F.round(numbers.convert_unit(F.col("p_size").cast("double"), F.lit(u))["number"], 6).alias(n)
            for n, u in {"kg": "lbs", "m": "Mi", "litre": "gal", "celsius": "°F", "kelvin": "K",
                         "speed": "mph", "area": "sq ft"}.items()
        ],
        numbers.convert_unit(F.col("p_size").cast("double"), F.lit("sq ft"))["unit"].alias("area_unit"),
    )


QUERIES["convert_unit"] = convert_unit
ORACLES["convert_unit"] = """SELECT p_partkey, round(p_size*0.453592::DOUBLE, 6) AS kg, round(p_size*1609.344::DOUBLE, 6) AS m,
 round(p_size*3.78541::DOUBLE, 6) AS litre, round(p_size*(5e0/9e0) - 160e0/9e0, 6) AS celsius,
 round(p_size - 273.15::DOUBLE, 6) AS kelvin, round(p_size*0.44704::DOUBLE, 6) AS speed,
 CAST(p_size AS DOUBLE) AS area, 'sq ft' AS area_unit FROM part"""

column_query(
    "format_measurement", "fx_sales", "row_index",
    lambda: {"shown": numbers.format_measurement(
        numbers.parse_measurement(F.col("weight"))["number"], F.lit("kg"))},
    SALES_WITH + "SELECT row_index, weight AS shown FROM cells",
)

column_query(
    "parse_date", "fx_sales", "row_index",
    lambda: {"iso_date": dates.parse_date(F.col("order_date"))["iso_date"],
             "epoch_seconds": dates.parse_date(F.col("order_date"))["epoch_seconds"]},
    with_("fx_sales", p=f"SELECT row_index, {R.date('order_date', 'swap')} AS d FROM fx_sales")
    + "SELECT row_index, CAST(d AS VARCHAR) AS iso_date, CAST(epoch(d) AS BIGINT) AS epoch_seconds FROM p",
)
column_query(
    "parse_date_with_format", "fx_sales", "row_index",
    lambda: {f"{h or 'plain'}": dates.parse_date_with_format(F.col("order_date"), h)["iso_date"]
             for h in ("dmy", "mdy", None)},
    with_("fx_sales", p="SELECT row_index, " + ", ".join(
        f"{R.date('order_date', o)} AS {n}" for n, o in
        (("dmy", "dmy"), ("mdy", "mdy"), ("plain", "dmy"))) + " FROM fx_sales")
    + "SELECT row_index, CAST(dmy AS VARCHAR) AS dmy, CAST(mdy AS VARCHAR) AS mdy, "
    "CAST(plain AS VARCHAR) AS plain FROM p",
)


def normalize_row(spark, sf):
    """The parse itself, raw text to cells."""
    df = cells.normalize_row(raw_rows(spark, sf, "fx_sales"), SALES, **hints(spark, sf, "fx_sales", SALES))
    out = [F.col("row_index")]
    for c in ("customer", "status", "order_date", "amount", "weight", "note"):
        out += [F.col(f"{c}.normalized").alias(c), F.col(f"{c}.type").alias(f"{c}_type")]
    return df.select(
        *out, F.col("order_date.epoch_seconds").alias("order_date_epoch"),
        F.round("amount.number", 2).alias("amount_number"),
        F.col("amount.currency").alias("amount_currency"),
        F.round("weight.number", 6).alias("weight_number"), F.col("weight.unit").alias("weight_unit"),
    )


QUERIES["normalize_row"] = normalize_row
ORACLES["normalize_row"] = SALES_WITH + """
SELECT row_index, customer, 'number' AS customer_type, status, NULL::VARCHAR AS status_type,
 order_date, 'date' AS order_date_type, amount,
 CASE WHEN amount_number IS NOT NULL THEN 'money' END AS amount_type,
 weight, 'measurement' AS weight_type, note, NULL::VARCHAR AS note_type, order_date_epoch,
 round(amount_number, 2) AS amount_number, CASE WHEN amount_number IS NOT NULL THEN amount_currency END AS amount_currency,
 round(weight_number, 6) AS weight_number, weight_unit FROM cells"""


def accessors(spark, sf):
    df = sales(spark, sf)
    return df.select(
        "row_index",
        cells.get_normalized(F.col("amount")).alias("normalized"),
        cells.get_original(F.col("amount")).alias("original"),
        cells.get_typed(F.col("amount"))["type"].alias("typed"),
        F.round(cells.numeric_value(F.col("amount")), 2).alias("amount_value"),
        F.round(cells.numeric_value(F.col("weight")), 6).alias("weight_value"),
        cells.numeric_value(F.col("order_date")).alias("date_value"),
    )


QUERIES["cell_accessors"] = accessors
ORACLES["cell_accessors"] = SALES_WITH + """
SELECT row_index, amount AS normalized, amount_original AS original,
 CASE WHEN amount_number IS NOT NULL THEN 'money' END AS typed, round(amount_number, 2) AS amount_value,
 round(weight_number, 6) AS weight_value, NULL::DOUBLE AS date_value FROM cells"""

for _name, _accessor, _sql in (
    ("get_normalized", cells.get_normalized, "amount"),
    ("get_original", cells.get_original, "amount_original"),
    ("get_typed", lambda c: cells.get_typed(c)["type"], "CASE WHEN amount_number IS NOT NULL THEN 'money' END"),
    ("numeric_value", lambda c: F.round(cells.numeric_value(c), 2), "round(amount_number, 2)"),
):
    QUERIES[_name] = lambda spark, sf, f=_accessor: sales(spark, sf).select(
        "row_index", f(F.col("amount")).alias("result"))
    ORACLES[_name] = SALES_WITH + f"SELECT row_index, {_sql} AS result FROM cells"

QUERIES["flatten_normalized"] = lambda spark, sf: cells.flatten_normalized(sales(spark, sf))
ORACLES["flatten_normalized"] = SALES_WITH + (
    "SELECT row_index, customer, status, order_date, amount, weight, note FROM cells"
)
QUERIES["flatten_original"] = lambda spark, sf: cells.flatten_original(sales(spark, sf))
ORACLES["flatten_original"] = with_("fx_sales") + "SELECT * FROM fx_sales"

QUERIES["preview_value"] = lambda spark, sf: sales(spark, sf).select(
    "row_index", cells.preview_value(F.col("note")).alias("note"),
    cells.preview_value(F.col("amount")).alias("amount"))
ORACLES["preview_value"] = SALES_WITH + (
    "SELECT row_index, coalesce(nullif(note_original,''), note) AS note, amount_original AS amount FROM cells"
)

column_query(
    "date_part_bucket", "orders", "o_orderkey",
    lambda: {p: dates.date_part_bucket(F.col("o_orderdate").cast("date").cast("string"), p)
             for p in ("month", "quarter", "year")},
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
 strftime(o_orderdate, '%Y') || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
 strftime(o_orderdate, '%Y') AS year FROM orders""",
    is_base=True,
)

QUERIES["row_to_text"] = lambda spark, sf: sales(spark, sf).select(
    "row_index", cells.table_row_text(sales(spark, sf)).alias("text"))
ORACLES["row_to_text"] = SALES_WITH + """
SELECT row_index, concat_ws(' | ', 'customer: ' || customer, 'status: ' || status,
 'order_date: ' || order_date, 'amount: ' || amount, 'weight: ' || weight, 'note: ' || note) AS text FROM cells"""

column_query(
    "stem_tokens", "documents", "doc_id",
    lambda: {"tokens": F.concat_ws(" ", text.stem_tokens(F.col("text")))},
    f"SELECT doc_id, coalesce(array_to_string({R.stems('text')}, ' '), '') AS tokens FROM documents",
    is_base=True,
)
column_query(
    "contains_phrase", "documents", "doc_id",
    lambda: {"phrase": text.normalize_phrase(F.col("text")),
             "hit": text.contains_phrase(text.normalize_phrase(F.col("text")), F.lit("the")),
             "source_hit": text.contains_phrase(text.normalize_phrase(F.col("text")), F.col("lang"))},
    f"SELECT doc_id, {R.phrase('text')} AS phrase, {R.contains_phrase(R.phrase('text'), chr(39) + 'the' + chr(39))} AS hit, "
    f"{R.contains_phrase(R.phrase('text'), 'lang')} AS source_hit FROM documents",
    is_base=True,
)
column_query(
    "extract_keywords", "documents", "doc_id",
    lambda: {"keywords": F.concat_ws(" ", text.extract_keywords(F.col("text")))},
    f"SELECT doc_id, coalesce(array_to_string({R.keywords('text')}, ' '), '') AS keywords FROM documents",
    is_base=True,
)
column_query(
    "format_number_display", "orders", "o_orderkey",
    lambda: {"price": numbers.format_number_display(F.col("o_totalprice")),
             "key": numbers.format_number_display(F.col("o_orderkey").cast("double"))},
    """SELECT o_orderkey, CASE WHEN abs(o_totalprice - round(o_totalprice)) < 1e-9 THEN format('{:,}', CAST(round(o_totalprice) AS BIGINT))
 ELSE format('{:,.2f}', o_totalprice) END AS price, format('{:,}', o_orderkey) AS key FROM orders""",
    is_base=True,
)
QUERIES["format_measure_display"] = lambda spark, sf: sales(spark, sf).select(
    "row_index",
    numbers.format_measure_display(F.col("amount.number"), F.col("amount.currency"), F.lit(None)).alias("amount"),
    numbers.format_measure_display(F.floor("weight.number").cast("double"), F.lit(None), F.col("weight.unit")).alias("weight"))
ORACLES["format_measure_display"] = SALES_WITH + """
SELECT row_index, CASE WHEN amount_number IS NULL THEN NULL
 WHEN amount_currency IS NULL THEN CASE WHEN amount_number = floor(amount_number) THEN CAST(CAST(amount_number AS BIGINT) AS VARCHAR) ELSE CAST(amount_number AS VARCHAR) END
 ELSE (CASE amount_currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' END) || printf('%.2f', amount_number) END AS amount,
 CAST(CAST(floor(weight_number) AS BIGINT) AS VARCHAR) || ' ' || weight_unit AS weight FROM cells"""
