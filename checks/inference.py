"""Type inference. The samples (first n rows) are part of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import rules as R
from checks.fixtures import PEOPLE, SALES, fixture, hints, people, raw_rows, sales, with_
from tabulith.operators import inference
from tabulith.session import spread

SALES_WITH = with_("fx_sales", cells=R.SALES_CELLS)
PEOPLE_WITH = with_("fx_people", cells=R.PEOPLE_CELLS)


def per_column(columns, expression: str, source: str) -> str:
    """UNION ALL of one aggregate row per column; {c} stands for the column."""
    return " UNION ALL ".join(
        "SELECT '%s' AS \"column\", %s FROM %s" % (c, expression.format(c=c), source.format(c=c))
        for c in columns
    )


QUERIES = {
    "infer_date_formats": lambda s, sf: inference.infer_date_formats(
        raw_rows(s, sf, "fx_sales"), SALES),
    "infer_money_columns": lambda s, sf: inference.infer_money_columns(
        fixture(s, sf, "fx_sales"), SALES),
    "infer_measurement_columns": lambda s, sf: inference.infer_measurement_columns(
        fixture(s, sf, "fx_sales"), SALES),
    "infer_context_types": lambda s, sf: inference.infer_context_types(
        spread(fixture(s, sf, "fx_sales")), SALES, **hints(s, sf, "fx_sales", SALES)),
    "infer_types_stored": lambda s, sf: inference.infer_types_stored(sales(s, sf)),
    "infer_column_kinds": lambda s, sf: inference.infer_column_kinds(sales(s, sf)),
    "detect_numeric_columns": lambda s, sf: inference.detect_numeric_columns(people(s, sf)),
    "infer_sort_kind": lambda s, sf: inference.infer_sort_kind(
        fixture(s, sf, "fx_sales"), SALES),
    "detect_date_columns": lambda s, sf: inference.detect_date_columns(
        fixture(s, sf, "fx_sales"), SALES),
    "column_currency": lambda s, sf: inference.column_currency(sales(s, sf)),
    "column_unit": lambda s, sf: inference.column_unit(sales(s, sf)),
}

_part = lambda i: f"TRY_CAST(nullif(regexp_extract({R.strip('{c}')}, {R.PAIR}, {i}),'') AS INT)".replace("{", "{{").replace("}", "}}").replace("{{c}}", "{c}")  # noqa: E731,E501
_iso, _pair = (x.replace("{", "{{").replace("}", "}}") for x in (R.ISO, R.PAIR))
_stripped = R.strip("{c}")
_like = (f"(SELECT {_part(1)} AS a, {_part(2)} AS b FROM fx_sales WHERE regexp_matches({_stripped}, {_iso}) "
         f"OR regexp_matches({_stripped}, {_pair}))")


def _votes(columns, votes: dict[str, str], priority: list[str], source: str, out: str,
           empty: str | None) -> str:
    """Winner of counted votes per column; later names win ties."""
    counts = ", ".join(f"coalesce(sum({v}), 0) AS n_{t}" for t, v in votes.items())
    union = per_column(columns, counts, source)
    pairs = ", ".join(f"{{'n': n_{t}, 'p': {i}, 't': '{t}'}}" for i, t in enumerate(priority))
    winner = f"(list_reverse_sort([{pairs}])[1]).t"
    if empty:
        total = " + ".join(f"n_{t}" for t in priority)
        winner = f"CASE WHEN {total} = 0 THEN '{empty}' ELSE {winner} END"
    return f"SELECT \"column\", {winner} AS {out} FROM ({union})"


# Type of each cell of the sales table, one column per cell.
_TYPED = """SELECT row_index, CASE WHEN customer IS NOT NULL THEN 'number' END AS customer,
 CASE WHEN status IS NOT NULL THEN 'text' END AS status,
 CASE WHEN order_date IS NOT NULL THEN 'date' END AS order_date,
 CASE WHEN amount_number IS NOT NULL THEN 'money' END AS amount,
 CASE WHEN weight_number IS NOT NULL THEN 'measurement' END AS weight,
 CASE WHEN note IS NOT NULL THEN 'text' END AS note FROM cells"""
_TYPES = ["text", "number", "date", "measurement", "money"]
_TYPE_VOTES = {t: f"CASE WHEN {{c}} = '{t}' THEN 1 ELSE 0 END" for t in _TYPES}
_KIND_VOTES = {
    "date": "CASE WHEN {c} = 'date' THEN 3 ELSE 0 END",
    "number": "CASE WHEN {c} IN ('number','money') THEN 3 WHEN {c} = 'measurement' THEN 3 ELSE 0 END",
    "text": "CASE WHEN {c} = 'text' THEN 1 ELSE 0 END",
}
_SORT_NUM = R.digits(r"regexp_replace(" + _stripped + r", '\((.*)\)', '-\1')").replace("{NUM}", R.NUM)
_SORT_DATE = (f"(regexp_matches({_stripped}, {_iso}) OR regexp_matches({_stripped}, {_pair}))")
_FILLED = f"sum(CASE WHEN coalesce({_stripped},'') <> '' THEN 1 ELSE 0 END)"


def _sort_sql() -> str:
    parts = []
    for c in SALES:
        s = R.strip(c)
        num = R.digits(rf"regexp_replace({s}, '\((.*)\)', '-\1')")
        date = f"(regexp_matches({s}, {R.ISO}) OR regexp_matches({s}, {R.PAIR}))"
        parts.append(
            f"SELECT '{c}' AS c, sum(CASE WHEN coalesce({s},'') <> '' THEN 1 ELSE 0 END) AS filled, "
            f"sum(CASE WHEN {num} IS NOT NULL THEN 1 ELSE 0 END) AS nums, "
            f"sum(CASE WHEN {num} IS NULL AND {date} THEN 1 ELSE 0 END) AS days, "
            f"sum(CASE WHEN {date} THEN 1 ELSE 0 END) AS all_days "
            "FROM fx_sales"
        )
    return " UNION ALL ".join(parts)


ORACLES = {
    "infer_date_formats": with_("fx_sales") + per_column(
        SALES,
        "CASE WHEN count(*) = 0 THEN NULL WHEN coalesce(bool_or(a > 12), false) AND coalesce(bool_or(b > 12), false) THEN NULL "
        "WHEN coalesce(bool_or(b > 12), false) THEN 'mdy' ELSE 'dmy' END AS date_format", _like),
    "infer_money_columns": with_("fx_sales") + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", bool_or({R.looks_like_money(c)}) AS is_money FROM fx_sales"
        for c in SALES) + ")",
    "infer_measurement_columns": with_("fx_sales") + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(count(*) FILTER ({R.measure_unit(c)} IS NOT NULL)::DOUBLE "
        f"/ nullif(count(*) FILTER (coalesce({R.strip(c)}, '') <> ''), 0) >= 0.8, false) AS is_measurement "
        "FROM fx_sales" for c in SALES) + ")",
    "infer_context_types": with_("fx_sales", cells=R.SALES_CELLS, typed=_TYPED) + _votes(
        SALES, _TYPE_VOTES, _TYPES, "typed", "inferred_type", "unknown"),
    "infer_types_stored": with_("fx_sales", cells=R.SALES_CELLS, typed=_TYPED) + _votes(
        SALES, _TYPE_VOTES, _TYPES, "typed", "inferred_type", "unknown"),
    # A money or measured cell's text is itself a number to the loose rule, hence 3 votes.
    "infer_column_kinds": with_("fx_sales", cells=R.SALES_CELLS, typed=_TYPED) + _votes(
        SALES, _KIND_VOTES, ["date", "number", "text"], "typed", "kind", None),
    "detect_numeric_columns": PEOPLE_WITH + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({R.number(c)}) >= greatest(2, floor(count(*) * 0.4)) AS is_numeric "
        "FROM cells" for c in PEOPLE) + ")",
    "infer_sort_kind": with_("fx_sales") + "SELECT c AS \"column\", CASE WHEN nums / nullif(filled,0)::DOUBLE >= 0.6 THEN 'number' "
    f"WHEN days / nullif(filled,0)::DOUBLE >= 0.6 THEN 'date' ELSE 'text' END AS sort_kind FROM ({_sort_sql()})",
    "detect_date_columns": with_("fx_sales") + "SELECT c AS \"column\", coalesce(all_days / nullif(filled,0)::DOUBLE >= 0.6, false) AS is_date "
    f"FROM ({_sort_sql()})",
    "column_currency": SALES_WITH + """SELECT c AS "column", CASE WHEN c = 'amount' THEN
 (SELECT amount_currency FROM cells WHERE amount_number IS NOT NULL AND amount_currency IS NOT NULL ORDER BY row_index LIMIT 1) END AS currency
 FROM (SELECT unnest(['customer','status','order_date','amount','weight','note']) AS c)""",
    "column_unit": SALES_WITH + """SELECT c AS "column", CASE WHEN c = 'weight' THEN
 (SELECT weight_unit FROM cells WHERE weight_number IS NOT NULL ORDER BY row_index LIMIT 1) END AS unit
 FROM (SELECT unnest(['customer','status','order_date','amount','weight','note']) AS c)""",
}
