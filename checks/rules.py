"""The value rules once more, as DuckDB SQL, for the oracle queries."""

from __future__ import annotations

from tabulith import fixed

NULLS = "('null','none','na','n/a','nan','-','')"
NUM = r"'^[-+]?[0-9]*\.?[0-9]+$'"
ISO = r"'^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$'"
PAIR = r"'^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g')")


def text(x: str) -> str:
    c = collapse(x)
    return f"CASE WHEN lower({c}) IN {NULLS} THEN NULL ELSE {c} END"


def digits(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9.+-]', '', 'g')"
    return f"(CASE WHEN regexp_matches({d}, {NUM}) THEN TRY_CAST({d} AS DOUBLE) END)"


def number(x: str) -> str:
    s = strip(x)
    inner = rf"regexp_replace({s}, '^\((.*)\)$', '\1', 's')"
    letter = rf"lower(regexp_extract({inner}, '([kmbKMB])[$€£¥₹,\s]*$', 1))"
    scale = f"CASE {letter} WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1e0 END"
    sign = rf"CASE WHEN regexp_matches({s}, '^\(.*\)$', 's') THEN -1e0 ELSE 1e0 END"
    return f"({digits(x)} * ({scale}) * ({sign}))"


def sql_number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_replace(trim({x}), '[^0-9.\\-]', '', 'g'), '') AS DOUBLE)"


def currency(x: str) -> str:
    pairs = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR")]
    return "CASE " + " ".join(f"WHEN contains({x},'{s}') THEN '{c}'" for s, c in pairs) + " END"


def money_text(n: str) -> str:
    return f"printf('%.2f', {n})"


def looks_like_money(x: str) -> str:
    codes = "USD|EUR|GBP|JPY|CAD|AUD|CHF|CNY|INR|KRW|THB|TRY|RUB"
    s = strip(x)
    return (
        f"coalesce((regexp_matches({s}, '^([$€£¥₩₹฿₺₽]|(?i:{codes}))') "
        f"OR regexp_matches({s}, '(?i:{codes})$')) AND {digits(x)} IS NOT NULL, false)"
    )


UNIT = "|".join(sorted(fixed.UNITS, key=lambda u: (-len(u), u)))  # longer ones first
QTY = r"-?[0-9]+(?:[.,][0-9]+)*"
MEASURE = rf"'(?i)^(?:{QTY}\s+({UNIT})|({UNIT})\s+{QTY})$'"
FACTORS = (
    "WHEN 'kg' THEN {v} WHEN 'g' THEN {v}*0.001::DOUBLE WHEN 'mg' THEN {v}*0.000001::DOUBLE "
    "WHEN 'lb' THEN {v}*0.453592::DOUBLE WHEN 'km' THEN {v}*1000e0 WHEN 'cm' THEN {v}*0.01::DOUBLE"
)


def measure_unit(x: str) -> str:
    s = strip(x)
    return (
        f"CASE WHEN regexp_matches({s}, {MEASURE}) "
        rf"THEN lower(regexp_replace({s}, {MEASURE}, '\1\2')) END"
    )


def measure_number(x: str) -> str:
    """Standardised number, for the mass and length units the fixtures use."""
    return f"CASE {measure_unit(x)} {FACTORS.format(v=digits(x))} END"


def measure_standard(x: str) -> str:
    u = measure_unit(x)
    return (
        f"CASE WHEN {u} IN ('kg','g','mg','lb') THEN 'kg' WHEN {u} IN ('km','cm') THEN 'm' END"
    )


def measure_text(n: str, u: str) -> str:
    return (
        f"CASE WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) "
        rf"ELSE regexp_replace(printf('%.4f', {n}), '\.?0+$', '') END || ' ' || {u}"
    )


def date(x: str, order: str = "dmy") -> str:
    s = strip(x)
    part = lambda i: f"CAST(nullif(regexp_extract({s}, {PAIR}, {i}),'') AS INT)"
    a, b, y = part(1), part(2), part(3)
    year = f"(CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END)"
    if order == "mdy":
        day, month = b, a
    elif order == "swap":
        flip = f"({a} <= 12 AND {b} > 12)"
        day, month = f"(CASE WHEN {flip} THEN {b} ELSE {a} END)", f"(CASE WHEN {flip} THEN {a} ELSE {b} END)"
    else:
        day, month = a, b
    return (
        rf"CASE WHEN regexp_matches({s}, {ISO}) THEN TRY_CAST(regexp_replace({s}, {ISO}, '\1-\2-\3') AS DATE) "
        f"WHEN regexp_matches({s}, {PAIR}) THEN TRY_CAST(printf('%04d-%02d-%02d', {year}, {month}, {day}) AS DATE) END"
    )


def epoch(d: str) -> str:
    return f"CAST(epoch({d}) AS BIGINT)"


def phrase(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x},'')), '[^a-z0-9% ]+', ' ', 'g'), ' +', ' ', 'g'))"


def contains_phrase(h: str, n: str) -> str:
    return f"({h} <> '' AND {n} <> '' AND contains(' ' || {h} || ' ', ' ' || {n} || ' '))"


STOP = fixed.STOP_WORDS
STOP_LIST = "[" + ",".join(f"'{w}'" for w in STOP) + "]"


def stems(x: str) -> str:
    """List of stemmed tokens."""
    tokens = f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
    ies = r"CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t)-3) || 'y' ELSE t END"
    cut = (
        "CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, length(t)-3) "
        "WHEN t LIKE '%ed' AND length(t) > 4 THEN left(t, length(t)-2) "
        "WHEN t LIKE '%es' AND length(t) > 4 THEN left(t, length(t)-2) "
        "WHEN t LIKE '%s' AND length(t) > 3 THEN left(t, length(t)-1) ELSE t END"
    )
    return f"list_transform(list_transform({tokens}, lambda t: {ies}), lambda t: {cut})"


def keywords(x: str) -> str:
    cleaned = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g')"
    return (
        rf"list_filter(regexp_split_to_array({cleaned}, '\s+'), "
        f"lambda t: length(t) >= 2 AND NOT list_contains({STOP_LIST}, t))"
    )


# One row per sale with every cell field the oracle queries read.
_d, _n, _w = date("order_date"), number("amount"), measure_number("weight")
_wu = measure_standard("weight")
SALES_CELLS = f"""
SELECT row_index, customer AS customer_original, {text('customer')} AS customer,
 {text('status')} AS status, status AS status_original,
 order_date AS order_date_original, CAST({_d} AS VARCHAR) AS order_date,
 {epoch(_d)} AS order_date_epoch,
 amount AS amount_original, CASE WHEN {_n} IS NOT NULL THEN {money_text(_n)} END AS amount,
 {_n} AS amount_number, {currency('amount')} AS amount_currency,
 weight AS weight_original, {measure_text(_w, _wu)} AS weight, {_w} AS weight_number,
 {_wu} AS weight_unit, note AS note_original, {text('note')} AS note
FROM fx_sales"""

PEOPLE_CELLS = f"""
SELECT row_index, {text('name')} AS name, {text('nation')} AS nation, {text('region')} AS region,
 {text('segment')} AS segment, {text('balance')} AS balance, {number('balance')} AS balance_number
FROM fx_people"""
