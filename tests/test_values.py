"""Value rules: tables of cases, and random texts against a plain Python reading of the rules."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tabulith.functions import cells, dates, numbers, text


def apply(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


NUMBERS = {
    "1,234": 1234.0, "$1,234.56": 1234.56, "(500)": -500.0, "(5k)": -5000.0, "1.5m": 1.5e6, "2B": 2e9,
    "12%": 12.0, "+3": 3.0, "Route 66": 66.0, "5 lb": 5e9, "5-LOW": None, "1-2": None, "5.": None,
    ".5": 0.5, "n/a": None, "-": None, "": None, None: None, "  7 ": 7.0, "-0.25": -0.25,
}


def test_parse_number(spark):
    assert apply(spark, list(NUMBERS), numbers.parse_number) == list(NUMBERS.values())


def test_sql_number(spark):
    cases = {"(5)": 5.0, "5k": 5.0, "$1,200.50": 1200.5, "1-2": None, "x": None, "-3": -3.0}
    assert apply(spark, list(cases), numbers.sql_number) == list(cases.values())


def test_money(spark):
    got = apply(spark, ["$1,234.56", "€99", "₹ 5k", "99", "$x"], numbers.parse_money)
    assert [tuple(g) if g else None for g in got] == [
        ("1234.56", 1234.56, "USD"), ("99.00", 99.0, "EUR"), ("5000.00", 5000.0, "INR"), None, None]
    looks = ["$100", "€ 1,000", "USD 100", "100 usd", "1,000 EUR", "100", "5 kg", "USD", "₩ 9", ""]
    assert apply(spark, looks, numbers.looks_like_money) == [True] * 5 + [False] * 3 + [True, False]


def test_measurement(spark):
    got = apply(spark, ["100 kg", "1,000 g", "kg 5", "32 °F", "10 sq ft", "1.5 sq M", "5kg", "1.2.3 kg",
                        "9 parsecs"], numbers.parse_measurement)
    assert [(g["normalized"], round(g["number"], 6), g["unit"]) if g else None for g in got] == [
        ("100 kg", 100.0, "kg"), ("1 kg", 1.0, "kg"), ("5 kg", 5.0, "kg"), ("0 °C", 0.0, "°C"),
        ("10 sq ft", 10.0, "sq ft"), ("1.5 sq M", 1.5, "sq M"), None, None, None]


DATES = {
    "2024-01-31": "2024-01-31", "2024/1/5 10:30": "2024-01-05", "31/01/2024": "2024-01-31",
    "01/15/2022": "2022-01-15", "1-2-22": "2022-02-01", "5/6/199": "0199-06-05", "05.06.0099": "2099-06-05",
    "20240131": "2024-01-31", "2024-W05-3": "2024-01-31", "2024W05": "2024-01-29", "2020-W54-1": None,
    "2024-01-31T23:30:00-05:00": "2024-02-01", "2024-01-31T10:30:00.123456Z": "2024-01-31",
    "20240131T103000Z": "2024-01-31", "2024-01-31 10": "2024-01-31", "2024-02-30": None, "0000-01-01": None,
    "99/99/2020": None, "12345678": None, "x": None, "": None, None: None,
}


def test_parse_date(spark):
    got = apply(spark, list(DATES), dates.parse_date)
    assert [g["iso_date"] if g else None for g in got] == list(DATES.values())


def test_parse_date_with_format(spark):
    shown = lambda hint: [
        g["iso_date"] if g else None
        for g in apply(spark, ["01/02/2022", "01/15/2022", "15/01/2022"], lambda c: dates.parse_date_with_format(c, hint))
    ]
    assert shown(None) == shown("dmy") == ["2022-02-01", None, "2022-01-15"]
    assert shown("mdy") == ["2022-01-02", "2022-01-15", None]


def test_epoch_keeps_the_clock_only_of_timestamps(spark):
    got = apply(spark, ["2024-01-31 10:30", "2024-01-31T10:30:00.5Z"], dates.parse_date)
    assert [g["epoch_seconds"] for g in got] == [1706659200, 1706697000]


def test_headers_and_text(spark):
    heads = {"Sales Person": "sales_person", "HTTPServerName": "http_server_name", "firstName": "first_name",
             "  Total ($) ": "total", "Größe": "größe", "": "", None: ""}
    assert apply(spark, list(heads), text.normalize_header) == list(heads.values())
    assert apply(spark, ["ｆｕｌｌ Ｗidth"], lambda c: text.normalize_header(c, True)) == ["full_width"]
    values = {" a  b\t": "a b", "N/A": None, "-": None, "": None, "NaN": None, "none!": "none!"}
    assert apply(spark, list(values), text.normalize_text_value) == list(values.values())
    assert apply(spark, ["été"], lambda c: text.normalize_text_value(c, True)) == ["été"]


def test_tokens(spark):
    words = ["cities boxes running shipped goes dies classes", "Don't stop", None]
    assert apply(spark, words, text.stem_tokens) == [
        ["city", "box", "runn", "shipp", "goe", "die", "class"], ["don", "t", "stop"], None]
    assert apply(spark, ["What is the total_sum of x, total?"], text.extract_keywords) == [["total_sum", "total"]]
    hay = lambda c: text.contains_phrase(text.normalize_phrase(c), F.lit("new york"))
    assert apply(spark, ["In New  York!", "new yorker", ""], hay) == [True, False, False]


def plain_number(s):
    raw = s.strip()
    negative = raw.startswith("(") and raw.endswith(")")
    inner = re.sub(r"[$€£¥₹,\s]", "", raw[1:-1] if negative else raw)
    scale = {"k": 1e3, "m": 1e6, "b": 1e9}.get(inner[-1:].lower(), 1.0)
    digits = re.sub(r"[^0-9.+-]", "", inner)
    if not re.fullmatch(r"[-+]?\d*\.?\d+", digits):
        return None
    return float(digits) * scale * (-1.0 if negative else 1.0)


def plain_date(s):
    t = s.strip()
    if m := re.fullmatch(r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})", t):
        y, mo, d = map(int, m.groups())
    elif m := re.fullmatch(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})", t):
        a, b, y = map(int, m.groups())
        y += 2000 if y < 100 else 0
        d, mo = (b, a) if a <= 12 < b else (a, b)
    else:
        return None
    try:
        return date(y, mo, d).isoformat()
    except ValueError:
        return None


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("0123456789.,-+()$€% kmbKMBx") for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    assert apply(spark, texts, numbers.parse_number) == [plain_number(t) for t in texts]
    part = lambda n: str(rng.randint(0, n)).zfill(rng.choice([1, 2]))
    days = [rng.choice(["{0}/{1}/{2}", "{2}-{1}-{0}", " {0}.{1}.{2} ", "{0}-{1}-{2}"]).format(
        part(33), part(14), rng.choice([rng.randint(1, 99), rng.randint(100, 2100), f"{rng.randint(1990, 2030)}"]))
        for _ in range(3000)]
    days = [d for d in days if not re.match(r"\s*\d{1,3}[-/.]\d+[-/.]\d{1,2}\s*$", d) or re.match(r"\s*\d{1,2}[-/.]", d)]
    got = apply(spark, days, dates.parse_date)
    assert [g["iso_date"] if g else None for g in got] == [plain_date(d) for d in days]


def test_row_json(spark):
    docs = ['{"a":1,"b":{"o":"x","n":"y"},"c":{"original":"p","normalized":null}}', '"{\\"a\\": \\"z\\"}"', "bad", None]
    df = spark.createDataFrame([(d,) for d in docs], "v string")
    got = [tuple(r) for r in df.select(*cells.decode_row_json(F.col("v"), ["a", "b", "c"])).collect()]
    assert got == [("1", "y", None), ("z", None, None), (None,) * 3, (None,) * 3]


def test_display(spark):
    shown = lambda v: spark.range(1).select(numbers.format_number_display(F.lit(v))).first()[0]
    assert [shown(1234.0), shown(1234.5), shown(-0.256), shown(1e6)] == ["1,234", "1,234.50", "-0.26", "1,000,000"]
    cell = lambda *a: spark.range(1).select(numbers.format_measure_display(*map(F.lit, a))).first()[0]
    assert [cell(5.0, "CAD", None), cell(5.0, "XXX", None), cell(2.5, None, "kg"), cell(3.0, None, "kg")] == [
        "C$5.00", "XXX 5.00", "2.5 kg", "3 kg"]
