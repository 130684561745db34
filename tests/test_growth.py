"""What keeps work in proportion to the tables: plans, passes and whole jobs."""

import re
import unicodedata

from pyspark.sql import functions as F

from checks import filters as filter_checks, fixtures
from tabulith.functions import cells, numbers, text
from tabulith.operators import inference, paging


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_are_counted_by_one_place_per_row(spark):
    """Was an aggregate per range, each comparing every row with every bound."""
    rows = spark.createDataFrame([(x,) for x in (None, 1.0, 2.0, 2.5, 3.0, float("nan"))], "__key0 double")
    bounds = [2.0, 3.0]
    for down in (False, True):
        found = paging._range_counts(rows, paging._place(paging.Key(F.col("__key0"), down), "__key0", bounds))
        assert dict(map(tuple, found.collect())) == {p: 1 for p in range(1, 7)}
    many = [float(i) for i in range(paging.RANGES)]
    counted = plan(paging._range_counts(rows, paging._place(paging.Key(F.col("__key0")), "__key0", many)))
    assert counted.count("63.0") <= 6, counted


def test_deep_page_over_equal_keys_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(paging, "NEAR", 10)
    monkeypatch.setattr(paging, "SAMPLE", 50)
    data = [(i, None if i % 7 == 0 else float(i % 5), "x" * (i % 3)) for i in range(400)]
    rows = spark.createDataFrame(data, "row_index long, k double, t string")
    for down in (False, True):
        keys = [paging.Key(F.col("k"), down, down), paging.Key(F.col("t"), down, down), paging.Key(F.col("row_index"))]
        page = [r[0] for r in paging.page_of(rows, keys, 25, 180).collect()]
        order = [k.order(n) for k, n in zip(keys, ("k", "t", "row_index"))]
        assert page == [r[0] for r in rows.orderBy(*order).collect()][180:205]


def test_rows_by_indices_serves_every_request(spark):
    """Was seven fixed indices at any size of the table."""
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "row_index long, v string")
    asked = spark.createDataFrame([("a", [3, 1, 3]), ("b", [9])], "request_id string, indices array<bigint>")
    found = paging.rows_by_indices(rows, asked).select("request_id", "position", "row_index", "v", "found")
    assert sorted(map(tuple, found.collect())) == [
        ("a", 0, 3, "v3", True), ("a", 1, 1, "v1", True), ("a", 2, 3, "v3", True), ("b", 0, 9, None, False)]
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    n = orders.count() + orders.select("o_custkey").distinct().count()
    assert filter_checks.QUERIES["rows_by_indices"](spark, sf).count() == n


TEXTS = [
    None, "", " ", "5", " 5 ", "5.", ".5", "-.5", "+5", "--5", "5-3", "1-2", "-", "1.2.3", "1,200.50", "(5k)", "(5", "5)", "(1)\n(2)",
    "3 kg", "kg 3", "1.2.3 kg", "3 m2", "abc", "a.b5", "5-LOW", "4-NOT SPECIFIED", "$ 7", "$x", "7 USD", "USD", "usd9", "9 rub", "12 usda",
    "2024-01-31", "31/01/2024", "01-31-24", "20240131", "2024-W05-3", "2024-W05", "2024/1/2 10:30", "2024-01-31T10:00:00Z",
    "\u2003 8\u00a0", "x\ny", "n/a", "a  b", "9" * 400, "5m", "5 mi", "1\n", "é5"]


def test_has_number_is_what_parse_number_reads(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    both = rows.select("t", numbers.has_number(F.col("t")).alias("has"), numbers.parse_number(F.col("t")).alias("n"))
    assert [r["t"] for r in both.collect() if bool(r["has"]) != (r["n"] is not None)] == []
    strict = rows.select(numbers.sql_number(F.col("t")).alias("new"), F.nullif(
        F.regexp_replace("t", r"[^0-9.\-]", ""), F.lit("")).try_cast("double").alias("old"))
    assert [r for r in strict.collect() if r["new"] != r["old"]] == []


def test_a_query_works_out_only_the_fields_it_reads(spark):
    """Every field of every cell was parsed for the types alone."""
    raw = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "row_index long, a string, b string")
    table = cells.normalize_row(raw, ["a", "b"], money_columns={"a"}, measurement_columns={"a", "b"})
    types = plan(table.select("a.type", F.col("b.normalized").alias("b")))
    assert "currency" not in types and "USD" not in types, types


def test_types_and_kinds_of_stored_cells_follow_the_plain_rules(spark):
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "row_index long, a string")
    table = cells.normalize_row(raw, ["a"], measurement_columns={"a"})
    for c in (table, table.withColumn("a", F.col("a").withField("type", F.lit(None).cast("string")))):
        assert inference.verdicts(inference.infer_column_kinds(c)) == {"a": "number"}
        assert inference.verdicts(inference.infer_types_stored(c))["a"] in ("number", "date")


def test_large_tables_are_stored_in_parts_of_bounded_size(spark, monkeypatch):
    """The number of parts was that of the cores at any size, and the rows were parsed twice."""
    monkeypatch.setattr(fixtures, "PART_ROWS", 50)
    rows = fixtures.raw_rows(spark, "/root/testdata/sf0.001", "fx_sales")
    assert rows.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, rows.count() // 50)


def test_texts_with_currency_signs_stay_out_of_python(spark):
    """A euro sign sent the whole table through Python, for a form that it has already."""
    stable = re.compile(rf"[{re.sub(r'x{([0-9A-F]+)}', r'u\1', text.NFC_STABLE)}]")
    later = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            later.add(chr(int(parts[1], 16)))
    for c in filter(stable.match, map(chr, range(0x10000))):
        assert unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) and c not in later, hex(ord(c))
    rows = spark.createDataFrame([(0, "€ 5", "é"), (1, "Ж 中", "x")], "row_index long, a string, b string")
    assert inference.infer_hints(rows, ["a", "b"])["unicode_columns"] == {"b"}


def test_shortcuts_of_the_parse_give_what_the_plain_rules_give(spark):
    """Most values took every pattern there is: numbers and words in plain spelling need few."""
    more = ["5\n", "5 ", "a  b", " - ", "NaN ", "\tx", "0.00001 g", "-0.00001 kg", "1,5 lb", "2.50 oz", "+5", "~", "€", "5é"]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + more)], "row_index long, a string")
    a = F.col("a")
    same = [
        (text.strip_column(a), text.strip(a)),
        (text.normalize_trimmed(text.strip(a)), text.normalize_text_value(a)),
        (numbers.parse_number(text.strip(a), stripped=True), numbers._loose_number(text.strip(a))),
        (numbers.sql_number(a), numbers._strict_digits(a)),
        (text.starts_with_digit(a), a.rlike("^[0-9]")),
        (text.is_nfc_suspect(a), a.rlike(text.NFC_SUSPECT)),
    ]
    found = raw.select("a", *[x.eqNullSafe(y).alias(f"s{i}") for i, (x, y) in enumerate(same)])
    assert [r for r in found.collect() if not all(r[1:])] == []
    value = spark.createDataFrame([(x,) for x in (0.0, -0.00001, 0.00005, 1.25, -3.14159, 1e20, 12345.67895, float("inf"))], "x double")
    shown = numbers.format_measurement(F.col("x"), F.lit("m"))
    plain = F.concat(F.when((F.col("x") == F.floor("x")) & (F.abs("x") < 1e15), F.col("x").try_cast("bigint").cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.4f", F.col("x")), r"\.?0+$", "")), F.lit(" m"))
    assert [r for r in value.select("x", shown.alias("s"), plain.alias("p")).collect() if r["s"] != r["p"]] == []
