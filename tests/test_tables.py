"""Small tables through ingest, queries, search and edits."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.functions import cells
from tabulith.operators import (
    aggregation, edits, filters, headers, inference, paging, questions, vectors,
)
from tabulith.plans import ingest, query
from tabulith.sources import cellstore, delimited
from tabulith.streaming.ingest import index_stream, latest_vectors


def table(spark, columns, rows):
    width = len(columns)
    padded = [(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)]
    schema = "row_index bigint, " + ", ".join(f"`{c}` string" for c in columns)
    return ingest.to_cells(spark.createDataFrame(padded, schema))


def indices(df):
    return [r["row_index"] for r in df.orderBy("row_index").collect()]


@pytest.fixture(scope="module")
def products(spark):
    return table(spark, ["product", "revenue", "region", "date"], [
        ("A", "100", "North", "2024-01-05"), ("B", "250", "South", "2024-01-20"), ("C", "", "North", "2024-02-01"),
        ("D", "75", "West", "2024-02-10"), ("E", "300", "South", "2024-03-01"), ("F", "50", "North", "2024-03-15")])


def where(column, operator, value=None, joiner="AND"):
    return {"column": column, "operator": operator, "value": value, "logical_operator": joiner}


@pytest.mark.parametrize("conditions, expected", [
    ([where("region", "=", "North")], [0, 2, 5]),
    ([where("Region", "!=", "North")], [1, 3, 4]),
    ([where("revenue", ">", "75")], [0, 1, 4]),
    ([where("revenue", "between", "75,100")], [0, 3]),
    ([where("revenue", "BETWEEN", "75 AND 100")], [0, 3]),
    ([where("date", ">=", "2024-02-10")], [3, 4, 5]),
    ([where("date", "between", "2024-01-10,2024-02-05")], [1, 2]),
    ([where("revenue", "IS NULL")], [2]),
    ([where("revenue", "not null")], [0, 1, 3, 4, 5]),
    ([where("region", "like", "%th")], [0, 1, 2, 4, 5]),
    ([where("region", "not like", "n%")], [0, 1, 2, 3, 4, 5]),
    ([where("region", "contains", "OUT")], [1, 4]),
    ([where("region", "in", " South ,West,")], [1, 3, 4]),
    ([where("region", "=", "West"), where("region", "=", "South", joiner="or"), where("revenue", "<", "260")], [1, 3]),
])
def test_filters(products, conditions, expected):
    assert indices(filters.filter_rows(products, conditions)) == expected


@pytest.mark.parametrize("condition", [
    where("nope", "=", "x"), where("region", "IN", " , "), where("revenue", "BETWEEN", "3"), where("revenue", ">", "abc"),
    where("region", "="), where("region", "~", "x")])
def test_bad_filters(products, condition):
    with pytest.raises(ValueError):
        filters.filter_rows(products, [condition])


def test_sorting_and_paging(products):
    page = paging.paginate(products, "revenue", "desc", limit=2, offset=1)
    assert [(r["row_index"], r["row_count"]) for r in page.collect()] == [(1, 6), (0, 6)]
    assert [r["row_index"] for r in paging.sort_rows(products, "revenue").collect()] == [5, 3, 0, 1, 4, 2]
    found = paging.filter_row_indices(products, [where("region", "=", "North")], 2).collect()
    assert [tuple(r) for r in found] == [(0, 3, True), (2, 3, True)]
    assert [r["row_index"] for r in paging.rows_by_indices(products, [3, 1, 3]).collect()] == [3, 1, 3]
    with pytest.raises(ValueError):
        paging.rows_by_indices(products, [99])


def test_aggregates(products):
    rows = lambda df: [tuple(r) for r in df.collect()]
    m = lambda agg, c=None: {"agg": agg, "column": c}
    assert rows(aggregation.aggregate(products, [m("sum", "revenue")], "region")) == [
        ("South", 550.0), ("North", 150.0), ("West", 75.0)]
    assert rows(aggregation.aggregate(products, [m("sum", "revenue")], "date", "month", sort_order="asc")) == [
        ("2024-02", 75.0), ("2024-01", 350.0), ("2024-03", 350.0)]
    assert rows(aggregation.aggregate(products, [m("count")], conditions=[where("region", "=", "?")])) == [(None, 0)]
    both = aggregation.aggregate(products, [m("count"), m("count")], "region", limit=1)
    assert both.columns == ["group_value", "aggregate_value", "count", "count_2"]
    with pytest.raises(ValueError):
        aggregation.aggregate(products, [m("sum")])


def test_query_modes(products):
    page = query.run_query(products, "filter", filters=[where("region", "=", "West")], columns=["Revenue"], dataset_id=4)
    assert [tuple(r) for r in page.collect()] == [(3, "75", 1, "d4_r3_region")]
    best = query.run_query(products, "aggregate", operation="max", metric_column="revenue", group_by="region", limit=1)
    assert best.first()["aggregate_value"] == 300.0
    with pytest.raises(ValueError):
        query.run_query(products, "other")


def test_type_vote(spark):
    t = table(spark, ["sale_date", "amount", "units", "weight", "empty"],
              [("01/02/2024", "$12.50", "3", "5 kg", ""), ("13/02/2024", "€7", "4", "20 g", "n/a")])
    assert inference.verdicts(inference.infer_types_stored(t)) == {
        "sale_date": "date", "amount": "money", "units": "number", "weight": "measurement", "empty": "unknown"}
    assert inference.verdicts(inference.column_currency(t))["amount"] == "USD"
    assert inference.verdicts(inference.column_unit(t))["weight"] == "kg"
    assert t.schema["sale_date"].metadata["kind"] == "date"


def test_date_formats_look_at_all_values(spark):
    """A day above 12 counts wherever it stands in its column."""
    def column(late):
        rows = [(i, "01/02/2024" if i != late else "03/25/2024", "x" if i < 700 else "04/30/2024") for i in range(1200)]
        df = spark.createDataFrame(rows, "row_index bigint, d string, e string").repartition(4)
        return inference.verdicts(inference.infer_date_formats(df, ["d", "e"]))
    assert column(499) == {"d": "mdy", "e": "mdy"}
    assert column(1199) == {"d": "mdy", "e": "mdy"}
    assert column(None) == {"d": "dmy", "e": "mdy"}


def test_files(spark, tmp_path):
    f = tmp_path / "sales.csv"
    f.write_bytes("\ufeffSales Person,Boxes Shipped,Sales Person\nAnn,\"1,200\"\n\"Bo \"\"B\"\"\",7,x,extra\n".encode())
    raw = delimited.read_delimited(spark, str(f))
    assert raw.columns == ["row_index", "sales_person", "boxes_shipped", "sales_person_2"]
    assert raw.schema["boxes_shipped"].metadata == {"original_name": "Boxes Shipped"}
    assert [tuple(r) for r in delimited.assign_row_index(raw).orderBy("row_index").collect()] == [
        (0, "Ann", "1,200", None), (1, 'Bo "B"', "7", "x")]
    (tmp_path / "plain.tsv").write_text("1\t2.5\n2\t3.5\n")
    plain = delimited.read_delimited(spark, str(tmp_path / "plain.tsv"))
    assert plain.columns == ["row_index", "col_1", "col_2"] and plain.count() == 2


def test_signatures_skip_blocks(spark, tmp_path):
    rows = [(f"name{i}", "needle in hay" if i in (705, 2301) else f"straw {i % 7}") for i in range(3000)]
    cellstore.write_cells(table(spark, ["a", "b"], rows), str(tmp_path / "c"), 1)
    cellstore.write_signatures(spark, str(tmp_path / "c"), 1, block_rows=100)
    stored, signed = cellstore.read_cells(spark, str(tmp_path / "c"), 1), cellstore.read_signatures(spark, str(tmp_path / "c"), 1)
    for text in ("NEEDLE", "name27", "straw 3", "no such thing", "ne", " Hay"):
        plain = indices(filters.search_any_cell(stored, text))
        assert indices(filters.search_any_cell(stored, text, signed)) == plain
    read = filters._rows_that_may_hold(stored, signed, "needle in")
    assert read.count() <= 0.1 * 3000 and "row_index" in str(read._jdf.queryExecution().optimizedPlan())
    before, filters.RANGES = filters.RANGES, 1  # more ranges than a condition should have
    try:
        assert indices(filters.search_any_cell(stored, "needle", signed)) == [705, 2301]
    finally:
        filters.RANGES = before


def test_pages_far_down(spark, tmp_path, monkeypatch):
    """Pages found by counting are those of the whole order, with ties, NULLs and either direction."""
    monkeypatch.setattr(paging, "NEAR", 20)
    monkeypatch.setattr(paging, "SAMPLE", 40)
    monkeypatch.setattr(paging, "RANGES", 4)
    rng = random.Random(2)
    values = [rng.choice([None, "x", "7", str(rng.randrange(40)), f"t{rng.randrange(500)}", "5" if i % 3 else "6"]) for i in range(600)]
    cellstore.write_cells(table(spark, ["v"], [(v,) for v in values]), str(tmp_path / "c"), 1)
    t = cellstore.read_cells(spark, str(tmp_path / "c"), 1)
    for order, kind, offset in (("asc", "number", 333), ("desc", "number", 580), ("asc", "text", 100), ("desc", "text", 599)):
        whole = [r.row_index for r in paging.sort_rows(t, "v", order, kind).collect()]
        page = paging.paginate(t, "v", order, kind, limit=25, offset=offset)
        assert [r.row_index for r in page.collect()] == whole[offset:offset + 25], (order, kind, offset)
    whole = [r.row_index for r in paging.slice_sort(t, "v", "desc").collect()]
    assert [r.row_index for r in paging.table_slice(t, 400, 130, "v", "desc").collect()] == whole[400:530]
    assert paging.table_slice(t, 700, 30).count() == 0


def test_numeric_filters_reach_the_scan(spark, tmp_path):
    cellstore.write_cells(table(spark, ["amount"], [("$5.50",), ("1,200 kg",), ("x",), (None,)]), str(tmp_path / "c"), 1)
    stored = cellstore.read_cells(spark, str(tmp_path / "c"), 1)
    found = filters.filter_gt(stored, "amount", "$5")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert indices(found) == [0, 1] and "GreaterThan(amount.plain,5.0)" in plan, plan


def rows_read(spark, path, **options):
    return [tuple(r) for r in delimited.read_delimited(spark, str(path), **options).orderBy("row_index").collect()]


def test_each_file_has_its_own_verdict(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age\nann,3\n")
    (tmp_path / "b.csv").write_text("5,7\n6,8\n")
    (tmp_path / "c.tsv").write_text("Name\tAge\nbo\t4\n")
    (tmp_path / "d.csv").write_text("")
    assert rows_read(spark, tmp_path) == [(0, "ann", "3"), (1, "5", "7"), (2, "6", "8"), (3, "bo", "4")]
    assert len(rows_read(spark, tmp_path, has_header=False)) == 6
    (tmp_path / "e.csv").write_text("age,name\n3,ann\n")
    with pytest.raises(ValueError, match="columns"):
        rows_read(spark, tmp_path)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.csv").write_text("")
    with pytest.raises(ValueError, match="no records"):
        rows_read(spark, tmp_path / "none")


def test_blank_lines_are_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n\n3,4\n\n")
    assert rows_read(spark, tmp_path / "a.csv") == [(0, "1", "2"), (1, None, None), (2, "3", "4"), (3, None, None)]


def test_quoted_breaks_are_read_in_splits(spark, tmp_path):
    """Records with line breaks, in more splits than records have lines, as the csv module reads them."""
    rng = random.Random(5)
    odd = ['plain', 'a "quoted" word', 'two\nlines', 'ends in break\n', '\n', 'comma, and\n\n"x"', '5" pipe', '', '""']
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(["name", "first\nnote", "size"])
            for i in range(400):
                out.writerow([f"n{i}", rng.choice(odd), i])
            f.write('n400,5" raw,400\n"x"y"z,"a\nb"c,401\n')
    expected = []
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, newline="") as f:
            expected += list(csv.reader(f))[1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        raw = delimited.read_delimited(spark, str(tmp_path))
        got = [tuple(r) for r in raw.orderBy("row_index").collect()]
        lines, _ = delimited.read_records(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert raw.columns == ["row_index", "name", "first_note", "size"]
    assert [r[0] for r in got] == list(range(len(expected)))
    for g, e in zip(got, expected):
        if e[0].startswith("n"):
            assert [x or "" for x in g[1:]] == e, (g, e)
    assert lines.count() == len(expected) + 2


def test_open_after_follows_the_csv_module(spark):
    lines = ['a,b', '"a', 'a"', '"a,b"', '"a""', '"a"""', 'x"y,"z', '"a"b"c', '""', '"', ',"', '"a","b', 'b",c', '"",""""', '']
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", delimited.open_after(F.col("t"), F.lit(",")).alias("o"))
    for t, o in df.collect():
        for inside, got in ((False, o.out), (True, o.inside)):
            text = ('"' if inside else "") + t
            plus = list(csv.reader([text + "\n", 'end"\n']))  # one record if the first line is left open
            assert got == (len(plus) == 1), (t, inside)


def test_file_checks_and_headers(spark, tmp_path):
    files = {
        "header.csv": b"name,age\nAnn,3\n", "bare.csv": b"1,2\n3,4\n", "only_header.csv": b"name,age\n",
        "text.csv": b"city\nParis\n", "one_row.csv": b"Ann,3\n", "nul.csv": b"a,b\n\x00,1\n",
        "latin.csv": b"caf\xe9,1\n", "notes.txt": b"a,b\n", "tab.tsv": b"name\tage\nAnn\t3\n",
        "quoted.csv": b'"last, first",age\n"Doe, ""J""",4\n', "empty.csv": b"", "empty.txt": b"",
        "late nul.csv": b"a,b\n" + b"1,2\n" * 40000 + b"\x00,1\n", "late+latin.csv": b"a,b\n" + b"1,2\n" * 40000 + b"\xe9,1\n",
        "wide.csv": "é,ü\n".encode() * 20000, "breaks.csv": b'"first\n\nname",age\n"a\nb",3\n',
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    reasons = {r[0]: r[1] for r in delimited.check_files(spark, str(tmp_path)).select(name, "reason").collect()}
    assert set(reasons) == set(files)
    assert {k: v for k, v in reasons.items() if v} == {
        "nul.csv": "binary", "latin.csv": "not_utf8", "notes.txt": "extension", "empty.csv": "empty",
        "empty.txt": "extension", "late nul.csv": "binary", "late+latin.csv": "not_utf8"}
    large = delimited.check_files(spark, str(tmp_path), max_bytes=10).where("reason = 'too_large'")
    assert large.count() == sum(len(c) > 10 for c in files.values())
    heads = {r[0]: r[1] for r in delimited.infer_header(spark, str(tmp_path)).select(name, "has_header").collect()}
    assert set(heads) == set(files)
    assert {k: heads[k] for k in ("header.csv", "bare.csv", "only_header.csv", "text.csv", "one_row.csv", "tab.tsv", "quoted.csv", "empty.csv", "breaks.csv")} == {
        "header.csv": True, "bare.csv": False, "only_header.csv": True, "text.csv": True, "one_row.csv": False,
        "tab.tsv": True, "quoted.csv": True, "empty.csv": None, "breaks.csv": True}


def test_unique_names(spark, monkeypatch):
    monkeypatch.setattr(headers, "PIECE", 3)  # numbering in pieces of three
    names = ["a", "a", "a_2", "A", "", "a", "a_2", "a", "b"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "file_id int, column_index int, header string")
    got = [r[0] for r in headers.dedupe_headers(df).orderBy("column_index").select("normalized_name").collect()]
    assert got == ["a", "a_3", "a_2", "a_4", "col_5", "a_5", "a_2_2", "a_6", "b"]
    wide = spark.createDataFrame([(1, 0, "Ｎａｍｅ"), (1, 1, "Name")], df.schema)  # compatibility forms fold
    assert sorted(r["normalized_name"] for r in headers.dedupe_headers(wide).collect()) == ["name", "name_2"]
    claimed = headers.claim_unique_names(
        spark.createDataFrame([(None, i, n) for i, n in enumerate(["T", "t", "T_2", "!!"])], "e int, id int, n string"), "e", "id", "n")
    assert [r["unique_name"] for r in claimed.orderBy("id").collect()] == ["T", "t_3", "T_2", "table"]
    long = ["x" * 300, "x" * 300, "x" * 254 + "a", "X" * 254 + "A", "x" * 254 + "b", "x" * 254 + "b", "x" * 253 + "_2", "f", "F", "f_2"]
    folders = headers.claim_folder_names(
        spark.createDataFrame([(1, i, n) for i, n in enumerate(long)], "e int, id int, n string"), "e", "id", "n")
    got = {r["id"]: r["unique_name"] for r in folders.collect()}
    assert len({n.lower() for n in got.values()}) == len(long) and max(map(len, got.values())) == 255
    assert [got[i] for i in (0, 2, 4, 6, 7, 8, 9)] == ["x" * 255, long[2], long[4], long[6], "f", "F_3", "f_2"]


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 2))) for i in range(400)]
    rows += [(400 + i, rows[0][1], "alpha") for i in range(5)]  # equal scores
    asked = [(q, [float(x) for x in rng.normal(size=8)], w) for q, w in enumerate(["find beta", "alpha or delta", "nothing", "the gamma", "x alpha"])]
    return (spark.createDataFrame(rows, "row_index bigint, embedding array<float>, text string").repartition(5), rows,
            spark.createDataFrame(asked, "query_id bigint, embedding array<float>, question string"), asked)


def brute(rows, vector, k, matched=lambda t: False):
    unit = lambda v: np.asarray(v, "float32").astype("float64") / np.linalg.norm(np.asarray(v, "float32").astype("float64"))
    order = sorted((not matched(t), -round(float(unit(v) @ unit(vector)), 9), i) for i, v, t in rows)
    return [i for _, _, i in order[:k]]


@pytest.mark.parametrize("block", [4096, 2])
def test_search(space, monkeypatch, block):
    """Broadcast and block-wise search agree with brute force, keyword matches first."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 100)
    df, rows, queries, asked = space
    by_rank = lambda hits, q: [r["row_index"] for r in hits if r["query_id"] == q]
    hits = vectors.cosine_topk(df, queries, 7).orderBy("rank").collect()
    found = vectors.semantic_search(df, queries, 7).orderBy("rank").collect()
    counts = {r[0]: r[1] for r in vectors.keyword_match_counts(df, queries).collect()}
    words = {0: {"beta"}, 1: {"alpha", "delta"}, 2: {"nothing"}, 3: {"gamma"}, 4: {"alpha"}}
    for q, vector, _ in asked:
        assert by_rank(hits, q) == brute(rows, vector, 7)
        match = lambda t, q=q: bool(words[q] & set(t.split()))
        assert by_rank(found, q) == brute(rows, vector, 7, match)
        assert counts[q] == sum(match(t) for _, _, t in rows)


def test_approximate_search(space):
    df, rows, queries, asked = space
    hits = vectors.ann_topk(df, queries, 10).collect()
    found = sum(len({r["row_index"] for r in hits if r["query_id"] == q} & set(brute(rows, v, 10))) for q, v, _ in asked)
    assert found / (10 * len(asked)) > 0.8


def test_own_model(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, "c")], "row_index bigint, text string")
    made = vectors.embed_rows(rows, lambda texts: np.array([[len(t), 1.0] for t in texts]).reshape(-1, 2))
    assert [tuple(r) for r in made.orderBy("row_index").collect()] == [(1, "ab", [2.0, 1.0]), (3, "c", [1.0, 1.0])]


def test_answers(spark):
    t = table(spark, ["sales_person", "boxes_shipped", "country"], [
        ("Ann", "10", "India"), ("Bo", "40", "New York"), ("Ann", "35", "India"), ("Cy", "x", "Peru"), ("Bo", "1", "")])
    asked = ["How many boxes shipped in India?", "Who shipped the most boxes?", "least boxes shipped in one deal",
             "count rows by country", "average boxes where country is new york", "total boxes in Peru", "Hello there"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid bigint, question string")
    got = {r["qid"]: r for r in questions.answer_questions(q, t).collect()}
    assert got[0]["answer"] == "The total boxes_shipped is 45."
    assert got[0]["source_row_index"] == 2 and got[0]["matched_rows"] == 2
    assert got[1]["answer"] == "The sales_person with the highest total boxes_shipped is Ann (45)."
    assert got[2]["answer"] == "The lowest boxes_shipped in a single row is 1 by sales_person Bo (row 4)."
    assert got[4]["answer"] == "The average boxes_shipped is 40."
    assert got[5]["answer"] is None and got[5]["matched_rows"] == 1
    assert got[3]["group_value"] == "India" and 6 not in got


def test_edits(spark):
    t = table(spark, ["item", "price"], [("a", "$1"), ("b", "$2"), ("c", "$3")])
    changes = spark.createDataFrame([(1, "price", "n/a", 1), (1, "price", "€ 9", 2), (2, "item", "", 1), (0, "none", "x", 1), (9, "item", "z", 1)],
                                    "row_index bigint, column_name string, value string, seq int")
    got = edits.apply_cell_edits(t, changes).orderBy("row_index").collect()
    assert [(r["item"]["normalized"], r["price"]["normalized"], r["price"]["currency"]) for r in got] == [
        ("a", "1.00", "USD"), ("b", "9.00", "EUR"), (None, "3.00", "USD")]
    assert edits.rename_column(t, "price", "Unit Price").columns == ["row_index", "item", "unit_price"]
    with pytest.raises(ValueError):
        edits.rename_column(t, "price", "Item")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, products, tmp_path):
    """Stored tables are read field by field, filters reach the scan, paging is a top-k."""
    cellstore.write_cells(products, str(tmp_path), 1)
    cellstore.write_cells(products.limit(2), str(tmp_path), 2)
    stored = cellstore.read_cells(spark, str(tmp_path), 1)
    assert stored.count() == 6 and stored.schema["date"].metadata["kind"] == "date"
    total = plan(aggregation.aggregate(stored, [{"agg": "sum", "column": "revenue"}], "region",
                                       conditions=[where("region", "!=", "West")]))
    assert "ReadSchema: struct<revenue:struct<plain:double>,region:struct<normalized:string>>" in total
    assert "Not(EqualTo(region.normalized,West))" in total
    assert "TakeOrderedAndProject" in plan(paging.sort_rows(stored, "revenue").limit(5))
    groups = aggregation.aggregate(stored, [{"agg": "count", "column": None}], "region", limit=2)
    for df in (aggregation.drilldown(stored, groups, "region"), paging.paginate(stored, "revenue")):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_search_any_cell(products):
    assert indices(filters.search_any_cell(products, " UT")) == [1, 4]
    assert indices(filters.search_any_cell(products, "%")) == []
    assert cells.value_columns(products) == ["product", "revenue", "region", "date"]


def test_empty_table_replaces_rows(spark, products, tmp_path):
    cellstore.write_cells(products, str(tmp_path), 1)
    cellstore.write_cells(products.where("row_index < 0"), str(tmp_path), 1)
    back = cellstore.read_cells(spark, str(tmp_path), 1)
    assert back.count() == 0 and back.columns == products.columns


def test_rows_changed_twice_and_blanked(spark, tmp_path):
    schema = "dataset_id bigint, row_index bigint, text string, seq int"
    first = spark.createDataFrame([(1, 0, "z", 1), (1, 0, "a", 2), (1, 1, "b", 1), (1, 2, "c", 1)], schema)
    later = spark.createDataFrame([(1, 1, "d", 1), (1, 1, None, 2)], schema)
    stored = vectors.embed_rows(first.where("seq = 1").drop("seq"))
    refreshed = edits.refresh_vectors(stored, first.union(later).where("row_index < 2"), sequence="seq")
    assert sorted((r.row_index, r.text) for r in refreshed.collect()) == [(0, "a"), (2, "c")]
    for rows in (first, later):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        index_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state",
                     sequence="seq").awaitTermination()
    left = latest_vectors(spark, f"{tmp_path}/out").collect()
    assert sorted((r.row_index, r.text) for r in left) == [(0, "a"), (2, "c")]
