"""Files written from the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks import rules as R
from checks.fixtures import SALES, base, fixture, sales, with_
from tabulith.functions import cells
from tabulith.plans import ingest
from tabulith.session import scratch_folder, spread
from tabulith.sources import cellstore, delimited

SALES_WITH = with_("fx_sales", cells=R.SALES_CELLS)
FLAT = "SELECT row_index, customer, status, order_date, amount, weight, note FROM cells"


def sales_csv(s, sf, header=True, **options):
    """The sales table as CSV files in row order."""
    folder = scratch_folder(s, "sales-csv")
    (fixture(s, sf, "fx_sales").repartitionByRange(4, "row_index").sortWithinPartitions("row_index")
     .select(F.col("customer").alias("Customer ID"), *SALES[1:])
     .write.option("header", header).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).options(**options).csv(folder))
    return folder


def read_delimited(s, sf):
    return delimited.read_delimited(s, sales_csv(s, sf))


def mixed_files(s, sf):
    """Orders in files with and without a header line, by month of the order; notes with line
    breaks, commas and quotes in them, and a blank line after each file's first row."""
    folder = scratch_folder(s, "mixed-csv")
    orders = base(s, sf, "orders")
    k = F.col("o_orderkey") % 7
    note = (F.when(k == 0, F.concat(F.lit('"two\nlines'), k.cast("string"), F.lit('"')))
            .when(k == 1, F.lit('"a ""b"", c\n\nd"')).when(k == 2, F.lit('5" wide')).otherwise(F.lit("plain")))
    line = F.concat_ws(",", F.col("o_orderkey"), note, F.col("o_orderstatus"))
    month = F.date_format("o_orderdate", "MM")
    first = F.row_number().over(Window.partitionBy("month").orderBy("o_orderkey")) == 1
    rows = orders.select("o_orderkey", month.alias("month"), line.alias("line")).withColumn("first", first)
    head = F.when(F.col("first") & (F.col("month") < "07"), F.lit("Key,Order Note,Status\n")).otherwise(F.lit(""))
    value = F.concat(head, "line", F.when(F.col("first"), F.lit("\n")).otherwise(F.lit("")))
    (rows.select("month", "o_orderkey", value.alias("value")).repartition(4, "month")
     .sortWithinPartitions("month", "o_orderkey").select("month", "value").write.partitionBy("month").text(folder))
    return folder


def read_mixed(s, sf):
    return delimited.read_delimited(s, mixed_files(s, sf)).toDF("row_index", "key", "note", "status")


def ingest_files(s, sf):
    stored = ingest.ingest(s, sales_csv(s, sf), scratch_folder(s, "cells"), 7)
    return cells.flatten_normalized(stored)


def written_cells(s, sf):
    folder = scratch_folder(s, "cells")
    table = sales(s, sf)
    cellstore.write_cells(table, folder, 1)
    cellstore.write_cells(table.limit(0), folder, 2)
    return cells.flatten_normalized(cellstore.read_cells(s, folder, 1))


def profile(s, sf):
    p = cellstore.build_table_profile(sales(s, sf))
    return p.select("column", "column_index", "original_name", "inferred_type",
                    F.concat_ws("|", "sample_values").alias("samples"))


def nation_files(s, sf):
    """One file per nation: customers, with a flaw that depends on the nation's region."""
    folder = scratch_folder(s, "nation-files")
    people = base(s, sf, "customer").join(F.broadcast(base(s, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.repartition("n_nationkey").select(
        "n_nationkey", "n_regionkey", "c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))
    line = F.concat_ws(",", F.translate("c_name", "0123456789", "abcdefghij"), "c_acctbal")
    flawed = {
        0: (line, "UTF-8"), 1: (line, "UTF-8"), 2: (F.concat(F.lit("a\0b"), line), "UTF-8"),
        3: (F.concat(line, F.lit("é")), "ISO-8859-1"), 4: (line, "UTF-8"),
    }
    for region, (text, encoding) in flawed.items():
        rows = people.where(F.col("n_regionkey") == region)
        target = f"{folder}/region={region}"
        if region == 4:  # a text file by name
            rows.select(text.alias("value")).write.text(target)
        else:
            (rows.select("n_nationkey", text.alias("value")).write.option("encoding", encoding)
             .option("quote", "\u0001").option("escapeQuotes", False).option("sep", "\u0002")
             .option("header", region == 1).partitionBy("n_nationkey").csv(target))
    return folder


def by_folder(df):
    part = lambda name: F.regexp_extract("path", name + r"=(\d+)", 1).try_cast("int")
    return df.where(~F.col("path").rlike("_SUCCESS|/[.]")).withColumn(
        "region", part("region")).withColumn("nation", part("n_nationkey"))


def check_files(s, sf):
    found = delimited.check_files(s, nation_files(s, sf))
    return by_folder(found).select("region", "nation", "reason").distinct()


def infer_header(s, sf):
    found = delimited.infer_header(s, nation_files(s, sf))
    return by_folder(found).select("region", "nation", "has_header").distinct()


def decode(s, sf):
    events = base(s, sf, "events")
    k = F.get_json_object("props", "$.k")
    doc = F.to_json(F.struct(
        F.col("event_type").alias("plain"),
        F.struct(F.lit("o").alias("o"), k.alias("n")).alias("short"),
        F.struct(F.upper("event_type").alias("original"), F.col("event_type").alias("normalized")).alias("full"),
    ))
    twice = F.to_json(F.array(doc))
    stored = (F.when(F.col("event_type") == "error", F.lit("{broken"))
              .when(F.col("event_type") == "click", F.regexp_replace(twice, r"(?s)^\[(.*)\]$", "$1"))
              .otherwise(doc))
    return spread(events).withColumn("stored", stored).select(
        "event_id", *cells.decode_row_json(F.col("stored"), ["plain", "short", "full"]),
        cells.decode_row_json(F.col("stored"), ["full"], "original")[0].alias("full_original"))


QUERIES = {
    "read_delimited": read_delimited,
    "read_delimited_mixed": read_mixed,
    "assign_row_index": lambda s, sf: delimited.assign_row_index(
        s.read.parquet(f"{sf}/orders.parquet")).select("row_index", "o_orderkey"),
    "write_cells": written_cells,
    "read_cells": lambda s, sf: sales(s, sf).where("status.normalized = 'F'").select(
        "row_index", F.col("amount.number").alias("amount")),
    "ingest_files": ingest_files,
    "decode_row_json": decode,
    "build_table_profile": profile,
    "check_files": check_files,
    "infer_header": infer_header,
}

_T = ", ".join(
    f"('{c}', {i}, '{t}')" for i, (c, t) in enumerate({
        "customer": "number", "status": "text", "order_date": "date", "amount": "money",
        "weight": "measurement", "note": "text"}.items()))
ORACLES = {
    # Empty text comes back from a file as NULL.
    "read_delimited": with_("fx_sales") + """SELECT row_index, customer AS customer_id, status, order_date, amount, weight,
 nullif(note, '') AS note FROM fx_sales""",
    "read_delimited_mixed": """WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%m') AS m, o_orderstatus AS status,
  CASE o_orderkey % 7 WHEN 0 THEN 'two' || chr(10) || 'lines0' WHEN 1 THEN 'a "b", c' || chr(10) || chr(10) || 'd' WHEN 2 THEN '5" wide' ELSE 'plain' END AS note FROM orders),
r AS (SELECT m, k, 0 AS blank, CAST(k AS VARCHAR) AS "key", note, status FROM o
      UNION ALL SELECT m, min(k), 1, NULL, NULL, NULL FROM o GROUP BY m)
SELECT row_number() OVER (ORDER BY m, k, blank) - 1 AS row_index, "key", note, status FROM r""",
    "assign_row_index": "SELECT o_orderkey AS row_index, o_orderkey FROM orders",
    "write_cells": SALES_WITH + FLAT,
    "read_cells": SALES_WITH + "SELECT row_index, amount_number AS amount FROM cells WHERE status = 'F'",
    "ingest_files": SALES_WITH + FLAT.replace("customer,", "customer AS customer_id,"),
    "decode_row_json": """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS plain,
 CASE WHEN event_type <> 'error' THEN props->>'$.k' END AS short, CASE WHEN event_type <> 'error' THEN event_type END AS "full",
 CASE WHEN event_type <> 'error' THEN upper(event_type) END AS full_original FROM events""",
    "build_table_profile": SALES_WITH + f""", t AS (SELECT * FROM (VALUES {_T}) AS t("column", column_index, inferred_type)),
v AS (SELECT row_index, unnest(['customer','status','order_date','amount','weight','note']) AS c,
  unnest([customer_original, status_original, order_date_original, amount_original, weight_original, coalesce(nullif(note_original,''), note)]) AS v
  FROM cells WHERE row_index < 3)
SELECT t."column", t.column_index, t."column" AS original_name, t.inferred_type, string_agg(v.v, '|' ORDER BY v.row_index) AS samples
 FROM t JOIN v ON v.c = t."column" GROUP BY 1, 2, 4""",
    "check_files": """SELECT DISTINCT n_regionkey AS region, CASE WHEN n_regionkey <> 4 THEN n_nationkey END AS nation,
 CASE n_regionkey WHEN 2 THEN 'binary' WHEN 3 THEN 'not_utf8' WHEN 4 THEN 'extension' END AS reason
 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    # Files of regions 2 and 3 hold junk in the first cell only; those of region 4 are plain text.
    "infer_header": """SELECT DISTINCT n_regionkey AS region, CASE WHEN n_regionkey <> 4 THEN n_nationkey END AS nation,
 n_regionkey = 1 AS has_header FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
