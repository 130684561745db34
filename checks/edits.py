"""Edits, renames, vector refresh and the two streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import rules as R
from checks.fixtures import SALES, base, fixture, people, sales, with_
from tabulith.functions import cells
from tabulith.operators import edits, vectors
from tabulith.session import scratch_folder
from tabulith.streaming import ingest

SALES_WITH = with_("fx_sales", cells=R.SALES_CELLS)


def edited(s, sf):
    return cells.flatten_normalized(edits.apply_cell_edits(sales(s, sf), fixture(s, sf, "fx_edits")))


def rejected(s, sf):
    """The edits, every third one aimed at a row or a column that is not there."""
    k = F.col("row_index") % 3
    aimed = fixture(s, sf, "fx_edits").withColumns({
        "column_name": F.when(k == 1, F.lit("colour")).otherwise(F.col("column_name")),
        "row_index": F.when(k == 2, -F.col("row_index") - 1).otherwise(F.col("row_index"))})
    return edits.rejected_edits(sales(s, sf), aimed).select("row_index", "column_name", "reason")


def renamed(s, sf):
    table = edits.rename_column(people(s, sf), "segment", " Market Segment")
    return table.select("row_index", F.col("market_segment.normalized").alias("market_segment"),
                        cells.table_row_text(table).alias("text"))


def refreshed(s, sf):
    rows = base(s, sf, "customer").select(F.col("c_custkey").alias("row_index"), F.col("c_name").alias("text"), "c_mktsegment", "c_acctbal")
    before = vectors.embed_rows(rows.select("row_index", "text"))
    changed = rows.where("c_mktsegment = 'BUILDING'").select(
        "row_index", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("new "), "text")).alias("text"))
    return edits.refresh_vectors(before, changed).select("row_index", "text", F.size("embedding").cast("bigint").alias("width"))


def ingested(s, sf):
    """Ordinary files, without row numbers: three drops, two drains."""
    folder = scratch_folder(s, "drop")
    raw = fixture(s, sf, "fx_sales")
    for i, status in enumerate(("F", "O", "P")):
        drop = raw.where(F.trim("status") == status).repartitionByRange(3, "row_index").sortWithinPartitions("row_index")
        drop.select(*SALES).write.option("header", True).option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/drop={i}")
        if i:
            ingest.ingest_stream(s, folder, f"{folder}-cells", f"{folder}-state").awaitTermination()
    return cells.flatten_normalized(ingest.stream_cells(s, f"{folder}-cells"))


def indexed(s, sf):
    folder = scratch_folder(s, "rows")
    rows = base(s, sf, "embeddings").select(F.col("label").cast("bigint").alias("dataset_id"), F.col("vec_id").alias("row_index"),
                                            F.concat(F.lit("row "), F.col("vec_id")).alias("text"))
    for again in (rows, rows.where("dataset_id < 5").withColumn("text", F.concat(F.lit("new "), "text"))):
        again.write.mode("append").parquet(folder)
        ingest.index_stream(s, folder, "dataset_id bigint, row_index bigint, text string", f"{folder}-vectors",
                            f"{folder}-state").awaitTermination()
    return ingest.latest_vectors(s, f"{folder}-vectors").select("dataset_id", "row_index", "text", F.size("embedding").cast("bigint").alias("width"))


QUERIES = {
    "apply_cell_edits": edited,
    "rejected_edits": rejected,
    "rename_column": renamed,
    "refresh_vectors": refreshed,
    "ingest_stream": ingested,
    "index_stream": indexed,
}
ORACLES = {
    "apply_cell_edits": with_("fx_sales", "fx_edits", cells=R.SALES_CELLS,
        e="SELECT row_index, column_name, arg_max(\"value\", seq) AS v FROM fx_edits GROUP BY 1, 2") + f"""
SELECT c.row_index, customer, status, order_date, CASE WHEN a.v IS NOT NULL THEN printf('%.2f', {R.number('a.v')}) ELSE amount END AS amount, weight,
 CASE WHEN n.v IS NOT NULL THEN n.v ELSE note END AS note FROM cells c
 LEFT JOIN e a ON a.row_index = c.row_index AND a.column_name = 'amount' LEFT JOIN e n ON n.row_index = c.row_index AND n.column_name = 'note'""",
    "rejected_edits": with_("fx_edits") + """SELECT CASE WHEN row_index % 3 = 2 THEN -row_index - 1 ELSE row_index END AS row_index,
 CASE WHEN row_index % 3 = 1 THEN 'colour' ELSE column_name END AS column_name, CASE WHEN row_index % 3 = 1 THEN 'unknown_column' ELSE 'unknown_row' END AS reason
 FROM fx_edits WHERE row_index % 3 > 0""",
    "rename_column": with_("fx_people", cells=R.PEOPLE_CELLS) + """SELECT row_index, segment AS market_segment, concat_ws(' | ', 'name: ' || name, 'nation: ' || nation,
 'region: ' || region, 'market_segment: ' || segment, 'balance: ' || balance) AS text FROM cells""",
    "refresh_vectors": """SELECT c_custkey AS row_index, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new ' || c_name ELSE c_name END AS text, CAST(384 AS BIGINT) AS width
 FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0""",
    "ingest_stream": SALES_WITH + """SELECT row_number() OVER (ORDER BY status, row_index) - 1 AS row_index,
 customer, status, order_date, amount, weight, note FROM cells""",
    "index_stream": """SELECT CAST(label AS BIGINT) AS dataset_id, vec_id AS row_index, CASE WHEN label < 5 THEN 'new ' ELSE '' END || 'row ' || vec_id AS text, CAST(384 AS BIGINT) AS width FROM embeddings""",
}
