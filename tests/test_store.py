"""How often the rows of a table are made on the way to the store."""

from pyspark.sql import functions as F

from checks import fixtures
from tabulith.functions import cells
from tabulith.sources import cellstore


def test_rows_before_a_shuffle_are_made_once(spark, tmp_path):
    """A look for a first row ran the shuffle, and all before it, one more time."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"{i} kg"

    rows = spark.range(100).select(F.col("id").alias("row_index"), text("id").alias("v"))
    cellstore.write_cells(cells.normalize_row(rows.repartition(4, "row_index"), ["v"]), str(tmp_path / "c"), 1)
    assert cellstore.read_cells(spark, str(tmp_path / "c"), 1).count() == 100
    assert made.value == 100


def test_rows_are_put_in_order_before_texts_are_made(spark):
    """Texts were made for the sampling of ranges, once more for the shuffle, and moved."""
    rows = fixtures.raw_rows(spark, "/root/testdata/sf0.001", "fx_sales")
    tree = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lpad" not in tree[tree.index("RepartitionByExpression"):]
    want = fixtures.fixture(spark, "/root/testdata/sf0.001", "fx_sales")
    assert rows.exceptAll(want).count() == 0 and rows.count() == want.count()
