"""From raw text to a stored cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulith.functions import cells
from tabulith.operators import inference
from tabulith.sources import cellstore, delimited


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" and not cells.is_internal(n)]


def parsed(df: DataFrame) -> DataFrame:
    """Raw rows with `row_index` to cells, types inferred from all rows in one aggregate."""
    columns = text_columns(df)
    out = cells.normalize_row(df, columns, **inference.infer_hints(df, columns))
    metadata = {f.name: f.metadata for f in df.schema.fields}
    return out.select(*[F.col(f"`{c}`").alias(c, metadata=metadata[c]) for c in out.columns])


def to_cells(df: DataFrame) -> DataFrame:
    """Raw rows to cells, each column's kind noted in the schema: for tables that are not stored.

    Every row has a say in the kinds, so the rows are parsed for them, and again when used.
    """
    return cellstore.with_kinds(parsed(df))


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    dataset_id: int,
    has_header: bool | None = None,
    **read_options,
) -> DataFrame:
    """Read delimited files, normalize, write one dataset and return it as stored.

    The rows are read for the types and then parsed once, on the way to the store; the kinds of
    the columns come from what is stored and are kept beside it.
    """
    table = parsed(delimited.read_delimited(spark, source, has_header, **read_options))
    cellstore.write_cells(table, target, dataset_id)
    cellstore.write_kinds(spark, target, dataset_id)
    return cellstore.read_cells(spark, target, dataset_id)
