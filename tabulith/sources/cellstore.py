"""Cell tables on disk, and what is known about a table as a whole."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tabulith.functions import cells
from tabulith.operators import filters, inference


def write_cells(df: DataFrame, path: str, dataset_id: int) -> None:
    """Replace one dataset, leaving the others: all of its rows become visible together.

    Rows keep their order within files, so that the row-group ranges of row_index stay narrow. A
    table without rows leaves a file with its schema: a dynamic overwrite replaces only partitions
    that it writes rows to.
    """
    # Rows are counted as they are written: looking for a first one would run all that comes before a
    # shuffle twice.
    written = Observation()
    (
        df.observe(written, F.count(F.lit(1)).alias("rows"))
        .withColumn("dataset_id", F.lit(dataset_id).cast("bigint"))
        .sortWithinPartitions("row_index")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(path)
    )
    if not written.get["rows"]:
        empty = df.sparkSession.createDataFrame([], df.drop("dataset_id").schema)
        empty.write.mode("overwrite").parquet(f"{path.rstrip('/')}/dataset_id={dataset_id}")
    _forget_kinds(df.sparkSession, path, dataset_id)


def read_cells(spark: SparkSession, path: str, dataset_id: int) -> DataFrame:
    """Rows of one dataset; only its partition is listed and read."""
    table = spark.read.parquet(f"{path.rstrip('/')}/dataset_id={dataset_id}").drop("dataset_id")
    try:
        kept = spark.read.schema("column string, kind string").parquet(_kinds(path, dataset_id)).collect()
    except AnalysisException:  # none are kept: they may be in the schema
        return table
    return _with_kinds(table, {r["column"]: r["kind"] for r in kept})


def _kinds(path: str, dataset_id: int) -> str:
    return f"{path.rstrip('/')}/_kinds/dataset_id={dataset_id}"


def _forget_kinds(spark: SparkSession, path: str, dataset_id: int) -> None:
    """Kinds kept of an earlier table under this number say nothing of the new one."""
    try:
        spark.read.parquet(_kinds(path, dataset_id))
    except AnalysisException:
        return
    spark.createDataFrame([], "column string, kind string").write.mode("overwrite").parquet(_kinds(path, dataset_id))


def write_signatures(spark: SparkSession, path: str, dataset_id: int, **options) -> None:
    """Keep the search signatures of a stored dataset beside it (see `filters.signatures`)."""
    made = filters.signatures(read_cells(spark, path, dataset_id), **options)
    made.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_signatures/dataset_id={dataset_id}")


def read_signatures(spark: SparkSession, path: str, dataset_id: int) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/_signatures/dataset_id={dataset_id}")


def write_kinds(spark: SparkSession, path: str, dataset_id: int) -> None:
    """Infer the kinds of a stored dataset's columns and keep them beside it, a row per column."""
    kinds = inference.infer_column_kinds(read_cells(spark, path, dataset_id))
    kinds.select("column", "kind").coalesce(1).write.mode("overwrite").parquet(_kinds(path, dataset_id))


def with_kinds(df: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Store the inferred kind of every cell column in the schema, for the queries to come.

    `sample`: the first rows as cells, if already at hand.
    """
    return _with_kinds(df, inference.verdicts(inference.infer_column_kinds(df if sample is None else sample)))


def _with_kinds(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, "kind": kinds[f.name]})
            if f.name in kinds
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def build_table_profile(df: DataFrame, sample_rows: int = 3) -> DataFrame:
    """One row per column: position, names, inferred type, values of the first rows."""
    columns = cells.value_columns(df)
    originals = {f.name: f.metadata.get("original_name", f.name) for f in df.schema.fields}
    types = inference.infer_types_stored(df, columns)
    first = df.where(F.col("row_index") < sample_rows)
    samples = first.select(
        "row_index",
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(i).alias("column_index"),
                    F.lit(originals[c]).alias("original_name"),
                    F.nullif(cells.preview_value(F.col(f"`{c}`")), F.lit("")).alias("value"),
                )
                for i, c in enumerate(columns)
            ])
        ),
    )
    per_column = samples.groupBy("column", "column_index", "original_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("row_index", "value"))), lambda r: r["value"]
        ).alias("sample_values")
    )
    return per_column.join(F.broadcast(types), "column")
