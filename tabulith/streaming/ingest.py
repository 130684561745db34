"""Continuous ingest: new files to cells, new rows to vectors, each exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulith.functions import cells
from tabulith.operators.edits import latest_changes
from tabulith.operators.inference import infer_hints
from tabulith.operators.vectors import embed_rows
from tabulith.sources.delimited import read_delimited


LAYOUT = ("column_index int, name string, original_name string, date_format string, "
          "is_money boolean, is_measurement boolean, needs_nfc boolean")


def _layout(spark: SparkSession, target: str) -> list[Row] | None:
    """The stored layout of a stream, if its first batch has been read."""
    try:
        found = spark.read.schema(LAYOUT).parquet(f"{target}/_layout").orderBy("column_index").collect()
    except AnalysisException:
        return None
    return found or None


def _decide(spark: SparkSession, raw: DataFrame, target: str) -> list[Row]:
    """Infer the layout from the rows of the first batch and store it for all later ones."""
    columns = [c for c in raw.columns if c != "row_index"]
    hints = infer_hints(raw, columns)
    rows = [
        (i, c, raw.schema[c].metadata.get("original_name", c), hints["date_formats"].get(c),
         c in hints["money_columns"], c in hints["measurement_columns"], c in hints["unicode_columns"])
        for i, c in enumerate(columns)
    ]
    spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{target}/_layout")
    return _layout(spark, target)


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    has_header: bool | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Files dropped anywhere below a folder to cells, appended to `target`; drains what is there.

    The stream is one of files: each is read once, as `read_delimited` reads it, so ordinary CSV
    and TSV files will do. Rows are numbered on from batch to batch, in a batch by path and place.
    What has to be remembered is kept beside the cells: column names and types, inferred from all
    rows of the first batch (`_layout`), and per batch its first row number and its rows
    (`_batches`). A batch that runs again after a failure finds the same files and the same first
    number and replaces itself, so numbers are dense and stay as they are over restarts. A file
    whose header names other columns fails the batch. `max_files` bounds the paths of a batch.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).load(source).select("path")  # no content is read
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        paths = sorted(r[0] for r in batch.collect())
        if not paths:
            return
        raw = read_delimited(session, paths, has_header)
        layout = _layout(session, target) or _decide(session, raw, target)
        names = [r["name"] for r in layout]
        found = [c for c in raw.columns if c != "row_index"]
        if len(found) != len(names) or (found != names and not _unnamed(found)):
            raise ValueError(f"columns {found} of batch {batch_id} are not {names}")
        start = _rows_before(session, target, batch_id)
        raw = raw.toDF("row_index", *names).withColumn("row_index", F.col("row_index") + start)
        parsed = cells.normalize_row(
            raw, names,
            {r["name"]: r["date_format"] for r in layout},
            {r["name"] for r in layout if r["is_money"]},
            {r["name"] for r in layout if r["is_measurement"]},
            {r["name"] for r in layout if r["needs_nfc"]})
        folder = f"{target}/batch_id={batch_id}"
        parsed.write.mode("overwrite").parquet(folder)
        n = session.read.parquet(folder).count()
        session.createDataFrame([(start, n)], "start bigint, n bigint").write.mode("overwrite").parquet(
            f"{target}/_batches/batch_id={batch_id}")

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _unnamed(columns: list[str]) -> bool:
    return columns == [f"col_{i + 1}" for i in range(len(columns))]


def _rows_before(spark: SparkSession, target: str, batch_id: int) -> int:
    """The number of rows that earlier batches hold."""
    try:
        batches = spark.read.schema("start bigint, n bigint, batch_id bigint").parquet(f"{target}/_batches")
    except AnalysisException:
        return 0
    return batches.where(F.col("batch_id") < batch_id).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stream_cells(spark: SparkSession, target: str) -> DataFrame:
    """What the stream has read so far, a cell table."""
    stored = spark.read.parquet(target).drop("batch_id")
    originals = {r["name"]: r["original_name"] for r in _layout(spark, target) or []}
    return stored.select(*[
        F.col(f"`{c}`").alias(c, metadata={"original_name": originals[c]}) if c in originals else F.col(f"`{c}`")
        for c in stored.columns])


def index_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    embed: Callable[[list[str]], object] | None = None,
    sequence: str | None = None,
) -> StreamingQuery:
    """Rows (dataset_id, row_index, text) appended as Parquet to their vectors.

    Of several changes to a row in a batch the one with the highest `sequence` counts (without
    that column: the greatest text). A row left without text is stored with a NULL embedding,
    which hides its older vectors. Each batch writes a partition of its own, so a batch run twice after a failure replaces
    itself. Reading takes the latest batch of a row: see `latest_vectors`.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = latest_changes(batch, ["dataset_id", "row_index"], sequence)
        columns = ["dataset_id", "row_index", "text", "embedding"]
        filled = embed_rows(changed, embed).select(*columns)
        blank = changed.where(F.coalesce("text", F.lit("")) == "").withColumn(
            "embedding", F.lit(None).cast(filled.schema["embedding"].dataType))
        filled.unionByName(blank.select(*columns)).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_vectors(spark: SparkSession, target: str) -> DataFrame:
    """One vector per row: that of the latest batch; none for a row that it left without text."""
    stored = spark.read.parquet(target)
    return stored.groupBy("dataset_id", "row_index").agg(
        F.max_by(F.struct("text", "embedding"), "batch_id").alias("v")
    ).select("dataset_id", "row_index", "v.*").where("embedding is not null")
