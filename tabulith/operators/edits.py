"""Cell edits, column renames and the vectors that follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tabulith.functions import cells
from tabulith.functions.text import normalize_header
from tabulith.operators import inference
from tabulith.operators.vectors import embed_rows
from tabulith.session import marked, materialize, small_side


def latest_edits(edits: DataFrame, columns: list[str]) -> DataFrame:
    """(row_index, column_name, value, seq) to one row per edited row: the last value of each
    edited column, NULL where a column is not edited."""
    of = lambda c: F.when(F.col("column_name") == c, F.col("seq"))
    return edits.where(F.col("column_name").isin(columns)).groupBy("row_index").agg(
        *[F.max_by(F.struct("value"), of(c)).alias(f"__new_{c}") for c in columns]
    )


def apply_cell_edits(table: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited rows get their new text and are parsed anew; others stay as they are.

    Column types are inferred again from all rows as edited, in one aggregate; the kind that was
    noted for an edited column is dropped, so that queries infer it again. An edit of an unknown
    column or row is not applied: see `rejected_edits`.
    """
    columns = cells.value_columns(table)
    latest = materialize(latest_edits(edits, columns), "edits")
    text = lambda c: F.coalesce(F.col(f"`{c}`.original"), F.lit(""))
    # Only the rows with edits, and a few others, meet them; the rest stays where it is.
    number = F.col("row_index").cast("long")
    each = marked(table, number, latest.select(number), "__maybe")
    stay = each.where(~F.col("__maybe"))
    met = each.where("__maybe").join(
        small_side(latest.withColumn("__edited", F.lit(True))), "row_index", "left")
    met = materialize(met.drop("__maybe"), "maybe-edited")
    edited_text = [
        F.when(F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}")["value"]).otherwise(text(c)).alias(c)
        for c in columns
    ]
    hints = inference.infer_hints(
        stay.select(*[text(c).alias(c) for c in columns]).union(met.select(*edited_text)), columns)
    out = stay.select("row_index", *columns).unionByName(met.where("__edited is null").select("row_index", *columns))
    touched = met.where("__edited").select("row_index", *edited_text)
    out = out.unionByName(cells.normalize_row(touched, columns, **hints).select("row_index", *columns))
    counts = latest.agg(*[F.count(f"__new_{c}").alias(c) for c in columns]).first()
    kept = {c: {k: v for k, v in table.schema[c].metadata.items() if k != "kind" or not counts[c]} for c in columns}
    return out.select("row_index", *[F.col(f"`{c}`").alias(c, metadata=kept[c]) for c in columns])


def rejected_edits(table: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits that `apply_cell_edits` does not apply, with a `reason`: unknown_column, else
    unknown_row."""
    known = table.select("row_index", F.lit(True).alias("__known"))
    wanted = small_side(materialize(edits.select("row_index").distinct(), "edited-rows"))
    known = known.join(wanted, "row_index", "left_semi")  # as few as the edits
    reason = (
        F.when(~F.coalesce(F.col("column_name").isin(cells.value_columns(table)), F.lit(False)), "unknown_column")
        .when(F.col("__known").isNull(), "unknown_row"))
    return (
        edits.join(known, "row_index", "left").withColumn("reason", reason)
        .where("reason IS NOT NULL").drop("__known")
    )


def rename_column(table: DataFrame, column: str, new_name: str) -> DataFrame:
    """The column under the normalized new name, which must be free; cells keep their types."""
    columns = cells.value_columns(table)
    if column not in columns:
        raise ValueError(f"unknown column {column!r}")
    name = table.sparkSession.range(1).select(normalize_header(F.lit(new_name))).first()[0]
    if not name:
        raise ValueError(f"no name for column {column!r}")
    if name != column and name in columns:
        raise ValueError(f"column {name!r} already exists")
    metadata = {**table.schema[column].metadata, "original_name": new_name.strip()}
    return table.select(*[
        F.col(f"`{c}`").alias(name, metadata=metadata) if c == column else F.col(f"`{c}`")
        for c in table.columns
    ])


def refresh_vectors(
    vectors: DataFrame, changed: DataFrame, embed: Callable | None = None, sequence: str | None = None
) -> DataFrame:
    """Vectors after the rows of `changed` (row_index, text) took on new texts.

    A changed row replaces its vector; one left without text loses it. Of several changes to a row
    the one with the highest `sequence` counts (without that column: the greatest text).
    """
    keys = [k for k in ("dataset_id", "row_index") if k in changed.columns]
    changed = latest_changes(changed, keys, sequence)
    kept = vectors.join(small_side(changed.select(*keys)), keys, "left_anti")
    added = embed_rows(changed, embed)
    return kept.select(vectors.columns).unionByName(added.select(vectors.columns))


def latest_changes(changed: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """One row (keys, text) per key: that with the highest `sequence`, then the greatest text."""
    order = F.struct(*([sequence] if sequence else []), "text")
    return changed.groupBy(*keys).agg(F.max(order).alias("last")).select(*keys, "last.text")
