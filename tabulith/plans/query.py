"""One entry for the four query modes over a stored cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulith.operators import aggregation, citations, filters, paging, vectors

MODES = ("filter", "filter_row_indices", "aggregate", "semantic")


def query_filter(
    table: DataFrame, filters_: list[dict] | None = None, columns: list[str] | None = None,
    sort_by: str | None = None, sort_order: str = "asc", sort_as: str = "auto", limit: int = 50,
    offset: int = 0, dataset_id: int = 0,
) -> DataFrame:
    """A page of original values, the count of all matches and a citation per row."""
    page = paging.paginate(table, sort_by, sort_order, sort_as, limit, offset, filters_)
    names = list(filters.original_names(table))
    wanted = list(dict.fromkeys(filters.resolve_column(table, c) for c in columns or names))
    cited = filters.resolve_column(table, filters_[0]["column"]) if filters_ else names[0]
    return page.select(
        "row_index",
        *[F.col(f"`{c}`.original").alias(c) for c in wanted],
        F.col("row_count"),
        citations.citation_id(F.lit(dataset_id), F.col("row_index"), F.lit(cited)).alias("citation"),
    )


def query_semantic(
    table: DataFrame, rows: DataFrame, queries: DataFrame, top_k: int = 5, dataset_id: int = 0,
    columns: list[str] | None = None,
) -> DataFrame:
    """Search hits with citations and the normalized values of their rows.

    rows (row_index, text, embedding), queries (query_id, question, embedding).
    """
    hits = vectors.semantic_search(rows, queries, top_k)
    results = hits.select(F.col("query_id").alias("qid"), "row_index", "score", "rank")
    asked = queries.select(F.col("query_id").alias("qid"), "question")
    cited = citations.cite_results(results, table, asked, dataset_id)
    names = list(filters.original_names(table))
    wanted = list(dict.fromkeys(filters.resolve_column(table, c) for c in columns or names))
    values = table.select("row_index", *[F.col(f"`{c}`.normalized").alias(c) for c in wanted])
    return cited.join(values, "row_index")


def run_query(table: DataFrame, mode: str, **payload) -> DataFrame:
    if mode == "filter":
        return query_filter(table, payload.pop("filters", None), **payload)
    if mode == "filter_row_indices":
        return paging.filter_row_indices(table, payload.get("filters"), payload.get("max_rows", 100))
    if mode == "aggregate":
        metrics = payload.pop("metrics", None) or [
            {"agg": payload.pop("operation", None) or "count", "column": payload.pop("metric_column", None)}
        ]
        return aggregation.aggregate(
            table, metrics, payload.get("group_by"), payload.get("group_by_date_part"),
            payload.get("filters"), payload.get("sort_order", "desc"), payload.get("limit", 50),
            annotate=True,
        )
    if mode == "semantic":
        return query_semantic(table, **payload)
    raise ValueError(f"mode must be one of {', '.join(MODES)}")
