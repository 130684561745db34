"""Cell citations: which cells of a result row answer the words of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulith.functions import cells
from tabulith.functions.text import extract_keywords, space_tokens, stem_tokens


def citation_id(dataset_id: Column, row_index: Column, column: Column) -> Column:
    return F.concat(
        F.lit("d"), dataset_id.cast("string"), F.lit("_r"), row_index.cast("string"),
        F.lit("_"), column,
    )


def _result_cells(results: DataFrame, table: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per filled cell of each result row, with its question."""
    columns = cells.value_columns(table)
    listed = F.array(*[
        F.struct(
            F.lit(i).alias("column_index"),
            F.lit(c).alias("column"),
            F.col(f"`{c}`.normalized").alias("value"),
        )
        for i, c in enumerate(columns)
    ])
    rows = table.select("row_index", F.filter(listed, lambda x: x["value"] != "").alias("__cells"))
    joined = results.join(questions.select("qid", "question"), "qid").join(rows, "row_index")
    return joined.select(*results.columns, "question", F.inline("__cells"))


def score_highlights(results: DataFrame, table: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, row_index) results to their cells sharing a word with the question.

    A shared keyword weighs 2, any other shared word 0.5, over the distinct question words.
    """
    cell = _result_cells(results, table, questions)
    asked = space_tokens(F.col("question"))
    # Both token lists are built once per row here and used several times below.
    tokens = cell.select(
        "*", asked.alias("__asked"), extract_keywords(F.col("question")).alias("__keywords"),
        space_tokens(F.col("value")).alias("__held"),
    )
    shared = tokens.withColumn("__shared", F.array_intersect("__asked", "__held")).where(
        F.size("__shared") > 0
    )
    key_hits = F.size(F.filter("__shared", lambda t: F.array_contains(F.col("__keywords"), t)))
    score = key_hits * 2.0 + (F.size("__shared") - key_hits) * 0.5
    relevance = score / F.greatest(F.size("__asked"), F.lit(1))
    return shared.select(*results.columns, "column_index", "column", "value",
                         relevance.alias("relevance"))


def fallback_highlight(results: DataFrame, table: DataFrame, questions: DataFrame) -> DataFrame:
    """The one cell per result row whose column name and value share most stems with the
    question (names count double); the first column wins ties, also at zero."""
    cell = _result_cells(results, table, questions)
    tokens = cell.select(
        "*",
        F.array_distinct(stem_tokens(F.col("question"))).alias("__asked"),
        F.array_distinct(stem_tokens(F.col("column"))).alias("__name"),
        F.array_distinct(stem_tokens(F.col("value"))).alias("__held"),
    )
    overlap = lambda side: F.size(F.array_intersect("__asked", side))
    score = 2 * overlap("__name") + overlap("__held")
    best = F.max_by(
        F.struct("column_index", "column", "value"),
        F.struct(score.alias("s"), (-F.col("column_index")).alias("first")),
    )
    return (
        tokens.groupBy(*results.columns)
        .agg(best.alias("b"))
        .select(*results.columns, "b.*", F.lit(1.0).alias("relevance"))
    )


def cite_results(
    results: DataFrame, table: DataFrame, questions: DataFrame, dataset_id: int
) -> DataFrame:
    """Result rows with their highlights, best first, and the id of the best one.

    A row has at most one highlight per column, so the list is as short as the row is wide.
    """
    scored = score_highlights(results, table, questions)
    fallback = fallback_highlight(results, table, questions).withColumn("__fallback", F.lit(True))
    both = scored.withColumn("__fallback", F.lit(False)).unionByName(fallback)
    with_id = both.withColumn(
        "citation", citation_id(F.lit(dataset_id), F.col("row_index"), F.col("column"))
    )
    entry = F.struct(
        F.col("__fallback").alias("f"), (-F.col("relevance")).alias("r"),
        "column_index", "column", "value", "citation", "relevance",
    )
    listed = with_id.groupBy(*results.columns).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    # The fallback counts only where nothing else was found; it then is the only entry.
    chosen = F.when(F.col("all")[0]["f"], F.col("all")).otherwise(
        F.filter("all", lambda e: ~e["f"])
    )
    fields = lambda e: F.struct(e["citation"], e["column"], e["value"], e["relevance"])
    return listed.select(
        *results.columns,
        F.transform(chosen, fields).alias("highlights"),
        chosen[0]["citation"].alias("top_citation"),
    )


_CITATION = r"^d(\d+)_r(\d+)_(.+)$"


def parse_citation(col: Column) -> Column:
    """STRUCT<dataset_id, row_index, column>, NULL for anything that is no citation id."""
    part = lambda i: F.regexp_extract(col, _CITATION, i)
    return F.when(
        col.rlike(_CITATION),
        F.struct(
            part(1).try_cast("bigint").alias("dataset_id"),
            part(2).try_cast("bigint").alias("row_index"),
            part(3).alias("column"),
        ),
    )


def lookup_citation(citations: DataFrame, table: DataFrame, dataset_id: int) -> DataFrame:
    """(citation) to the cell it names and whether it exists. Internal columns do not."""
    columns = cells.value_columns(table)
    names = F.array(*[F.lit(c) for c in columns])
    values = F.array(*[F.col(f"`{c}`.normalized") for c in columns])
    rows = table.select("row_index", F.map_from_arrays(names, values).alias("__values"))
    parsed = citations.withColumn("__c", parse_citation(F.col("citation"))).select(
        *citations.columns, "__c.dataset_id", "__c.row_index", "__c.column"
    )
    here = parsed.withColumn(
        "__row", F.when(F.col("dataset_id") == dataset_id, F.col("row_index"))
    )
    joined = here.join(rows.withColumnRenamed("row_index", "__row"), "__row", "left")
    exists = F.coalesce(F.map_contains_key("__values", F.coalesce("column", F.lit(""))), F.lit(False))
    return joined.select(
        *parsed.columns, F.try_element_at("__values", F.col("column")).alias("value"),
        exists.alias("exists"),
    )


def citation_targets(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(request_id, primary, targets) to the rows to show, in order.

    Ids come from the primary, then the list cut at commas, spaces and bars. Of the valid ones
    only those of the first one's dataset count, and the first per row.
    """
    ids = F.array_distinct(
        F.filter(
            F.concat(F.array("primary"), F.split(F.coalesce("targets", F.lit("")), r"[,\s|]+")),
            lambda x: F.coalesce(x, F.lit("")) != "",
        )
    )
    listed = requests.select("request_id", F.posexplode(ids).alias("__at", "citation"))
    if known is not None:
        listed = listed.join(known.select("citation").distinct(), "citation", "left_semi")
    parsed = listed.withColumn("__c", parse_citation(F.col("citation"))).where(
        F.col("__c").isNotNull()
    ).select("request_id", "__at", "__c.*")
    request = Window.partitionBy("request_id")
    first = F.first("dataset_id").over(request.orderBy("__at"))
    same = parsed.withColumn("__first", first).where(F.col("dataset_id") == F.col("__first"))
    target = F.min_by("column", "__at")
    rows = same.groupBy("request_id", "dataset_id", "row_index").agg(
        target.alias("column"), F.min("__at").alias("__at")
    )
    place = F.row_number().over(request.orderBy("__at")) - 1
    return rows.select("request_id", place.alias("position"), "dataset_id", "row_index", "column")


