"""Plain questions about one table, answered in bulk with the row that proves each answer.

A table of questions becomes a much smaller table of distinct *plans* (what to aggregate over
which filters). Rows meet plans only by equi-joins on the phrases plans filter for; plans that
filter nothing are as few as pairs of columns and ride along with every row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulith import fixed
from tabulith.functions import cells
from tabulith.functions.numbers import format_number_display
from tabulith.functions.text import (
    collapse_spaces, contains_phrase, normalize_phrase, stem_tokens, word_set,
)
from tabulith.operators import inference
from tabulith.session import materialize, small_side

# --- fixed values: phrases that tell how a question wants its rows ---
SINGLE_ROW = r"\b(one|single)\s+(deal|transaction|row|entry|order|sale|shipment)\b"
SINGLE_DAY = r"\b(?:in|on)\s+(?:a|an|one)\s+day\b"
DAY_GROUPS = r"\b(?:by|per|each)\s+day\b|\b(?:what|which)\s+day\b|\bdate\s+with\b"
ALL_ROWS = r"\b(total|sum|average|avg|mean|combined|overall|all)\b"
GROUP_ASKED = (
    r"\b(?:what|which)\s+([a-z0-9_ ]{1,48}?)\s+(?:has|have|had|with|is|are|sold|ship|shipped)\b"
)
GROUP_BY = r"\bby\s+([a-z0-9_ ]{1,48}?)(?:[\s?.!,]|$)"
GROUP_WORDS = r"\b(?:by|per|each|group by)\b"
VALUE_GIVEN = r"\b\s*(?:=|is|equals|equal to)\s*([a-z0-9%&/ .,'\-]{1,60})"
VALUE_ENDS = r"\b(?:and|or|by|with|where|from|for|that|who|which|what)\b.*$"

BLANK_GROUP = "(blank)"


def _has(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, word_set(words)) if words else F.lit(False)


# ── features ──────────────────────────────────────────────────────────────────


def question_features(questions: DataFrame) -> DataFrame:
    """(qid, question) to what can be read from its words alone."""
    base = questions.select(
        "qid", "question", F.lower("question").alias("lowered"),
        stem_tokens(F.col("question")).alias("tokens"),
        normalize_phrase(F.col("question")).alias("phrase"),
    )
    lowered, tokens = F.col("lowered"), F.col("tokens")
    how_many = lowered.contains("how many")
    triggers = (
        fixed.MAX_WORDS + fixed.MIN_WORDS + fixed.SUM_WORDS + fixed.AVERAGE_WORDS + fixed.COUNT_WORDS
    )
    top = F.nullif(F.regexp_extract("lowered", r"\btop\s+(\d{1,2})\b", 1), F.lit("")).cast("int")
    asked = collapse_spaces(F.regexp_extract("lowered", GROUP_ASKED, 1))
    by = collapse_spaces(F.regexp_extract("lowered", GROUP_BY, 1))
    hint = F.coalesce(F.nullif(asked, F.lit("")), F.nullif(by, F.lit("")))
    single_day = (
        lowered.rlike(SINGLE_DAY) & ~lowered.rlike(DAY_GROUPS) & ~lowered.rlike(ALL_ROWS)
    )
    # A superlative comes first, then averages, sums and counts.
    superlative = F.when(_has(tokens, fixed.MAX_WORDS), "max").when(
        _has(tokens, fixed.MIN_WORDS), "min"
    )
    average = _has(tokens, fixed.AVERAGE_WORDS)
    mode = (
        F.when(superlative.isNotNull(), "rank").when(average, "avg")
        .when(_has(tokens, fixed.SUM_WORDS), "sum")
        .when(how_many | _has(tokens, fixed.COUNT_WORDS), "count")
    )
    roles = F.filter(
        F.array(*[
            F.when(_has(tokens, words), role) for role, words in fixed.ROLE_QUESTION_WORDS.items()
        ]),
        lambda r: r.isNotNull(),
    )
    return base.select(
        "*",
        (how_many | lowered.contains("group by") | _has(tokens, triggers)).alias("is_analytic"),
        mode.alias("word_mode"),
        superlative.alias("operator"),
        F.when(superlative.isNotNull(), F.when(average, "avg").otherwise("sum")).alias("rank_aggregation"),
        _has(tokens, fixed.METRIC_WORDS).alias("names_metric"),
        F.least(F.greatest(F.coalesce(top, F.lit(1)), F.lit(1)), F.lit(fixed.TOP_N_LIMIT)).alias("top_n"),
        (lowered.rlike(SINGLE_ROW) | single_day).alias("single_row"),
        hint.alias("group_hint"),
        (lowered.rlike(GROUP_WORDS) | hint.isNotNull()).alias("has_group_phrase"),
        roles.alias("roles"),
    )


# ── picks ─────────────────────────────────────────────────────────────────────


def column_stems(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Stems of the column names: a few words per schema, worked out once."""
    if not columns:
        return {}
    one = df.sparkSession.range(1).select(*[stem_tokens(F.lit(c)) for c in columns]).first()
    return dict(zip(columns, one))


def _overlap(stems: list[str], tokens: Column, phrase: Column) -> Column:
    """3 per shared stem, 2 more for the whole name, 0.4 for a metric word; 0 without a share."""
    if not stems:
        return F.lit(0.0)
    shared = F.size(F.array_intersect(word_set(list(dict.fromkeys(stems))), tokens))
    whole = F.when(phrase.contains(" ".join(stems)), 2.0).otherwise(0.0)
    metric = 0.4 if set(stems) & set(fixed.METRIC_WORDS) else 0.0
    return F.when(shared > 0, shared * 3.0 + whole + metric).otherwise(0.0)


def _role_bonus(stems: list[str], roles: Column) -> Column:
    served = [r for r, words in fixed.ROLE_COLUMN_WORDS.items() if set(stems) & set(words)]
    return F.size(F.array_intersect(roles, word_set(served))) * 5.0 if served else F.lit(0.0)


def _best(columns: list[str], score) -> Column:
    """Column with the highest positive score, the first of equals; NULL when there is none."""
    if not columns:
        return F.lit(None).cast("string")
    top = F.array_max(F.array(*[
        F.struct(score(c).alias("s"), F.lit(-i).alias("first"), F.lit(c).alias("c"))
        for i, c in enumerate(columns)
    ]))
    return F.transform(F.array(top), lambda t: F.when(t["s"] > 0, t["c"]))[0]


def pick_columns(features: DataFrame, columns: list[str], numeric: set[str]) -> DataFrame:
    """Adds metric, group and answer column, the final mode and whether to group."""
    numbers = [c for c in columns if c in numeric]
    others = [c for c in columns if c not in numeric]
    joined = features.withColumn("stems", F.array_join("tokens", " ")).withColumn(
        "hint_tokens", stem_tokens(F.coalesce("group_hint", F.lit("")))
    )
    tokens, stems, roles = F.col("tokens"), F.col("stems"), F.col("roles")
    hinted, hint_stems = F.col("hint_tokens"), F.array_join("hint_tokens", " ")

    words = column_stems(features, columns)
    # Without a named one, the column with most metric words, the last by name of equals.
    by_words = sorted(
        numbers, key=lambda c: (len(set(words[c]) & set(fixed.METRIC_WORDS)), c.lower())
    )
    fallback = F.lit(by_words[-1] if by_words else None).cast("string")
    metric = F.coalesce(_best(numbers, lambda c: _overlap(words[c], tokens, stems)), fallback)
    said = _best(
        others, lambda c: _overlap(words[c], tokens, stems) + _role_bonus(words[c], roles)
    )
    picked = joined.select(
        "*",
        metric.alias("metric"),
        _best(others, lambda c: _overlap(words[c], hinted, hint_stems)).alias("hinted_column"),
        said.alias("said_column"),
    )
    first = F.lit(others[0]) if others else F.lit(None).cast("string")
    own_metric = F.lit(False)
    for c in numbers:
        own_metric = own_metric | (
            (F.col("metric") == c) & _has(tokens, words[c])
        )
    # "How many boxes" asks for a sum once the metric is named.
    named = F.col("metric").isNotNull() & (own_metric | F.col("names_metric"))
    mode = F.when((F.col("word_mode") == "count") & named, "sum").otherwise(F.col("word_mode"))
    group = F.coalesce("hinted_column", "said_column")
    chosen = picked.select(
        *features.columns,
        F.when(F.col("is_analytic"), mode).alias("mode"),
        F.col("metric").alias("picked_metric"),
        F.when(mode.isin("sum", "avg", "rank"), F.col("metric")).alias("metric_column"),
        group.alias("group_column"),
        F.coalesce("said_column", first).alias("answer_column"),
    )
    use = F.col("group_column").isNotNull() & (
        ((F.col("mode") == "rank") & ~F.col("single_row"))
        | F.col("has_group_phrase")
        | (F.col("top_n") > 1)
    )
    return chosen.withColumn("use_grouping", F.coalesce(use, F.lit(False)))


# ── filters ───────────────────────────────────────────────────────────────────


def link_explicit_filters(features: DataFrame, columns: list[str]) -> DataFrame:
    """(qid, column, value, score) for `column is value` phrases."""
    found = []
    for i, c in enumerate(columns):
        name = " ".join(re.sub(r"[^a-z0-9% ]+", " ", c.lower()).split())
        if not name:
            continue
        given = F.regexp_extract("phrase", rf"\b{re.escape(name)}{VALUE_GIVEN}", 1)
        value = F.btrim(F.regexp_replace(given, VALUE_ENDS, ""), F.lit(" ,.'\""))
        found.append(F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("column"), value.alias("value")))
    listed = features.select("qid", F.inline(F.array(*found))).where("value <> ''")
    return listed.select(
        "qid", "column_index", "column", "value", (F.length("value") + 100.0).alias("score")
    )


def _ngrams(words: Column, sizes: Column | None = None) -> Column:
    """All runs of words as text; `sizes` restricts the run lengths."""
    n_words = F.size(words)
    sizes = F.sequence(F.lit(1), n_words) if sizes is None else sizes
    runs = F.flatten(F.transform(
        F.filter(sizes, lambda n: n <= n_words),
        lambda n: F.transform(
            F.sequence(F.lit(1), n_words - n + 1),
            lambda i: F.array_join(F.slice(words, i, n), " "),
        ),
    ))
    return F.array_distinct(runs)


def _cell_values(table: DataFrame, columns: list[str]) -> Column:
    """Array of (column_index, column, value, phrase) of a row's filled cells."""
    return F.filter(
        F.array(*[
            F.struct(
                F.lit(i).alias("column_index"), F.lit(c).alias("column"),
                F.col(f"`{c}`.normalized").alias("value"),
                normalize_phrase(F.col(f"`{c}`.normalized")).alias("phrase"),
            )
            for i, c in enumerate(columns)
        ]),
        lambda x: x["value"].isNotNull(),
    )


def link_value_filters(
    features: DataFrame, table: DataFrame, columns: list[str], numeric: set[str]
) -> DataFrame:
    """(qid, column, value, score) for cell values said in the question as whole phrases.

    Questions are cut into word runs; a cell value is looked up among them by an equi-join, so
    only values some question says are ever grouped.
    """
    asked = features.select("phrase").distinct().where("phrase <> ''")
    runs = asked.select("phrase", F.explode(_ngrams(F.split("phrase", " "))).alias("run"))
    text_columns = [(i, c) for i, c in enumerate(columns) if c not in numeric]
    if not text_columns:
        return link_explicit_filters(features.limit(0), columns)
    values = table.select(
        "row_index", F.inline(_cell_values(table, [c for _, c in text_columns]))
    ).withColumnRenamed("phrase", "run")
    usable = values.where(
        (F.length("run") >= 2) & ~F.col("run").isin(fixed.STOP_WORDS) & ~F.col("run").rlike(r"^[0-9./\\-]+$")
    )
    said = usable.join(small_side(runs.select("run").distinct()), "run", "left_semi")
    known = said.groupBy("run", "column_index", "column").agg(
        F.min("row_index").alias("first_row"), F.max_by("value", "row_index").alias("value")
    )
    # At most as many rows per value as the table has columns.
    of_value = Window.partitionBy("run")
    seen = F.struct("first_row", "column_index")
    kept = (
        known.withColumn("seen", seen)
        .withColumn("value_seen", F.min("seen").over(of_value))
        .withColumn("nth", F.row_number().over(of_value.orderBy("seen")))
        .where("nth <= 3")
    )
    said_tokens = F.lit(False)
    for c, stems in column_stems(features, [c for _, c in text_columns]).items():
        said_tokens = said_tokens | ((F.col("column") == c) & _has(F.col("tokens"), stems))
    found = (
        features.select("qid", "phrase", "tokens")
        .join(runs.join(kept, "run"), "phrase")
        .withColumn(
            "score",
            F.size(F.split("run", " ")) * 5.0 + F.length("run") + F.when(said_tokens, 3.0).otherwise(0.0),
        )
    )
    return found.select("qid", "column", "value", "score", "value_seen", "seen")


def link_filters(
    features: DataFrame, table: DataFrame, columns: list[str], numeric: set[str]
) -> DataFrame:
    """Best value per column, best three columns: (qid, filters ARRAY<STRUCT<column, value>>)."""
    explicit = link_explicit_filters(features, columns).select(
        "qid", "column", "value", "score",
        F.struct(F.lit(0).alias("k"), F.col("column_index").cast("bigint").alias("a"), F.lit(0).alias("b"),
                 F.lit(0).cast("bigint").alias("c"), F.lit(0).alias("d")).alias("place"),
    )
    values = link_value_filters(features, table, columns, numeric).select(
        "qid", "column", "value", "score",
        F.struct(F.lit(1).alias("k"), F.col("value_seen.first_row").alias("a"),
                 F.col("value_seen.column_index").alias("b"), F.col("seen.first_row").alias("c"),
                 F.col("seen.column_index").alias("d")).alias("place"),
    )
    best = explicit.unionByName(values).groupBy("qid", "column").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "place", "value")).alias("b")
    )
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("b.s", "b.place", "column", "b.value"))), 1, 3)
    return best.groupBy("qid").agg(
        F.transform(ranked, lambda f: F.struct(f["column"].alias("column"), f["value"].alias("value"))).alias("filters")
    )


def apply_phrase_filters(table: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """Rows whose named cells equal the values or hold them as whole phrases."""
    for column, value in filters:
        held = normalize_phrase(F.col(f"`{column}`.normalized"))
        table = table.where(contains_phrase(held, normalize_phrase(F.lit(value))))
    return table


# ── the three kinds of answers, for one plan ──────────────────────────────────


def _proof(metric: Column) -> dict[str, Column]:
    row = F.col("row_index")
    return {
        "rows": F.count(F.lit(1)),
        "metric_rows": F.count(metric),
        "total": F.sum(metric),
        "highest": F.max(F.when(metric.isNotNull(), F.struct(metric.alias("m"), (-row).alias("r")))),
        "lowest": F.min(F.when(metric.isNotNull(), F.struct(metric.alias("m"), row.alias("r")))),
        "first_row": F.min(row),
        "first_metric_row": F.min(F.when(metric.isNotNull(), row)),
    }


def group_label(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(BLANK_GROUP))


def rank_groups_with_source(
    table: DataFrame, group: str, metric: str | None = None, aggregation: str = "sum",
    operator: str = "max", top_n: int = 1,
) -> DataFrame:
    """Best groups with, for each, the row holding its most extreme metric."""
    value = cells.numeric_value(F.col(f"`{metric}`")) if metric else F.lit(None).cast("double")
    rows = table.select("row_index", group_label(F.col(f"`{group}`.normalized")).alias("group_value"),
                        value.alias("__m"))
    if aggregation != "count":
        rows = rows.where(F.col("__m").isNotNull())
    stats = rows.groupBy("group_value").agg(*[c.alias(n) for n, c in _proof(F.col("__m")).items()])
    result = {"count": F.col("rows").cast("double"), "avg": F.col("total") / F.col("metric_rows"),
              "sum": F.col("total")}[aggregation]
    source = F.col("lowest.r") if operator == "min" else -F.col("highest.r")
    value = F.col("metric_value")
    order = value.asc() if operator == "min" else value.desc()
    return (
        stats.select("group_value", result.alias("metric_value"),
                     F.coalesce(source, "first_row").alias("source_row_index"), "first_row")
        .orderBy(order, "first_row")
        .limit(max(1, top_n))
        .drop("first_row")
    )


def rank_single_row(table: DataFrame, metric: str, answer: str | None, operator: str = "max") -> DataFrame:
    """The row with the extreme metric, the earliest of equals, and its answer cell."""
    value = cells.numeric_value(F.col(f"`{metric}`"))
    shown = F.col(f"`{answer}`.normalized") if answer else F.lit(None).cast("string")
    row = F.struct("row_index", value.alias("metric_value"), shown.alias("answer_value"))
    key = F.struct(value.alias("m"), (F.col("row_index") * (1 if operator == "min" else -1)).alias("r"))
    pick = F.min_by if operator == "min" else F.max_by
    best = table.where(value.isNotNull()).agg(pick(row, key).alias("b"))
    return best.where(F.col("b").isNotNull()).select(
        F.col("b.row_index").alias("source_row_index"), "b.metric_value", "b.answer_value"
    )


def aggregate_with_source(table: DataFrame, mode: str, metric: str | None = None) -> DataFrame:
    """count, sum or avg with the first row, or the row with the largest metric."""
    value = cells.numeric_value(F.col(f"`{metric}`")) if metric else F.lit(None).cast("double")
    stats = table.agg(*[c.alias(n) for n, c in _proof(value).items()])
    result = {"count": F.col("rows").cast("double"), "sum": F.col("total"),
              "avg": F.col("total") / F.nullif("metric_rows", F.lit(0))}[mode]
    source = F.col("first_row") if mode == "count" else -F.col("highest.r")
    return stats.where(result.isNotNull()).select(
        result.alias("metric_value"), source.alias("source_row_index"),
        F.col("rows").alias("matched_rows"),
    )


# ── all questions at once ─────────────────────────────────────────────────────


def plan_questions(
    questions: DataFrame, table: DataFrame, columns: list[str], numeric: set[str]
) -> DataFrame:
    """Features, picks and filters of every analytic question, and the key of its plan."""
    features = question_features(questions)
    picked = pick_columns(features, columns, numeric).where(F.col("mode").isNotNull())
    filters = link_filters(features, table, columns, numeric)
    none = F.array().cast("array<struct<column:string,value:string>>")
    joined = picked.join(filters, "qid", "left").withColumn("filters", F.coalesce("filters", none))
    group = F.when(F.col("use_grouping"), F.col("group_column"))
    return joined.withColumn("plan_group", group).withColumn(
        "plan_id", F.to_json(F.struct("filters", "metric_column", "plan_group"))
    )


def _matched(plans: DataFrame, table: DataFrame, columns: list[str], numeric: set[str]) -> DataFrame:
    """(plan_id, metric_column, plan_group, row_index, nums, texts): rows of every plan."""
    numbers = [c for c in columns if c in numeric]
    nums = F.map_from_arrays(F.array(*[F.lit(c) for c in numbers]).cast("array<string>"),
                             F.array(*[cells.numeric_value(F.col(f"`{c}`")) for c in numbers]).cast("array<double>"))
    texts = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                              F.array(*[F.col(f"`{c}`.normalized") for c in columns]))
    payload = table.select("row_index", nums.alias("nums"), texts.alias("texts"),
                           _cell_values(table, columns).alias("__cells"))

    # Plans without filters: distinct (metric, group) pairs, so no more than column pairs.
    free = plans.where(F.size("filters") == 0)
    specs = free.agg(F.collect_set(F.struct("plan_id", "metric_column", "plan_group")).alias("s")).scalar()
    everywhere = payload.drop("__cells").withColumn("__p", F.explode(specs)).select(
        "__p.plan_id", "__p.metric_column", "__p.plan_group", "row_index", "nums", "texts"
    )

    wanted = plans.select(
        "plan_id", "metric_column", "plan_group", F.size("filters").alias("n"), F.explode("filters").alias("f")
    ).select("plan_id", "metric_column", "plan_group", "n", F.col("f.column").alias("column"),
             normalize_phrase(F.col("f.value")).alias("run")).where("run <> ''")
    sizes = wanted.agg(F.collect_set(F.size(F.split("run", " "))).alias("l")).scalar()
    runs = payload.withColumn("__sizes", F.coalesce(sizes, F.array().cast("array<int>"))).select(
        "row_index", "nums", "texts", "__cells", "__sizes", F.inline("__cells")
    ).select("row_index", "nums", "texts", "__cells", "column",
             F.explode(_ngrams(F.split("phrase", " "), F.col("__sizes"))).alias("run"))
    hits = runs.join(small_side(wanted), ["column", "run"])
    pick = ["plan_id", "metric_column", "plan_group", "row_index", "nums", "texts"]
    one = hits.where("n = 1").select(*pick)
    # Of plans with more filters a row must meet all; filters of a plan differ in their columns. A row is
    # found by one of them, of the column that plans name most values of, and looked at for the others,
    # so that nothing is gathered.
    together = wanted.where("n > 1")
    varied = together.groupBy("column").agg(F.countDistinct("run").alias("values"))
    all_of = (
        together.join(F.broadcast(varied), "column").groupBy("plan_id", "metric_column", "plan_group", "n")
        .agg(F.max(F.struct("values", "column", "run")).alias("__by"), F.collect_list(F.struct("column", "run")).alias("__all"))
        .where(F.size("__all") == F.col("n"))
        .select("plan_id", "metric_column", "plan_group", "__by.column", "__by.run", "__all")
    )
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    met = F.forall("__all", lambda f: F.exists(
        "__cells", lambda c: (c["column"] == f["column"]) & F.contains(pad(c["phrase"]), pad(f["run"]))))
    # Rows under one number count as one row, which none of them may be.
    again = table.groupBy("row_index").count().where("count > 1").select(F.col("row_index").alias("__again"))
    again = materialize(again, "again")
    alone, many = runs, None
    if not again.isEmpty():
        few, same = small_side(again), F.col("row_index").eqNullSafe(F.col("__again"))
        alone = runs.join(few, same, "left_anti")
        many = (
            runs.join(few, same, "left_semi").join(small_side(wanted), ["column", "run"])
            .where("n > 1").groupBy("plan_id", "row_index")
            .agg(F.count(F.lit(1)).alias("__met"), F.first("n").alias("n"),
                 *[F.first(c).alias(c) for c in ("metric_column", "plan_group", "nums", "texts")])
            .where("__met = n").select(*pick)
        )
    found = alone.join(small_side(all_of), ["column", "run"]).where(met).select(*pick)
    many = found if many is None else found.unionByName(many)
    return everywhere.unionByName(one).unionByName(many)


def answer_questions(
    questions: DataFrame, table: DataFrame, columns: list[str] | None = None,
    numeric: set[str] | None = None,
) -> DataFrame:
    """One row per analytic question: what was computed, the answer, and the proving row."""
    columns = columns or cells.value_columns(table)
    if numeric is None:
        numeric = {c for c, v in inference.verdicts(
            inference.detect_numeric_columns(table, columns)).items() if v}
    # Read by several steps below: written once instead of being worked out again for each.
    planned = materialize(plan_questions(questions, table, columns, numeric), "plans")
    plans = planned.select("plan_id", "filters", "metric_column", "plan_group").distinct()

    rows = _matched(plans, table, columns, numeric).select(
        "plan_id", "metric_column", "plan_group", "row_index",
        F.try_element_at("nums", F.col("metric_column")).alias("__m"),
        F.when(F.col("plan_group").isNotNull(),
               group_label(F.try_element_at("texts", F.col("plan_group")))).alias("group_value"),
    )
    stats = materialize(
        rows.groupBy("plan_id", "group_value").agg(
            *[c.alias(n) for n, c in _proof(F.col("__m")).items()]
        ),
        "plan-stats",
    )
    sizes = stats.groupBy("plan_id").agg(F.sum("rows").alias("matched_rows"))
    asked = planned.join(sizes, "plan_id", "left").withColumn(
        "matched_rows", F.coalesce("matched_rows", F.lit(0))
    )

    # Modes of one plan rank its groups differently, but there are few modes.
    kinds = planned.select("plan_id", "mode", "operator", "rank_aggregation", "metric_column").distinct()
    counting = F.col("mode") == "count"
    averaging = (F.col("mode") == "avg") | (F.col("rank_aggregation") == "avg")
    grouped = F.col("group_value").isNotNull()
    single = (F.col("mode") == "rank") & ~grouped
    lowest = F.col("operator") == "min"
    extreme = F.when(lowest, F.col("lowest.m")).otherwise(F.col("highest.m"))
    result = (
        F.when(counting, F.col("rows").cast("double")).when(single, extreme)
        .when(averaging, F.col("total") / F.nullif("metric_rows", F.lit(0))).otherwise(F.col("total"))
    )
    source = F.when(counting, F.col("first_row")).when(
        lowest, F.col("lowest.r")
    ).otherwise(-F.col("highest.r"))
    seen = F.when(counting, F.col("first_row")).otherwise(F.col("first_metric_row"))
    scored = (
        stats.join(kinds, "plan_id").where(counting | (F.col("metric_rows") > 0))
        .select("plan_id", "mode", "operator", "rank_aggregation", "group_value",
                result.alias("metric_value"), source.alias("source_row_index"), seen.alias("seen"))
    )
    kind = ["plan_id", "mode", "operator", "rank_aggregation"]
    ascending = F.coalesce((F.col("mode") == "rank") & lowest, F.lit(False))
    order = F.when(ascending, F.col("metric_value")).otherwise(-F.col("metric_value"))
    ranked = scored.withColumn(
        "place", F.row_number().over(Window.partitionBy(*kind).orderBy(order, "seen"))
    ).where(F.col("place") <= fixed.TOP_N_LIMIT)
    entry = F.struct("place", "group_value", "metric_value", "source_row_index")
    tops = ranked.groupBy(*kind).agg(F.array_sort(F.collect_list(entry)).alias("tops"))

    left, right = asked.alias("a"), tops.alias("t")
    same = F.col("a.plan_id") == F.col("t.plan_id")
    for c in ("mode", "operator", "rank_aggregation"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = left.join(right, same, "left").select("a.*", "t.tops")
    best = joined.withColumn("best", F.try_element_at("tops", F.lit(1)))
    single_answer = (F.col("mode") == "rank") & ~F.col("use_grouping")
    needs = best.select(
        "qid", F.col("best.source_row_index").alias("row_index"), "answer_column"
    ).where(single_answer & F.col("row_index").isNotNull())
    # Few rows are looked up: one per distinct single-row answer.
    looked = small_side(needs.select("row_index").distinct())
    values = table.join(looked, "row_index", "left_semi").select(
        "row_index", F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                                       F.array(*[F.col(f"`{c}`.normalized") for c in columns])).alias("__v"))
    named = needs.join(values, "row_index").select(
        "qid", F.nullif(F.trim(F.try_element_at("__v", F.col("answer_column"))), F.lit("")).alias("answer_value"))
    full = best.join(named, "qid", "left")
    return full.select(
        "qid", F.col("mode").alias("operation"), "metric_column",
        F.when(F.col("use_grouping"), F.col("group_column")).alias("group_by_column"),
        F.col("best.group_value").alias("group_value"), F.col("best.metric_value").alias("metric_value"),
        "operator", "top_n", "filters", "matched_rows",
        F.col("best.source_row_index").alias("source_row_index"),
        F.when(single_answer, F.col("answer_column")).alias("answer_column"), "answer_value",
        _answer_text().alias("answer"),
    )


def _answer_text() -> Column:
    """The sentence that states an answer."""
    show = lambda c: format_number_display(c)
    value, mode = F.col("best.metric_value"), F.col("mode")
    direction = F.when(F.col("operator") == "min", "lowest").otherwise("highest")
    averaging = (mode == "avg") | F.coalesce(F.col("rank_aggregation") == "avg", F.lit(False))
    label = F.when(averaging, "average").when(mode == "count", "count").otherwise("total")
    measured = F.when(mode == "count", "rows").otherwise(F.col("metric_column"))
    tops = F.slice("tops", F.lit(1), F.col("top_n"))
    listed = F.array_join(
        F.transform(tops, lambda t: F.concat(t["place"].cast("string"), F.lit(") "), t["group_value"],
                                             F.lit(" ("), show(t["metric_value"]), F.lit(")"))), "; ")
    group, top_value = F.col("group_column"), F.col("best.group_value")
    the = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    grouped = (
        F.when(F.col("top_n") > 1,
               the("Top ", F.size(tops).cast("string"), " ", group, " by ", label, " ", measured, ": ", listed, "."))
        .when(mode == "count",
              the("The ", group, " with the highest count is ", top_value, " (", show(value), " rows)."))
        .otherwise(the("The ", group, " with the ", F.when(mode == "rank", direction).otherwise("highest"),
                       " ", label, " ", F.col("metric_column"), " is ", top_value, " (", show(value), ")."))
    )
    row = F.col("best.source_row_index").cast("string")
    by_row = F.when(
        F.col("answer_value").isNotNull(),
        the("The ", direction, " ", F.col("metric_column"), " in a single row is ", show(value), " by ",
            F.col("answer_column"), " ", F.col("answer_value"), " (row ", row, ")."),
    ).otherwise(the("The ", direction, " ", F.col("metric_column"), " is ", show(value), " (row ", row, ")."))
    return (
        F.when(F.col("matched_rows") == 0, "No rows matched the requested filters.")
        .when(F.col("best").isNull(), F.lit(None).cast("string"))
        .when(F.col("use_grouping"), grouped)
        .when(mode == "count", the("There are ", show(value), " matching rows."))
        .when(mode == "rank", by_row)
        .otherwise(the("The ", label, " ", F.col("metric_column"), " is ", show(value), "."))
    )


# ── verification ──────────────────────────────────────────────────────────────


def verify_answers(
    answers: DataFrame, results: DataFrame, table: DataFrame, dataset_id: int
) -> DataFrame:
    """Checks each answer against the rows it cites.

    answers (qid, source_row_index, operation, group_by_column, answer_column, answer_value,
    metric_column, metric_value, citation), results (qid, row_index). Adds the failed checks.
    """
    from tabulith.operators.citations import parse_citation

    columns = cells.value_columns(table)
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                               F.array(*[F.col(f"`{c}`.normalized") for c in columns]))
    numbers = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                                F.array(*[cells.numeric_value(F.col(f"`{c}`")) for c in columns]))
    rows = table.select(F.col("row_index").alias("source_row_index"), values.alias("__v"), numbers.alias("__n"))
    shown = results.select("qid", F.col("row_index").alias("source_row_index"),
                           F.lit(True).alias("__shown")).distinct()
    cited = answers.withColumn("__c", parse_citation(F.col("citation")))
    there = table.select(F.col("row_index").alias("__cited"), F.lit(True).alias("__there"))
    joined = (
        cited.join(rows, "source_row_index", "left")
        .join(shown, ["qid", "source_row_index"], "left")
        .withColumn("__cited", F.when(F.col("__c.dataset_id") == dataset_id, F.col("__c.row_index")))
        .join(there, "__cited", "left")
    )
    exists = F.coalesce(F.col("__there"), F.lit(False)) & F.col("__c.column").isin(columns)
    same_text = F.trim(F.try_element_at("__v", F.col("answer_column"))) == F.trim("answer_value")
    single = (F.col("operation") == "rank") & F.col("group_by_column").isNull()
    close = F.abs(F.try_element_at("__n", F.col("metric_column")) - F.col("metric_value")) < 1e-9
    failed = {
        "source_row_missing": F.col("source_row_index").isNotNull() & ~F.coalesce("__shown", F.lit(False)),
        "answer_value_differs": F.col("answer_column").isNotNull() & F.col("answer_value").isNotNull()
        & ~F.coalesce(same_text, F.lit(False)),
        "rank_metric_differs": single & F.col("metric_column").isNotNull() & F.col("metric_value").isNotNull()
        & ~F.coalesce(close, F.lit(False)),
        "citation_missing": F.col("citation").isNotNull() & ~F.coalesce(exists, F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(test, name) for name, test in failed.items()]))
    return joined.select(
        "qid", F.when(F.size(reasons) == 0, "pass").otherwise("fail").alias("status"), reasons.alias("errors")
    )
