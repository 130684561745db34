"""Question answering: every person's row makes one question."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import rules as R
from checks.fixtures import PEOPLE, fixture, people, with_
from tabulith.operators import questions as Q

NUMERIC = {"balance"}
PEOPLE_WITH = with_("fx_people", cells=R.PEOPLE_CELLS)


def asked(s, sf):
    return fixture(s, sf, "fx_questions")


def features(s, sf):
    return Q.question_features(asked(s, sf))


def shown_features(s, sf):
    return features(s, sf).select(
        "qid", "is_analytic", "word_mode", "operator", "rank_aggregation", "names_metric",
        F.col("top_n").cast("int").alias("top_n"), "single_row", "group_hint", "has_group_phrase",
        F.concat_ws(",", "roles").alias("roles"))


def picks(s, sf):
    return Q.pick_columns(features(s, sf), PEOPLE, NUMERIC).select(
        "qid", "mode", "picked_metric", "metric_column", "group_column", "answer_column", "use_grouping")


def explicit(s, sf):
    return Q.link_explicit_filters(features(s, sf), PEOPLE).select("qid", "column", "value", "score")


def values(s, sf):
    return Q.link_value_filters(features(s, sf), people(s, sf), PEOPLE, NUMERIC).select("qid", "column", "value", "score")


def linked(s, sf):
    found = Q.link_filters(features(s, sf), people(s, sf), PEOPLE, NUMERIC)
    return found.select("qid", F.array_join(F.transform("filters", lambda f: F.concat(f["column"], F.lit("="), f["value"])), ";").alias("filters"))


def answers(s, sf):
    return Q.answer_questions(asked(s, sf), people(s, sf), PEOPLE)


def shown_answers(modes, grouped=None):
    def run(s, sf):
        a = answers(s, sf).where(F.col("operation").isin(modes))
        if grouped is not None:
            a = a.where(F.col("group_by_column").isNotNull() if grouped else F.col("group_by_column").isNull())
        return a.select("qid", "operation", "group_by_column", "group_value", F.round("metric_value", 4).alias("metric_value"),
                        "matched_rows", "source_row_index", "answer_column", "answer_value", "answer")
    return run


def verified(s, sf):
    a = fixture(s, sf, "fx_answers").select(
        "qid", "source_row_index", F.lit("rank").alias("operation"), F.lit(None).cast("string").alias("group_by_column"),
        F.lit("name").alias("answer_column"), "answer_value", F.lit("balance").alias("metric_column"), "metric_value",
        F.concat(F.lit("d5_r"), "source_row_index", F.lit("_name")).alias("citation"), "k")
    results = a.where(F.col("k") != 4).select("qid", F.col("source_row_index").alias("row_index"))
    return Q.verify_answers(a, results, people(s, sf), 5).select("qid", "status", F.concat_ws(",", "errors").alias("errors"))


def rounded(df):
    return df.withColumn("metric_value", F.round("metric_value", 2))


QUERIES = {
    "question_features": shown_features,
    "pick_columns": picks,
    "link_explicit_filters": explicit,
    "link_value_filters": values,
    "link_filters": linked,
    "apply_phrase_filters": lambda s, sf: Q.apply_phrase_filters(
        people(s, sf), [("segment", "Building"), ("nation", "land")]).select("row_index"),
    "rank_groups_with_source": lambda s, sf: rounded(Q.rank_groups_with_source(people(s, sf), "nation", "balance", "avg", "max", 5)),
    "rank_groups_lowest": lambda s, sf: rounded(Q.rank_groups_with_source(people(s, sf), "segment", "balance", "sum", "min", 3)),
    "rank_single_row": lambda s, sf: Q.rank_single_row(people(s, sf), "balance", "name", "min"),
    "aggregate_with_source": lambda s, sf: rounded(Q.aggregate_with_source(people(s, sf), "avg", "balance")),
    "count_with_source": lambda s, sf: rounded(Q.aggregate_with_source(people(s, sf), "count")),
    "answer_questions": shown_answers(["rank", "count", "sum", "avg"]),
    "answer_rank": shown_answers(["rank"], True),
    "answer_single_row": shown_answers(["rank"], False),
    "answer_count": shown_answers(["count"]),
    "answer_sum": shown_answers(["sum"]),
    "answer_avg": shown_answers(["avg"]),
    "verify_answers": verified,
}

# What each kind of question asks for, stated by its kind rather than by reading it again.
_K = "SELECT q.qid, q.qid % 8 AS kind, q.question, p.nation, p.segment FROM fx_questions q JOIN cells p ON p.row_index = q.qid"
_N = "(CASE WHEN abs(v - round(v)) < 1e-9 THEN format('{:,}', CAST(round(v) AS BIGINT)) ELSE format('{:,.2f}', v) END)"
_ANSWERS = f"""
 SELECT qid, 'sum' AS operation, NULL AS g, NULL AS gv, v, n, src, NULL AS ac, NULL AS av, 'The total balance is ' || {_N} || '.' AS answer FROM
  (SELECT qid, t.* FROM k JOIN (SELECT nation, sum(balance_number) AS v, count(*) AS n, arg_max(row_index, (balance_number, -row_index)) AS src FROM cells GROUP BY 1) t ON t.nation = k.nation WHERE kind = 0)
 UNION ALL
 SELECT qid, 'rank', 'segment', segment, v, n, src, NULL, NULL, 'The segment with the highest total balance is ' || segment || ' (' || {_N} || ').' FROM
  (SELECT qid, t.* EXCLUDE (nation) FROM k JOIN (SELECT nation, segment, sum(balance_number) AS v, arg_max(row_index, (balance_number, -row_index)) AS src, sum(count(*)) OVER (PARTITION BY nation) AS n,
    row_number() OVER (PARTITION BY nation ORDER BY sum(balance_number) DESC, min(row_index)) AS r FROM cells GROUP BY 1, 2) t ON t.nation = k.nation AND r = 1 WHERE kind = 1)
 UNION ALL
 SELECT qid, 'count', NULL, NULL, v, CAST(v AS BIGINT), src, NULL, NULL, 'There are ' || {_N} || ' matching rows.' FROM
  (SELECT qid, t.* FROM k JOIN (SELECT segment, CAST(count(*) AS DOUBLE) AS v, min(row_index) AS src FROM cells GROUP BY 1) t ON t.segment = k.segment WHERE kind = 2)
 UNION ALL
 SELECT qid, 'rank', 'nation', first(nation ORDER BY r), first(v ORDER BY r), max(n), first(src ORDER BY r), NULL, NULL,
  'Top ' || count(*) || ' nation by average balance: ' || string_agg(r || ') ' || nation || ' (' || {_N} || ')', '; ' ORDER BY r) || '.' FROM
  (SELECT qid, t.* FROM k JOIN (SELECT nation, avg(balance_number) AS v, arg_max(row_index, (balance_number, -row_index)) AS src, sum(count(*)) OVER () AS n,
    row_number() OVER (ORDER BY avg(balance_number) DESC, min(row_index)) AS r FROM cells GROUP BY 1) t ON r <= 3 WHERE kind = 3) GROUP BY qid
 UNION ALL
 SELECT qid, 'rank', NULL, NULL, v, n, src, 'name', name, 'The lowest balance in a single row is ' || {_N} || ' by name ' || name || ' (row ' || src || ').' FROM
  (SELECT qid, t.* FROM k JOIN (SELECT segment, balance_number AS v, row_index AS src, name, count(*) OVER (PARTITION BY segment) AS n,
    row_number() OVER (PARTITION BY segment ORDER BY balance_number, row_index) AS r FROM cells) t ON t.segment = k.segment AND r = 1 WHERE kind = 4)
 UNION ALL
 SELECT qid, 'avg', NULL, NULL, v, n, src, NULL, NULL, 'The average balance is ' || {_N} || '.' FROM
  (SELECT qid, t.* FROM k JOIN (SELECT nation, segment, avg(balance_number) AS v, count(*) AS n, arg_max(row_index, (balance_number, -row_index)) AS src FROM cells GROUP BY 1, 2) t
   ON t.nation = k.nation AND t.segment = k.segment WHERE kind = 5)
 UNION ALL
 SELECT qid, 'sum', 'region', region, v, n, src, NULL, NULL, 'The region with the highest total balance is ' || region || ' (' || {_N} || ').' FROM
  (SELECT qid, t.* EXCLUDE (segment) FROM k JOIN (SELECT segment, region, sum(balance_number) AS v, arg_max(row_index, (balance_number, -row_index)) AS src, sum(count(*)) OVER (PARTITION BY segment) AS n,
    row_number() OVER (PARTITION BY segment ORDER BY sum(balance_number) DESC, min(row_index)) AS r FROM cells GROUP BY 1, 2) t ON t.segment = k.segment AND r = 1 WHERE kind = 6)"""


def answered(where: str) -> str:
    return with_("fx_questions", cells=R.PEOPLE_CELLS, k=_K, a=_ANSWERS) + (
        "SELECT qid, operation, CAST(g AS VARCHAR) AS group_by_column, CAST(gv AS VARCHAR) AS group_value, round(v, 4) AS metric_value, "
        "CAST(n AS BIGINT) AS matched_rows, src AS source_row_index, CAST(ac AS VARCHAR) AS answer_column, CAST(av AS VARCHAR) AS answer_value, answer FROM a WHERE " + where)


_KIND = "CASE kind " + "{}" + " END"


def by_kind(values: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_QK = with_("fx_questions", cells=R.PEOPLE_CELLS, k=_K)
ORACLES = {
    "question_features": _QK + "SELECT qid, kind <> 7 AS is_analytic, "
    + by_kind(["'sum'", "'rank'", "'count'", "'rank'", "'rank'", "'avg'", "'count'", "NULL"]) + " AS word_mode, "
    + by_kind(["NULL", "'max'", "NULL", "'max'", "'min'", "NULL", "NULL", "NULL"]) + " AS operator, "
    + by_kind(["NULL", "'sum'", "NULL", "'avg'", "'sum'", "NULL", "NULL", "NULL"]) + " AS rank_aggregation, "
    "kind IN (0, 6) AS names_metric, CASE WHEN kind = 3 THEN 3 ELSE 1 END AS top_n, kind = 4 AS single_row, "
    "CASE kind WHEN 1 THEN 'segment' WHEN 3 THEN 'average' END AS group_hint, kind IN (1, 3, 6) AS has_group_phrase, "
    + by_kind(["''", "''", "'location'", "''", "''", "''", "'location'", "'person'"]) + " AS roles FROM k",
    "pick_columns": _QK + "SELECT qid, "
    + by_kind(["'sum'", "'rank'", "'count'", "'rank'", "'rank'", "'avg'", "'sum'", "NULL"]) + " AS mode, 'balance' AS picked_metric, "
    "CASE WHEN kind NOT IN (2, 7) THEN 'balance' END AS metric_column, "
    + by_kind(["NULL", "'segment'", "'region'", "'nation'", "NULL", "NULL", "'region'", "'name'"]) + " AS group_column, "
    + by_kind(["'name'", "'segment'", "'region'", "'nation'", "'name'", "'name'", "'region'", "'name'"]) + " AS answer_column, "
    "kind IN (1, 3, 6) AS use_grouping FROM k",
    "link_explicit_filters": _QK + "SELECT qid, 'segment' AS \"column\", segment AS \"value\", 100.0::DOUBLE + length(segment) AS score FROM k WHERE kind = 2",
    "link_value_filters": _QK + """, c AS (SELECT qid, question, 'segment' AS c, segment AS v FROM k WHERE kind IN (2, 4, 5, 6) UNION ALL SELECT qid, question, 'nation', nation FROM k WHERE kind IN (0, 1, 5, 7))
SELECT qid, c AS "column", v AS "value", len(string_split(v, ' ')) * 5.0::DOUBLE + length(v) + CASE WHEN contains(lower(question), c) THEN 3 ELSE 0 END AS score FROM c""",
    "link_filters": _QK + """SELECT qid, CASE WHEN kind = 5 THEN CASE WHEN 5 + length(segment) > 10 + length(nation) THEN 'segment=' || segment || ';nation=' || nation ELSE 'nation=' || nation || ';segment=' || segment END
 WHEN kind IN (0, 1, 7) THEN 'nation=' || nation ELSE 'segment=' || segment END AS filters FROM k WHERE kind <> 3""",
    "apply_phrase_filters": PEOPLE_WITH + "SELECT row_index FROM cells WHERE segment = 'building' AND nation LIKE 'Land %'",
    "rank_groups_with_source": PEOPLE_WITH + """SELECT nation AS group_value, round(avg(balance_number), 2) AS metric_value, arg_max(row_index, (balance_number, -row_index)) AS source_row_index
 FROM cells GROUP BY 1 ORDER BY avg(balance_number) DESC, min(row_index) LIMIT 5""",
    "rank_groups_lowest": PEOPLE_WITH + """SELECT segment AS group_value, round(sum(balance_number), 2) AS metric_value, arg_min(row_index, (balance_number, row_index)) AS source_row_index
 FROM cells GROUP BY 1 ORDER BY sum(balance_number), min(row_index) LIMIT 3""",
    "rank_single_row": PEOPLE_WITH + "SELECT row_index AS source_row_index, balance_number AS metric_value, name AS answer_value FROM cells ORDER BY balance_number, row_index LIMIT 1",
    "aggregate_with_source": PEOPLE_WITH + "SELECT round(avg(balance_number), 2) AS metric_value, arg_max(row_index, (balance_number, -row_index)) AS source_row_index, count(*) AS matched_rows FROM cells",
    "count_with_source": PEOPLE_WITH + "SELECT CAST(count(*) AS DOUBLE) AS metric_value, min(row_index) AS source_row_index, count(*) AS matched_rows FROM cells",
    "answer_questions": answered("true"),
    "answer_rank": answered("operation = 'rank' AND g IS NOT NULL"),
    "answer_single_row": answered("operation = 'rank' AND g IS NULL"),
    "answer_count": answered("operation = 'count'"),
    "answer_sum": answered("operation = 'sum'"),
    "answer_avg": answered("operation = 'avg'"),
    "verify_answers": with_("fx_answers", cells=R.PEOPLE_CELLS) + """SELECT a.qid, CASE WHEN e = '' THEN 'pass' ELSE 'fail' END AS status, e AS errors FROM (
 SELECT a.qid, concat_ws(',', CASE WHEN a.k = 4 THEN 'source_row_missing' END,
  CASE WHEN c.name IS DISTINCT FROM a.answer_value THEN 'answer_value_differs' END,
  CASE WHEN c.balance_number IS NULL OR abs(c.balance_number - a.metric_value) >= 1e-9 THEN 'rank_metric_differs' END,
  CASE WHEN c.row_index IS NULL THEN 'citation_missing' END) AS e FROM fx_answers a LEFT JOIN cells c ON c.row_index = a.source_row_index) a""",
}

for _name, _column in (("pick_metric_column", "picked_metric"), ("pick_group_column", "group_column"),
                       ("pick_answer_column", "answer_column")):
    QUERIES[_name] = lambda s, sf, c=_column: picks(s, sf).select("qid", c)
    ORACLES[_name] = f"SELECT qid, {_column} FROM ({ORACLES['pick_columns']})"
