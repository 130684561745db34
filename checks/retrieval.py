"""Vector search, keyword search and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import rules as R
from checks.fixtures import base, fixture, people, with_
from tabulith.functions import text
from tabulith.operators import citations, vectors
from tabulith.session import spread

PEOPLE_WITH = with_("fx_people", cells=R.PEOPLE_CELLS)


def rows(s, sf):
    """Vectors as search rows; the text is a word made of the label's letter."""
    letter = F.chr(F.lit(97) + F.col("label"))
    return spread(base(s, sf, "embeddings")).select(
        F.col("vec_id").alias("row_index"), F.col("label").cast("bigint").alias("dataset_id"), "embedding",
        F.concat(F.lit("label: "), F.repeat(letter, F.lit(3))).alias("text"))


def centroids(s, sf):
    """Mean vector of each label: as many queries as labels, however many rows."""
    parts = base(s, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    letter = F.chr(F.lit(97) + (F.col("label") + 1) % 10)
    return mean.groupBy("label").agg(ordered.alias("embedding")).select(
        F.col("label").cast("bigint").alias("query_id"), "embedding",
        F.concat(F.lit("what is "), F.repeat(letter, F.lit(3)), F.lit("?")).alias("question"))


def shown(hits, *more):
    return hits.select("query_id", "row_index", F.round("score", 5).alias("score"),
                       F.col("rank").cast("bigint").alias("rank"), *more)


def embed_rows(s, sf):
    docs = spread(base(s, sf, "documents")).select(F.col("doc_id").alias("row_index"), "text")
    blank = docs.select((-F.col("row_index") - 1).alias("row_index"), F.lit("").alias("text"))
    made = vectors.embed_rows(docs.unionByName(blank))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return made.select("row_index", F.size("embedding").cast("bigint").alias("width"), F.round(square, 4).alias("square"))


def semantic_documents(s, sf):
    docs = vectors.embed_rows(spread(base(s, sf, "documents")).select(F.col("doc_id").alias("row_index"), "text"))
    asked = vectors.embed_text(base(s, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")), "question")
    return shown(vectors.semantic_search(docs, asked, 5), F.col("pass").cast("int").alias("pass"))


def ann(s, sf):
    return shown(vectors.ann_topk(rows(s, sf), centroids(s, sf), 10))


def project(s, sf):
    hits = vectors.cosine_topk(rows(s, sf), centroids(s, sf), 3)
    return shown(vectors.semantic_project(hits, rows(s, sf).withColumnRenamed("dataset_id", "label"), ["label", "text", "label"]), "label", "text")


def keyword_counts(s, sf):
    docs = spread(base(s, sf, "documents")).select(F.col("doc_id").alias("row_index"), "text")
    asked = base(s, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return vectors.keyword_match_counts(docs, asked)


def keyword_filter(s, sf):
    docs = spread(base(s, sf, "documents"))
    return docs.where(vectors.keyword_match(F.col("text"), "Who wrote about the heneation, theren or ouque?")).select("doc_id")


def pairs(s, sf):
    """Every question with the row it was made from and the row after."""
    q = fixture(s, sf, "fx_questions").select("qid", F.explode(F.array(F.col("qid"), F.col("qid") + 1)).alias("row_index"))
    return q


def highlights(s, sf):
    found = citations.score_highlights(pairs(s, sf), people(s, sf), fixture(s, sf, "fx_questions"))
    return found.select("qid", "row_index", "column", "value", F.round("relevance", 6).alias("relevance"))


def fallback(s, sf):
    found = citations.fallback_highlight(pairs(s, sf), people(s, sf), fixture(s, sf, "fx_questions"))
    return found.select("qid", "row_index", "column", "value", "relevance")


def cited(s, sf):
    found = citations.cite_results(pairs(s, sf), people(s, sf), fixture(s, sf, "fx_questions"), 5)
    return found.select("qid", "row_index", "top_citation", F.size("highlights").cast("bigint").alias("n"),
                        F.array_join(F.transform("highlights", lambda h: h["column"]), ",").alias("cited_columns"))


def citation_ids(s, sf):
    """A citation per person: right, of another dataset, of an unknown column, or malformed."""
    p = fixture(s, sf, "fx_people")
    k = F.col("row_index") % 5
    return p.select(
        "row_index",
        F.when(k == 0, F.concat(F.lit("d5_r"), "row_index", F.lit("_segment")))
        .when(k == 1, F.concat(F.lit("d5_r"), F.col("row_index") + 1, F.lit("_nation")))
        .when(k == 2, F.concat(F.lit("d6_r"), "row_index", F.lit("_segment")))
        .when(k == 3, F.concat(F.lit("d5_r"), "row_index", F.lit("_first_name")))
        .otherwise(F.concat(F.lit("d5_"), "row_index", F.lit("_segment"))).alias("citation")).drop("row_index")


def parsed(s, sf):
    return citation_ids(s, sf).withColumn("c", citations.parse_citation(F.col("citation"))).select("citation", "c.*")


def looked_up(s, sf):
    return citations.lookup_citation(citation_ids(s, sf), people(s, sf), 5).select("citation", "value", "exists")


def targets(s, sf):
    """Per nation one request: its first person's citation, then all of its people's."""
    p = fixture(s, sf, "fx_people")
    cid = F.concat(F.lit("d"), (F.col("row_index") % 2).cast("string"), F.lit("_r"), (F.floor(F.col("row_index") / 2)).cast("string"), F.lit("_name"))
    listed = p.groupBy(F.col("nation").alias("request_id")).agg(
        F.sort_array(F.collect_list(F.struct("row_index", cid.alias("c")))).alias("l"))
    return citations.citation_targets(listed.select(
        "request_id", F.col("l")[0]["c"].alias("primary"),
        F.array_join(F.transform("l", lambda x: x["c"]), "| ,").alias("targets"))).select(
            "request_id", F.col("position").cast("bigint").alias("position"), "dataset_id", "row_index", F.col("column").alias("target"))


QUERIES = {
    "embed_rows": embed_rows,
    "cosine_topk": lambda s, sf: shown(vectors.cosine_topk(rows(s, sf).drop("dataset_id"), centroids(s, sf), 10)),
    "cosine_topk_scoped": lambda s, sf: shown(vectors.cosine_topk(
        rows(s, sf), centroids(s, sf).withColumn("dataset_id", (F.col("query_id") + 3) % 10), 10)),
    "ann_topk": ann,
    # Vectors without clusters, and queries unlike the rows that the number of probes rests on.
    "ann_recall": lambda s, sf: vectors.ann_recall(rows(s, sf), centroids(s, sf), 10, recall=0.995).select(
        "query_id", "wanted", (F.col("recall") >= 0.9).alias("enough"), (F.col("scored_share") <= 1).alias("share_known")),
    "keyword_match": keyword_filter,
    "keyword_match_counts": keyword_counts,
    "semantic_search": lambda s, sf: shown(vectors.semantic_search(
        rows(s, sf).drop("dataset_id"), centroids(s, sf), 100), F.col("pass").cast("int").alias("pass")),
    "semantic_search_documents": semantic_documents,
    "semantic_project": project,
    "score_highlights": highlights,
    "fallback_highlight": fallback,
    "cite_results": cited,
    "parse_citation": parsed,
    "lookup_citation": looked_up,
    "citation_targets": targets,
}

_CENTROIDS = """c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, round(avg(x), 6) AS x FROM
  (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
_SCORES = f"""WITH {_CENTROIDS}, s AS (SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS row_index, e.label AS label,
  list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.v) AS score, e.label = (c.label + 1) % 10 AS matched
  FROM embeddings e CROSS JOIN c)"""


def ranked(where: str, order: str, k: int, more: str = "") -> str:
    return _SCORES + (
        f", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} row_index) AS rank FROM s WHERE {where}) "
        f"SELECT query_id, row_index, round(score, 5) AS score, rank{more} FROM r WHERE rank <= {k}")


_COLS = ["name", "nation", "region", "segment", "balance"]
_CELL = " UNION ALL ".join(
    f"SELECT row_index, {i} AS i, '{c}' AS c, {c} AS v FROM cells" for i, c in enumerate(_COLS))
_PAIRS = """SELECT qid, qid AS row_index, question FROM fx_questions UNION ALL SELECT qid, qid + 1, question FROM fx_questions"""
_TOK = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> ''))"
_HI = dict(
    cells=R.PEOPLE_CELLS, u=_CELL, pr=_PAIRS,
    t=f"""SELECT pr.qid, pr.row_index, question, i, c, v, {_TOK('question')} AS qt, {R.keywords('question')} AS kw, {_TOK('v')} AS vt,
  list_distinct({R.stems('question')}) AS qs, list_distinct({R.stems('c')}) AS cs, list_distinct({R.stems('v')}) AS vs
  FROM pr JOIN u ON u.row_index = pr.row_index WHERE v IS NOT NULL""",
    sh="SELECT *, list_intersect(qt, vt) AS shared FROM t",
    h="""SELECT qid, row_index, i, c, v, (2.0::DOUBLE * len(list_filter(shared, lambda x: list_contains(kw, x))) +
  0.5::DOUBLE * len(list_filter(shared, lambda x: NOT list_contains(kw, x)))) / greatest(len(qt), 1) AS relevance FROM sh WHERE len(shared) > 0""",
    f="""SELECT qid, row_index, i, c, v FROM (SELECT *, row_number() OVER (PARTITION BY qid, row_index ORDER BY
  2 * len(list_intersect(cs, qs)) + len(list_intersect(vs, qs)) DESC, i) AS k FROM t) WHERE k = 1""",
)
_HI_WITH = with_("fx_questions", **_HI)
_CIDS = """SELECT CASE row_index % 5 WHEN 0 THEN 'd5_r' || row_index || '_segment' WHEN 1 THEN 'd5_r' || (row_index + 1) || '_nation'
 WHEN 2 THEN 'd6_r' || row_index || '_segment' WHEN 3 THEN 'd5_r' || row_index || '_first_name'
 ELSE 'd5_' || row_index || '_segment' END AS citation FROM fx_people"""
_PARSED = r"""SELECT citation, TRY_CAST(nullif(regexp_extract(citation, '^d(\d+)_r(\d+)_(.+)$', 1), '') AS BIGINT) AS dataset_id,
 TRY_CAST(nullif(regexp_extract(citation, '^d(\d+)_r(\d+)_(.+)$', 2), '') AS BIGINT) AS row_index,
 nullif(regexp_extract(citation, '^d(\d+)_r(\d+)_(.+)$', 3), '') AS "column" FROM ids"""
_DOC_TOKENS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}]+')"

ORACLES = {
    "embed_rows": "SELECT doc_id AS row_index, CAST(384 AS BIGINT) AS width, 1.0::DOUBLE AS square FROM documents WHERE text <> ''",
    "cosine_topk": ranked("true", "score DESC,", 10),
    "cosine_topk_scoped": ranked("label = (query_id + 3) % 10", "score DESC,", 10),
    "ann_recall": """SELECT CAST(label AS BIGINT) AS query_id, CAST(10 AS BIGINT) AS wanted, true AS enough, true AS share_known
 FROM embeddings GROUP BY label""",
    "keyword_match": f"SELECT doc_id FROM documents WHERE list_has_any({_DOC_TOKENS}, ['wrote','heneation','theren','ouque'])",
    "keyword_match_counts": f"""WITH d AS (SELECT doc_id, list_distinct({_DOC_TOKENS}) AS t FROM documents),
 q AS (SELECT item_id, {R.keywords('text')} AS k FROM benchmark)
SELECT item_id AS query_id, CAST(count(*) FILTER (list_has_any(t, k)) AS BIGINT) AS matches FROM d CROSS JOIN q GROUP BY 1""",
    "semantic_search": ranked("true", "matched DESC, score DESC,", 100, ", CAST(CASE WHEN matched THEN 1 ELSE 2 END AS INT) AS pass"),
    "semantic_project": ranked("true", "score DESC,", 3, ", CAST(label AS BIGINT) AS label, 'label: ' || repeat(chr(CAST(97 + label AS INT)), 3) AS text"),
    "score_highlights": _HI_WITH + 'SELECT qid, row_index, c AS "column", v AS "value", round(relevance, 6) AS relevance FROM h',
    "fallback_highlight": _HI_WITH + 'SELECT qid, row_index, c AS "column", v AS "value", 1.0::DOUBLE AS relevance FROM f',
    "cite_results": _HI_WITH + """, al AS (SELECT qid, row_index, i, c, relevance, 1 AS src FROM h UNION ALL SELECT qid, row_index, i, c, 1.0, 2 FROM f
  WHERE (qid, row_index) NOT IN (SELECT (qid, row_index) FROM h))
SELECT qid, row_index, 'd5_r' || row_index || '_' || first(c ORDER BY relevance DESC, i) AS top_citation, count(*) AS n,
 string_agg(c, ',' ORDER BY relevance DESC, i) AS cited_columns FROM al GROUP BY 1, 2""",
    "parse_citation": with_("fx_people", ids=_CIDS) + _PARSED,
    "lookup_citation": with_("fx_people", cells=R.PEOPLE_CELLS, u=_CELL, ids=_CIDS, p=_PARSED) + """
SELECT p.citation, u.v AS "value", u.c IS NOT NULL AS "exists" FROM p LEFT JOIN u ON p.dataset_id = 5 AND u.row_index = p.row_index AND u.c = p."column" """,
    "citation_targets": with_("fx_people") + """, a AS (SELECT nation AS request_id, row_index, row_index % 2 AS dataset_id, CAST(floor(row_index / 2) AS BIGINT) AS r,
  first_value(row_index % 2) OVER (PARTITION BY nation ORDER BY row_index) AS d0 FROM fx_people)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY row_index) - 1 AS position, dataset_id, r AS row_index, 'name' AS target
 FROM a WHERE dataset_id = d0""",
}
