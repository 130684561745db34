"""Ranked lexical search: a block index, short lists summed first, long lists walked with skipping.

Index. Documents are dealt into blocks of at most 2048 documents; every block has, per term, the
list of its documents' places with the term's occurrences, packed, and one row with document ids
and lengths. Every term of every document is indexed; the index is a stored table (`index`).

Search. Lists are joined with the terms of the queries, which carry their weight and the queries
that ask for them, and meet by (group of at most some 256 queries, block). In a block, a query's
short lists (at most an eighth of the block's documents) are summed term at a time into
accumulators. These then stand as one iterator beside the long lists: windows of 64 documents have
the largest accumulator and each long list's largest contribution as bounds, and windows are taken
in document order, those whose bounds cannot reach the k-th best score being skipped; in a window,
lists are read in falling order of their bound, and documents that can no longer reach it are left.
A task carries its k best per query from block to block and hands on only those; a window function
keeps k of all tasks. The result is exact, ties go to the smaller doc_id.

NULL and empty texts have no terms and are not counted. A NULL doc_id ranks behind equal scores.
Repeated rows are documents of their own. Texts of any length are split a piece at a time. Queries
are told apart by id and text: repeated rows are answered once, queries without terms not at all.
Empty tables on either side give no rows. Extra columns are not carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabulith.llm.common import lower_ascii, materialize, table, word_pieces

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Each byte of UTF-8: letters in lower case, digits, and what is not ASCII; else a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))
TOP, BLOCK_DOCS, BLOCK_TERMS, WINDOW, STRIDE, QUERIES_PER_GROUP = 50, 2048, 1 << 20, 64, 8, 256
INDEX = "block long, term string, n long, places binary, counts binary, ids array<long>, n_terms long"


def terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.regexp_extract_all(
        lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


class _Block:
    """Documents gathered until their lists are written."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.vocabulary: dict[bytes, int] = defaultdict(lambda: len(self.vocabulary))
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, text: str) -> None:
        found, length = [], 0
        for piece in word_pieces(text.encode("utf-8", "surrogatepass").translate(BYTES)):
            at = np.fromiter(map(self.vocabulary.__getitem__, piece), np.int32, len(piece))
            found.append(np.unique(at, return_counts=True))
            length += len(at)
        if not length:
            return
        term, n = found[0]
        if len(found) > 1:
            term, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.lists.append((term, n))
        self.size += len(term)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.size >= BLOCK_TERMS

    def rows(self) -> pa.RecordBatch:
        term = np.concatenate([t for t, _ in self.lists])
        count = np.concatenate([n for _, n in self.lists]).astype("<u4")
        place = np.repeat(np.arange(len(self.lists), dtype="<u2"), [len(t) for t, _ in self.lists])
        order = np.argsort(term, kind="stable")
        length = np.bincount(term, minlength=len(self.vocabulary))
        ends = np.concatenate([[0], np.cumsum(length)])

        def packed(values: np.ndarray) -> pa.Array:
            offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes())
            data = pa.py_buffer(values[order].tobytes())
            return pa.concat_arrays([
                pa.Array.from_buffers(pa.binary(), len(length), [None, offsets, data]),
                pa.array([np.asarray(self.lengths, "<i8").tobytes()
                          if values.itemsize == 4 else None], pa.binary())])

        names = pa.array([*self.vocabulary, b""], pa.binary()).cast(pa.string())
        n_rows = len(names)
        ids = pa.array([None] * (n_rows - 1) + [self.ids], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number] * n_rows, pa.int64()), names,
             pa.array([*length.tolist(), len(self.ids)], pa.int64()), packed(place), packed(count),
             ids, pa.array([None] * (n_rows - 1) + [sum(self.lengths)], pa.int64())],
            ["block", "term", "n", "places", "counts", "ids", "n_terms"])


def index(docs: DataFrame) -> DataFrame:
    """The stored index of documents (doc_id, text): a row per block and term, and a row per block
    with an empty term that holds the documents' ids and lengths."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                block.add(doc_id, text.as_py() or "")
                if block.full():
                    yield block.rows()
                    number += 1
                    block = _Block(number)
        if block.ids:
            yield block.rows()

    return materialize(rows.mapInArrow(run, INDEX), "lexical")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(group, rows) for each run of rows with equal group and block."""
    held: list[pa.RecordBatch] = []

    def close() -> tuple[int, list[dict]]:
        rows = [r for b in held for r in b.to_pylist()]
        held.clear()
        return rows[0]["part"], rows

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != tuple(keys[:, a]):
                yield close()
            held.append(b.slice(a, z - a))
    if held:
        yield close()


class _Best:
    """The k best documents of a query so far: scores, ids, and which ids are NULL."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, np.empty((3, 0), np.int64)
        self.least = 1  # a score below this cannot enter

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        found = np.concatenate([self.found, np.stack([scores, ids, nulls])], axis=1)
        if found.shape[1] > self.k:
            found = found[:, np.lexsort((found[1], found[2], -found[0]))[:self.k]]
        self.found = found
        if found.shape[1] == self.k:
            self.least = max(1, int(found[0].min()))


def contributions(places: np.ndarray, counts: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    tf = counts.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))


def search_block(short: list, long: list, n_docs: int, best: _Best, ids: np.ndarray, nulls: np.ndarray) -> int:
    """Take a block's documents into `best`; returns how many documents were scored.

    `short` has (places, contributions), `long` has (dense contributions, bounds by window)."""
    summed = np.zeros(-(-n_docs // WINDOW) * WINDOW, np.int64)
    for places, gain in short:
        summed[places] += gain
    if not long:
        at = np.flatnonzero(summed >= best.least)
        if len(at):
            best.add(summed[at], ids[at], nulls[at])
        return len(at)
    long = sorted(long, key=lambda x: -int(x[1].max()))
    bounds = np.stack([b for _, b in long])
    rest = np.concatenate([np.cumsum(bounds[::-1], axis=0)[::-1], np.zeros((1, bounds.shape[1]), np.int64)])
    bound = summed.reshape(-1, WINDOW).max(1) + rest[0]
    live, scored = np.flatnonzero(bound >= best.least), 0
    for i in range(0, len(live), STRIDE):
        some = live[i:i + STRIDE]
        some = some[bound[some] >= best.least]  # it has risen meanwhile
        at = (some[:, None] * WINDOW + np.arange(WINDOW)).ravel()
        score = summed[at]
        for j, (gain, _) in enumerate(long):
            may = score + rest[j][at // WINDOW] >= best.least
            if not may.all():
                at, score = at[may], score[may]
            if not len(at):
                break
            score = score + gain[at]
        enough = score >= best.least
        scored += len(at)
        if enough.any():
            at = at[enough]
            best.add(score[enough], ids[at], nulls[at])
    return scored


def _ranked(k: int, n_docs: int, n_terms: int):
    def emit(best: dict[int, _Best]) -> pa.RecordBatch:
        rows = [(q, s, None if null else d) for q, b in best.items() for s, d, null in b.found.T.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query", "score", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        group = None
        for part, rows in _units(batches):
            if part != group:
                yield emit(best)
                best, group = {}, part
            # Repeated ids of a query stand for one; a list stands once per unit.
            head = next(r for r in rows if not r["term"])
            known = [x is None for x in head["ids"]]
            ids = np.array([x or 0 for x in head["ids"]], np.int64)
            nulls = np.array(known, np.int64)
            lengths = np.frombuffer(head["counts"], "<i8")
            m = 50 + (50 * lengths * n_docs) // n_terms
            wide = -(-len(ids) // WINDOW) * WINDOW
            lists: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for r in rows:
                if not r["term"] or not r["weight"]:
                    continue
                places = np.frombuffer(r["places"], "<u2")
                gain = contributions(places, np.frombuffer(r["counts"], "<u4"), m, r["weight"])
                if len(places) * 8 > len(ids):
                    dense = np.zeros(wide, np.int64)
                    dense[places] = gain
                    entry, kind = (dense, dense.reshape(-1, WINDOW).max(1)), 1
                else:
                    entry, kind = (places, gain), 0
                for q in r["queries"]:
                    lists[q][kind].append(entry)
            for q, (short, long) in lists.items():
                search_block(short, long, len(ids), best.setdefault(q, _Best(k)), ids, nulls)
        yield emit(best)

    return run


def search(stored: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the stored index for each of the
    `queries` (item_id, text)."""
    spark = stored.sparkSession
    asked = materialize(queries.select(
        "item_id", F.xxhash64("item_id", "text").alias("query"), terms(F.col("text")).alias("terms"))
        .distinct(), "queries")
    heads = stored.where("term = ''")
    n_docs, n_terms = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    groups = max(1, -(-asked.count() // QUERIES_PER_GROUP))
    wanted = asked.select(F.pmod("query", F.lit(groups)).cast("int").alias("part"), "query",
                          F.explode("terms").alias("term"))
    lists = stored.where("term <> ''")
    df = lists.select("term", "n").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = materialize(
        wanted.groupBy("part", "term").agg(F.collect_set("query").alias("queries"))
        .join(df.select("term", weight.alias("weight")), "term"), "query-terms")
    unit = ["part", "block", "term", "places", "counts", "ids", "weight", "queries"]
    met = lists.join(weighed, "term").select(*unit).unionByName(
        heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        .select(*unit[:6], F.lit(None).cast("long").alias("weight"),
                F.lit(None).cast("array<long>").alias("queries")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (
        met.repartition(parts, "part", "block").sortWithinPartitions("part", "block")
        .mapInArrow(_ranked(k, n_docs, n_terms), "query long, score long, doc_id long")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_lexical_search": op11_lexical_search}

_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLES = {"op11_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
stats AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), stats),
lengths AS (SELECT rid, doc_id, 50 + (50 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, stats),
scores AS (
  SELECT item_id, doc_id, rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN p USING (term) JOIN lengths USING (rid)
  GROUP BY item_id, doc_id, rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS rank
      FROM scores WHERE score > 0)
WHERE rank <= {TOP}
"""}
