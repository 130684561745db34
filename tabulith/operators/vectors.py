"""Row vectors: embedding, exact and approximate nearest rows, keyword-first search.

Nearest rows are found where the rows are: each task multiplies its batches with the query
matrix, keeps the best k per query, and only those meet in a window per query. No pair of row
and query is ever written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulith import fixed
from tabulith.functions.text import extract_keywords, word_tokens
from tabulith.session import materialize

# A query set up to this size is sent to every task; a larger one is joined block by block.
QUERY_BLOCK = 4096
SLICE_ROWS = 100_000


# ── embedding ─────────────────────────────────────────────────────────────────


def embed_text(df: DataFrame, text: str = "text", width: int = fixed.EMBEDDING_WIDTH) -> DataFrame:
    """Adds `embedding`: token counts hashed into `width` buckets, scaled to length 1."""
    tokens = df.withColumn("__tokens", F.array_compact(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+")))
    counted = HashingTF(numFeatures=width, inputCol="__tokens", outputCol="__counts").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="__counts", outputCol="__unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop(
        "__tokens", "__counts", "__unit"
    )


def embed_with(df: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """Adds `embedding` from a model called once per Arrow batch of texts."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(embed(batch.column(names.index(text)).to_pylist()), dtype="float32")
            values = pa.array(vectors.ravel())
            offsets = pa.array(np.arange(len(vectors) + 1, dtype="int32") * vectors.shape[1])
            lists = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "embedding"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", embedding array<float>"
    return df.mapInArrow(run, schema)


def embed_rows(rows: DataFrame, embed: Callable | None = None) -> DataFrame:
    """(…, text) to vectors; rows without text have none."""
    filled = rows.where(F.coalesce("text", F.lit("")) != "")
    return embed_with(filled, embed) if embed else embed_text(filled)


# ── top-k inside one task ─────────────────────────────────────────────────────


class _Queries:
    """Query vectors (scaled to length 1, by width), keywords and scopes, whichever are given."""

    def __init__(self, columns: dict[str, list]):
        self.ids = np.asarray(columns["query_id"], dtype="int64")
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if "embedding" in columns:
            width = np.array([len(v) for v in columns["embedding"]], dtype="int64")
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                self.by_width[w] = (at, _unit(np.array([columns["embedding"][i] for i in at], dtype="float64")))
        scopes = columns.get("dataset_id")
        self.scopes = None if scopes is None else np.asarray(scopes, dtype="int64")
        if "keywords" in columns:
            # The queries of each word: a list per word, no words x queries matrix.
            lists: dict[str, list[int]] = {}
            for q, k in enumerate(columns["keywords"]):
                for w in k:
                    lists.setdefault(w, []).append(q)
            self.words = pa.array(list(lists), pa.string())
            self.ends = np.cumsum([0, *map(len, lists.values())])
            self.uses = np.array([q for found in lists.values() for q in found], dtype="int64")

    def matched(self, tokens: pa.ListArray) -> np.ndarray:
        """rows x queries: whether the row holds any keyword of the query."""
        found = pc.index_in(tokens.flatten(), value_set=self.words)
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        row, word = row[hit], found.to_numpy(zero_copy_only=False)[hit].astype("int64")
        # Each hit stands for the word's queries, one after the other.
        n = self.ends[word + 1] - self.ends[word]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros((len(tokens), len(self.ids)), dtype=bool)
        out[np.repeat(row, n), self.uses[np.repeat(self.ends[word], n) + within]] = True
        return out


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(lists), -1)


class _Best:
    """Best k rows per query so far, by (matched, score) descending, then row index."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.least = np.full(queries, -np.inf)
        self.held = [(np.empty(0, dtype="int64"), np.empty(0, dtype="int64"), np.empty(0))]
        self.size = 0

    def add(self, row_index: np.ndarray, keys: np.ndarray) -> None:
        """`keys`: rows x queries; -inf where the pair does not count."""
        bar = self.least
        if len(keys) > self.k:
            bar = np.maximum(bar, np.partition(keys, len(keys) - self.k, axis=0)[len(keys) - self.k])
        row, query = np.nonzero((keys >= bar) & (keys > -np.inf))
        self.held.append((query, row_index[row], keys[row, query]))
        self.size += len(row)
        if self.size > max(1 << 18, 4 * self.k * len(self.least)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row index, key) of the best k of each query."""
        query, row, key = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((row, -key, query))
        query, row, key = query[order], row[order], key[order]
        start = np.searchsorted(query, query)  # of the query's first row
        place = np.arange(len(query)) - start
        last = place == self.k - 1
        self.least[query[last]] = key[last]
        keep = place < self.k
        self.held = [(query[keep], row[keep], key[keep])]
        self.size = int(keep.sum())
        return self.held[0]


# Rows scored at once: bounds the rows x queries matrix held in memory.
_STEP = 2048
# Cosines lie in [-1, 1]; adding this to matched rows ranks them before all others.
_MATCHED = 4.0


def _score(q: _Queries, best: _Best, batch: pa.RecordBatch, mode: str) -> None:
    """Rows meet queries of their own width only; others are not comparable."""
    width = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    for w, (asked, matrix) in q.by_width.items():
        fits = batch if (width == w).all() else batch.filter(pa.array(width == w))
        for at in range(0, fits.num_rows, _STEP):
            part = fits.slice(at, _STEP)
            found = _unit(_matrix(pa.concat_arrays([part.column("embedding")]))) @ matrix.T
            keys = found
            if len(asked) < len(q.ids):
                keys = np.full((len(found), len(q.ids)), -np.inf)
                keys[:, asked] = found
            if mode != "plain":
                matched = q.matched(pa.concat_arrays([part.column("tokens")]))
                keys = np.where(matched, keys + _MATCHED, keys if mode == "prefer" else -np.inf)
            if q.scopes is not None:
                scope = part.column("dataset_id").to_numpy(zero_copy_only=False).astype("int64")
                keys = np.where(scope[:, None] == q.scopes[None, :], keys, -np.inf)
            best.add(part.column("row_index").to_numpy(zero_copy_only=False).astype("int64"), keys)


_HITS = "query_id bigint, row_index bigint, matched boolean, score double"


def _emit(q: _Queries, best: _Best) -> pa.Table:
    query, rows, keys = best.cut()
    matched = keys > _MATCHED / 2
    return pa.table(
        {"query_id": q.ids[query], "row_index": rows, "matched": matched,
         "score": np.where(matched, keys - _MATCHED, keys)}
    )


def _per_block(
    rows: DataFrame, queries: DataFrame, work: Callable[[_Queries, Iterator], pa.Table], schema: str
) -> DataFrame:
    """Run `work` on every part of the rows with every block of the queries.

    Few queries (counted first) go to every task. More are cut into blocks and the rows into
    slices, every slice meeting every block in a task of its own: the copies shuffled are
    rows x blocks + queries x slices, never rows x queries.
    """
    head = queries.limit(QUERY_BLOCK + 1).collect()
    if len(head) <= QUERY_BLOCK:
        columns = {c: [r[c] for r in head] for c in queries.columns}
        shared = rows.sparkSession.sparkContext.broadcast(_Queries(columns) if head else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if shared.value is not None:
                yield from work(shared.value, batches).to_batches()

        return rows.mapInArrow(run, schema)

    slices = max(1, -(-rows.count() // SLICE_ROWS))
    blocks = -(-queries.count() // QUERY_BLOCK)
    hashed = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("slice", hashed("row_index", slices)).withColumn("block", all_of(blocks))
    right = queries.withColumn("block", hashed("query_id", blocks)).withColumn("slice", all_of(slices))
    empty = work(_Queries({"query_id": [], "embedding": []}), iter(()))

    def run_pair(part: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return empty
        return work(_Queries(asked.to_pydict()), iter(part.to_batches()))

    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(
        run_pair, schema
    )


def comparable(df: DataFrame) -> DataFrame:
    """The rows (or queries) with a vector of numbers. Others find nothing and are never found."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return df.where((F.size("embedding") > 0) & ~odd)


def _search(vectors: DataFrame, queries: DataFrame, k: int, mode: str) -> DataFrame:
    """Exact best k per query. `mode`: plain, prefer (matched rows first), only (matched rows)."""
    scoped = "dataset_id" in queries.columns and "dataset_id" in vectors.columns
    keep = ["row_index", "embedding"]
    ask = [F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding")]
    if mode != "plain":
        keep.append("tokens")
        ask.append(F.col("keywords"))
    if scoped:
        keep.append("dataset_id")
        ask.append(F.col("dataset_id").cast("bigint").alias("dataset_id"))

    def work(q: _Queries, batches: Iterator[pa.RecordBatch]) -> pa.Table:
        best = _Best(len(q.ids), k)
        for batch in batches:
            _score(q, best, batch, mode)
        return _emit(q, best)

    hits = _per_block(comparable(vectors).select(*keep), comparable(queries).select(*ask), work, _HITS)
    order = Window.partitionBy("query_id").orderBy(
        F.col("matched").desc(), F.col("score").desc(), "row_index"
    )
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _check_k(k: int) -> int:
    return max(1, int(k))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, row_index, score, rank): the k nearest rows by cosine, ties by row index.

    A `dataset_id` on both sides restricts a query to the rows of its dataset. Queries without a
    vector have no row in the result; vectors of different widths never meet.
    """
    return _search(vectors, queries, _check_k(k), "plain").drop("matched")


def semantic_search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows holding a keyword of the question first, then any others, each by cosine.

    rows (row_index, text, embedding), queries (query_id, question, embedding). Filling the
    places the keyword pass leaves empty is the same as ranking by (matched, score).
    """
    tokens = rows.withColumn("tokens", word_tokens(F.col("text")))
    asked = queries.withColumn("keywords", F.array_distinct(extract_keywords(F.col("question"))))
    hits = _search(tokens, asked, _check_k(k), "prefer")
    return hits.withColumn("pass", F.when(F.col("matched"), 1).otherwise(2)).drop("matched")


# ── approximate search ────────────────────────────────────────────────────────


SAMPLE_ROWS, LISTS, LIST_ROWS, SAMPLE_QUERIES = 20_000, 1024, 50_000, 200


class Inverted(NamedTuple):
    """Rows filed under the nearest of some centres."""

    rows: DataFrame  # list, slice, row_index, embedding of length 1; stored
    centres: np.ndarray
    slices: DataFrame  # list, slices, n
    probes: int


def _nearest(centres: np.ndarray, n: int):
    """Adds `lists`, the numbers of the n nearest centres, to rows with a unit `embedding`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                near = _matrix(pa.concat_arrays([part.column("embedding")])) @ centres.T
                lists = np.argsort(-near, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(lists.astype("int32")), pa.list_(pa.int32()))],
                    [*part.schema.names, "lists"])

    return run


def _filed(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", lists array<int>"
    return df.mapInArrow(_nearest(centres, n), schema)


def _unit_rows(df: DataFrame, width: int, *columns: str) -> DataFrame:
    """Rows with a vector of the given width, scaled to length 1."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = F.when(length > 0, F.transform("embedding", lambda x: x.cast("double") / length)).otherwise(
        F.col("embedding").cast("array<double>"))
    return comparable(df).where(F.size("embedding") == width).select(*columns, unit.alias("embedding"))


def _recall(sample: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The share of true neighbours found with 1, 2, … lists, of some of the sample's rows."""
    asked = sample[:SAMPLE_QUERIES]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argsort(-near, axis=1)[:, :k]
    home = np.argmax(sample @ centres.T, axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list in the order of a query's probes
    needed = np.take_along_axis(place, home[true], axis=1)
    return np.array([(needed < n + 1).mean() for n in range(len(centres))])


def ann_index(
    vectors: DataFrame, k: int = 10, lists: int | None = None, recall: float = 0.98, seed: int = 42
) -> Inverted:
    """File the rows (row_index, embedding) under their nearest centre.

    The centres come from k-means over a bounded sample of rows (SAMPLE_ROWS), about the square
    root of the row count of them, LISTS at most. How many lists a query should look into is read
    off the same sample: the fewest that find the wanted share of its rows' true neighbours. Data
    without any clusters needs most lists, which says that nothing can be skipped there. A list with
    many rows is cut into slices, so that no task holds a whole one. The most common width counts.
    """
    spark = vectors.sparkSession
    known = comparable(vectors)
    common = known.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if common is None:
        raise ValueError("no vectors to index")
    width, n = common
    rows = _unit_rows(vectors, width, F.col("row_index").cast("bigint").alias("row_index"))
    some = rows.sample(min(1.0, SAMPLE_ROWS / n), seed=seed).limit(2 * SAMPLE_ROWS)
    lists = min(LISTS, lists or max(1, round(n ** 0.5)), n)
    fitted = some.select(array_to_vector("embedding").alias("features"))
    centres = _unit(np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(fitted).clusterCenters()))
    sample = _unit(np.array([r[0] for r in some.select("embedding").collect()]))
    reached = _recall(sample, centres, min(k, max(1, len(sample) - 1)))
    enough = np.flatnonzero(reached >= recall)
    probes = int(enough[0]) + 1 if len(enough) else len(centres)
    filed = _filed(rows, centres, 1).select(F.col("lists")[0].alias("list"), "row_index", "embedding")
    counts = materialize(filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select(
        "list", "n", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("slices")), "ann-lists")
    placed = filed.join(F.broadcast(counts.select("list", "slices")), "list").select(  # a row per centre
        "list", F.pmod(F.xxhash64("row_index"), "slices").cast("int").alias("slice"), "row_index", "embedding")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(placed.repartition(parts, "list", "slice").sortWithinPartitions("list", "slice"), "ann-rows")
    return Inverted(stored, centres, counts, probes)


def ann_search(index: Inverted, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, row_index, score, rank): the nearest rows among those in the lists that a query
    looks into. Rows and queries meet by an equi-join on (list, slice); nothing else is scored."""
    asked = _unit_rows(queries, index.centres.shape[1], F.col("query_id").cast("bigint").alias("query_id"))
    meant = _filed(asked, index.centres, probes or index.probes).select(
        "query_id", "embedding", F.explode("lists").alias("list"))
    meant = meant.join(index.slices, "list").select(
        "query_id", "embedding", "list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """Of one slice of a list: the best k rows of each of its queries."""
        q = _Queries({"query_id": asked.column("query_id").to_pylist(),
                      "embedding": asked.column("embedding").to_pylist()})
        best = _Best(len(q.ids), k)
        if len(q.ids):
            for batch in rows.to_batches():
                _score(q, best, batch, "plain")
        return _emit(q, best)

    hits = index.rows.groupBy("list", "slice").cogroup(meant.groupBy("list", "slice")).applyInArrow(score, _HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_index")
    ranked = hits.drop("matched").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= _check_k(k))


def ann_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int | None = None, recall: float = 0.98,
    seed: int = 42,
) -> DataFrame:
    """Approximate: only rows in the lists that a query looks into are scored (see `ann_index`)."""
    return ann_search(ann_index(vectors, max(10, _check_k(k)), lists, recall, seed), queries, k)


def ann_recall(vectors: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, found, wanted, recall, scored_share): the approximate result beside the exact one,
    and the share of all rows that were scored for the query."""
    index = ann_index(vectors, max(10, k), **options)
    exact = cosine_topk(vectors, queries, k).select("query_id", "row_index")
    near = ann_search(index, queries, k).select("query_id", "row_index", F.lit(1).alias("hit"))
    asked = _unit_rows(queries, index.centres.shape[1], F.col("query_id").cast("bigint").alias("query_id"))
    met = _filed(asked, index.centres, index.probes).select("query_id", F.explode("lists").alias("list"))
    met = met.join(index.slices, "list").groupBy("query_id").agg(F.sum("n").alias("scored"))
    total = index.slices.agg(F.sum("n")).first()[0]
    counts = exact.join(near, ["query_id", "row_index"], "left").groupBy("query_id").agg(
        F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"))
    return counts.join(met, "query_id").select(
        "query_id", "found", "wanted", (F.col("found") / F.col("wanted")).alias("recall"),
        (F.col("scored") / total).alias("scored_share"))


# ── keywords ──────────────────────────────────────────────────────────────────


def keyword_match(text: Column, question: str) -> Column:
    """Whether a row's text holds any keyword of one question."""
    words = extract_keywords(F.lit(question))
    return F.arrays_overlap(word_tokens(text), words)


def keyword_match_counts(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, matches): rows holding any keyword, for many questions in one pass."""
    asked = queries.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.array_distinct(extract_keywords(F.col("question"))).alias("keywords"),
    )
    tokens = rows.select("row_index", word_tokens(F.col("text")).alias("tokens"))

    def work(q: _Queries, batches: Iterator[pa.RecordBatch]) -> pa.Table:
        total = np.zeros(len(q.ids), dtype="int64")
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP).column("tokens")
                total += q.matched(pa.concat_arrays([part])).sum(axis=0)
        return pa.table({"query_id": q.ids, "n": total})

    counts = _per_block(tokens, asked, work, "query_id bigint, n bigint")
    return counts.groupBy("query_id").agg(F.sum("n").alias("matches"))


def semantic_project(hits: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Search results with the listed columns of their rows."""
    wanted = list(dict.fromkeys(columns))
    return hits.join(rows.select("row_index", *wanted), "row_index")
