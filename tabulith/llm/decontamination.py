"""Benchmark decontamination by winnowing, in SQL functions only.

A text is hashed in runs of K = 5 words; of any 6 consecutive runs the smallest hash is kept. Six
runs span 10 words, so a shared span of 10 words or more, wherever it stands, has a kept hash in
common. Kept hashes of documents and items are joined; the documents that share any are read
again, their 10-word windows around common hashes are compared word by word with the items'
windows, and windows that occur are merged into spans of hit words. An item of 1 to 9 words is one
window; for each such length that an item has, runs of that length are joined in the same way.

NULL and empty texts have no words. A document is told apart by its id and a hash of its text, so
repeated ids and rows are judged each by its own text, and every row is returned. Items without
words have no window; items with equal ids count once. Empty tables are fine on either side.
Extra columns are not carried.

Shuffled are the kept hashes (about two for every seven words; Spark leaves that out where the
items' side is under its broadcast limit), then only what belongs to matching documents, which a
bitmap of their hashes picks out in the scan. A
document's hits are gathered per document, which its length bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulith.llm.common import free, lower_ascii, materialize, narrowed, table

WINDOW, K = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _starts(last: Column) -> Column:
    """0 to `last`, or nothing."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _runs(hashes: str, n: int) -> Column:
    """A hash of each run of n words, from the column of the words' hashes."""
    h = F.col(hashes)
    return F.transform(_starts(F.size(h) - n), lambda i: F.xxhash64(
        F.lit(n), *[F.get(h, i + j) for j in range(n)]))


def _hashed(df: DataFrame, short: list[int]) -> DataFrame:
    """To rows with `words`: `least`, for each window the hash that it keeps, and for each short
    length n the hashes of its runs, `run_<n>`."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("fives", _runs("hashes", K))
    fives, width = F.col("fives"), WINDOW - K + 1
    df = df.withColumn("least", F.transform(
        _starts(F.size(fives) - width), lambda i: F.array_min(F.slice(fives, i + 1, width))))
    for n in short:
        df = df.withColumn(f"run_{n}", _runs("hashes", n))
    return df.drop("hashes", "fives")


def windows(items: DataFrame) -> DataFrame:
    """item_id, window (its words), width, kept (the hash to join on) of items (item_id, text)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    n = F.size("words")
    long = _hashed(w.where(n >= WINDOW), [])
    least = F.col("least")
    long = long.select("item_id", F.explode(F.transform(
        _starts(F.size(least) - 1), lambda i: F.struct(
            F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("window"),
            F.lit(WINDOW).alias("width"), F.get(least, i).alias("kept")))).alias("w"))
    short = w.where((n > 0) & (n < WINDOW)).withColumn(
        "hashes", F.transform("words", lambda x: F.xxhash64(x)))
    kept = F.lit(None).cast("long")
    for i in range(1, WINDOW):
        kept = F.when(n == i, F.get(_runs("hashes", i), F.lit(0))).otherwise(kept)
    short = short.select("item_id", F.struct(
        F.array_join("words", " ").alias("window"), n.alias("width"), kept.alias("kept")).alias("w"))
    return long.union(short).select("item_id", "w.window", "w.width", "w.kept").distinct()


def find(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For documents (doc_id, text) and items (item_id, text):
    `rows` (doc_id, th, n_words, copies, kept), a row per different document;
    `hits` (doc_id, th, at, width, window), the windows that occur, `at` a place among the words;
    `owners` (window, item_id)."""
    # A row per item and word: stored, as it is read four times.
    owned = materialize(windows(items), "windows")
    short = sorted(r[0] for r in owned.where(F.col("width") < WINDOW)
                   .select("width").distinct().collect())  # at most nine numbers
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))

    hashed = _hashed(d.select("doc_id", "th", words(F.col("text")).alias("words")), short)
    kept = F.array_distinct(F.concat("least", *[F.array_distinct(f"run_{n}") for n in short]))
    # The row at pos 0 stands for the document itself.
    exploded = hashed.select("doc_id", "th", F.size("words").alias("n_words"), F.posexplode(
        F.concat(F.array("th"), kept)).alias("pos", "kept"))
    wanted = owned.select("kept", F.lit(True).alias("hit")).distinct()
    rows = materialize(
        exploded.join(wanted, "kept", "left").where("pos = 0 or hit")
        .groupBy("doc_id", "th").agg(
            F.max("n_words").alias("n_words"),
            F.count(F.when(F.col("pos") == 0, 1)).alias("copies"),
            F.collect_set(F.when(F.col("pos") > 0, F.col("kept"))).alias("kept")),
        "winnowed")

    some = materialize(rows.where(F.size("kept") > 0).select(
        F.col("doc_id").alias("d"), F.col("th").alias("x"), "kept"), "matching")
    # Of the texts, only those of matching documents and a few others move.
    again = narrowed(d, F.col("th"), some.select("x")).join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("x")))
    again = _hashed(again.select("doc_id", "th", "kept", words(F.col("text")).alias("words")), short)

    def at(hashes: str, width: int) -> Column:
        h = F.col(hashes)
        places = F.filter(_starts(F.size(h) - 1), lambda i: F.array_contains("kept", F.get(h, i)))
        return F.transform(places, lambda i: F.struct(
            i.alias("at"), F.lit(width).alias("width"),
            F.array_join(F.slice("words", i + 1, width), " ").alias("window")))

    seen = again.select("doc_id", "th", F.explode(F.concat(
        at("least", WINDOW), *[at(f"run_{n}", n) for n in short])).alias("s"))
    seen = seen.select("doc_id", "th", "s.at", "s.width", "s.window")
    # Windows of one word sequence may differ in width only by way of the sequence itself.
    hits = seen.join(owned.select("window").distinct(), "window", "left_semi")
    return rows, hits.distinct(), owned.select("window", "item_id").distinct()


def covered(places: Column) -> Column:
    """Number of words in the union of (at, width) intervals."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(places), start, lambda s, p: F.struct(
        (s["n"] + F.greatest(F.lit(0), p["at"] + p["width"] - F.greatest(s["end"], p["at"]))).alias("n"),
        F.greatest(s["end"], p["at"] + p["width"]).alias("end")), lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings): a row per document row."""
    rows, hits, owners = find(docs, items)
    hits = materialize(hits, "hits")
    spans = hits.groupBy("doc_id", "th").agg(
        covered(F.collect_set(F.struct("at", "width"))).alias("n_hit"),
        F.sort_array(F.collect_set("window")).alias("windows"))
    # Documents with the same windows have the same items: looked up once per set of windows.
    spans = spans.withColumn("set", F.sha2(F.to_json("windows"), 256))
    sets = spans.groupBy("set").agg(F.first("windows").alias("windows"))
    named = (
        sets.select("set", F.explode("windows").alias("window")).join(owners, "window")
        .groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    spans = spans.select(F.col("doc_id").alias("d"), F.col("th").alias("x"), "n_hit", "set").join(
        named, "set", "left")
    empty = F.array().cast("array<string>")
    return (
        rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("x")), "left")
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("items", empty).alias("items"),
                F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` (all columns) in which no window of an item occurs."""
    _, hits, _ = find(docs, items)
    d, x = free(docs, "d"), free(docs, "x")
    bad = hits.select(F.col("doc_id").alias(d), F.col("th").alias(x)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(d))
                     & (F.xxhash64(docs["text"]) == F.col(x)), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLES = {"op3_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS width,
         array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, width, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM d, (SELECT DISTINCT width FROM bw) WHERE len(w) >= width)),
hits AS (SELECT rid, i, width, item_id FROM dw JOIN bw USING (width, win)),
spans AS (SELECT rid, count(DISTINCT p) AS n_hit
          FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spans USING (rid) LEFT JOIN named USING (rid)
"""}
