"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the smallest (by hash) of its inner s-mers is its
first or its last. Whether a k-mer is chosen depends on its own characters only, so a passage
yields the same anchors in every document, wherever it stands; at least one of any k - s + 1
consecutive k-mers is chosen. `anchors` gives their positions and hashes for matching by place.

A fingerprint is the sorted list of the 128 smallest distinct anchor hashes of the whole text, as
hexadecimal digits: of a text with fewer anchors, all of them. Likeness is the share of common
hashes among the smallest of the union, an unbiased estimate of the Jaccard similarity of the
anchor sets (exact for short texts).

A text shorter than k characters is one anchor. NULL and empty texts have the fingerprint '';
two of them have likeness 1, one of them and another text 0. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulith.llm.common import table

K, S, KEPT = 24, 10, 128
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of n codes, put together from runs of powers of two."""
    out, done, power, size, part = None, 0, BASE, 1, codes
    while True:  # part: runs of `size`; out: runs of `done`
        if n & size:
            if out is None:
                out = part
            else:
                m = len(codes) - done - size + 1
                out = out[:m] * power + part[done: done + m]
            done += size
        if done == n:
            return out
        part = part[:-size] * power + part[size:]
        power, size = power * power, size * 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size:])


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in characters) and 64-bit hashes of the closed syncmers of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        if len(codes) < k:
            n = len(codes)
            return np.zeros(min(n, 1), np.int64), _mix(_grams(codes + np.uint64(1), n)) if n else codes
        inner = _mix(_grams(codes + np.uint64(1), s))
        w = k - s + 1
        least = _sliding_min(inner, w)
        first, last = inner[: len(least)], inner[w - 1:]
        at = np.flatnonzero((first == least) | (last == least))
        return at, _mix(_grams(codes + np.uint64(1), k)[at] ^ BASE)


def fingerprint(text: str, kept: int = KEPT) -> np.ndarray:
    """The smallest distinct 32-bit anchor hashes, ascending."""
    hashes = (anchors(text)[1] >> np.uint64(32)).astype(np.uint32)
    return np.unique(hashes)[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:kept]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= union[-1])) / len(union)


def as_text(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the other."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come piece by piece, in order, each piece closed by its guest."""
    held = None  # the row before, whose successor is due: piece, doc_id, text, fingerprint
    for b in batches:
        out = []
        cols = [b.column(c).to_pylist() for c in ("piece", "doc_id", "text", "guest")]
        for piece, doc, text, guest in zip(*cols):
            text = text or ""
            fp = held[3] if held and held[2] == text else fingerprint(text)
            if held and held[0] == piece:
                other = edited(held[2], text)
                changed = held[3] if other == held[2] else fingerprint(other)
                out.append((held[1], len(held[2]),
                            hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
                            as_text(held[3]), as_text(changed),
                            likeness(held[3], changed), likeness(held[3], fp)))
            held = None if guest else (piece, doc, text, fp)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)


def with_successors(docs: DataFrame, chars: int = 1 << 24, most: int = 10_000) -> DataFrame:
    """Fingerprints of every document and of its text edited with its successor in descending
    doc_id (the first follows the last; NULL ids come last, ties by a hash of the text, then the
    text).

    Texts are dealt by ranges of doc_id, so a document and its successor meet in one sorted
    stream; the first row of each range also visits the range before as a guest. Range bounds
    come from quantiles: about one per `chars` characters, at most `most`, which bounds the
    tables that pass through the driver (a wider range is only a longer stream).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(min(most, max(spark.sparkContext.defaultParallelism, size // chars)))
    bounds = rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    splits = [float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    rows = rows.withColumns({"as_double": F.col("doc_id").cast("double"), "h": F.xxhash64("text")})
    rows = (
        Bucketizer(splits=splits, inputCol="as_double", outputCol="piece", handleInvalid="keep")
        .transform(rows)
        .withColumn("piece", F.when(F.col("doc_id").isNull(), -1).otherwise(-F.col("piece")))
        .withColumn("piece", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("piece")).cast("int"))
        .drop("as_double")
    )
    # One row per range: at most `most` + 1 of them, so they may pass through the driver.
    first = rows.groupBy("piece").agg(F.max(F.struct("doc_id", "h")).alias("f")).select(
        "piece", "f.doc_id", "f.h").orderBy("piece").collect()
    visits = [(r.piece, r.doc_id, r.h, first[i - 1].piece) for i, r in enumerate(first)]
    guests = spark.createDataFrame(visits, "piece int, doc_id long, h long, visits int")
    g = F.broadcast(guests.select(F.col("piece").alias("p"), F.col("doc_id").alias("d"),
                                  F.col("h").alias("x"), "visits"))
    own = F.struct(F.col("piece"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("visits").alias("piece"), F.lit(True).alias("guest"))
    met = (
        rows.join(g, (F.col("piece") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d"))
                  & (F.col("h") == F.col("x")), "left")
        .select("doc_id", "text", "h",
                F.explode(F.when(F.col("visits").isNull(), F.array(own))
                          .otherwise(F.array(own, visit))).alias("at"))
        .select("doc_id", "text", "h", "at.piece", "at.guest")
    )
    order = ["piece", "guest", F.desc_nulls_last("doc_id"), F.desc("h"), F.desc_nulls_last("text")]
    return (
        met.repartitionByRange(max(n, 1), "piece").sortWithinPartitions(*order)
        .select("piece", "doc_id", "text", "guest").mapInArrow(_compare, SCHEMA)
    )


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return with_successors(table(spark, sf_dir, "documents"))


QUERIES = {"op2_syncmer_fingerprints": op2_syncmer_fingerprints}
ORACLES: dict[str, str] = {}
