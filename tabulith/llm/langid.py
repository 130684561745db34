"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the character 1- to 4-grams of lower-cased runs of letters with a mark at both ends,
hashed into 2^15 buckets. A text's vector is the mean of its subwords' embeddings, over the whole
text; a linear softmax gives a probability per language. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, on at most `MAX_TRAIN` labelled rows (those with
the smallest hashes of their texts, copies once); every fifth of these only serves calibration: a temperature by
likelihood, and the confidence under which a text is rejected, which all but one in a thousand of
the rightly recognised rows exceed. For prediction, embedding and softmax are multiplied into one
table of logits by bucket, which gives the same values.

A NULL text, or one without any letter, is `und` with score 0 and is rejected. Rows with a NULL
label are not learned from. Without any labelled row every text is `und`. Repeated rows are
judged alike; an empty table gives no rows. Extra columns are not carried by `predict`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulith.llm.common import table

BUCKETS, DIM, SIZES, MAX_TRAIN = 1 << 15, 16, (1, 2, 3, 4), 3000
MARK = np.uint32(1)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a text, repeats included; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    isletter = letters()[codes]
    if not isletter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[MARK], np.where(isletter, codes, MARK), [MARK]]).astype(np.uint32)
    # One mark between words.
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != MARK) | (codes[:-1] != MARK)
    codes = codes[keep]
    mark = codes == MARK
    out = []
    h = np.zeros(len(codes), np.uint32)
    crossing = np.zeros(len(codes), bool)  # a mark inside, not at an end
    for n in range(1, max(SIZES) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        if n > 2:
            crossing = crossing[:m] | mark[n - 2: n - 2 + m]
        h = (h[:m] ^ codes[n - 1: n - 1 + m]) * np.uint32(0x01000193) + np.uint32(n)
        if n in SIZES:
            mixed = h[~(mark[:m] if n == 1 else crossing[:m])]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (buckets, languages), embedding times softmax
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, whether it is rejected."""
        at = subwords(text or "")
        if not len(at) or not self.languages:
            return "und", 0.0, True
        z = (self.logits[at].sum(0, dtype=np.float64) / len(at) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def labelled(docs: DataFrame, most: int = MAX_TRAIN) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of at most `most` different rows (text, lang), those with the
    smallest hashes: what passes through the driver is bounded by that times the number of
    buckets, packed, whatever the texts' lengths. Texts don't move but for the chosen ones."""
    rows = docs.select("text", "lang").where("text is not null and lang is not null").withColumn(
        "h", F.xxhash64("text"))
    hashes = rows.select("h", "lang").distinct().orderBy("h", "lang").limit(most)
    last = hashes.agg(F.max("h")).first()[0]
    if last is None:
        return []
    chosen = rows.where(F.col("h") <= last).dropDuplicates(["h", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, share = [], []
            for text in b.column("text").to_pylist():
                u, n = np.unique(subwords(text), return_counts=True)
                at.append(u.astype("<i4").tobytes())
                share.append((n / max(n.sum(), 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("lang"), pa.array(at, pa.binary()),
                 pa.array(share, pa.binary())], ["h", "lang", "at", "share"])

    got = chosen.select("h", "lang", "text").mapInArrow(
        count, "h long, lang string, at binary, share binary").collect()
    return [(r.lang, np.frombuffer(r["at"], "<i4"), np.frombuffer(r.share, "<f4"))
            for r in sorted(got, key=lambda r: (r.h, r.lang))[:most] if r["at"]]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], turns: int = 6, rate: float = 8.0) -> Model:
    """Stochastic gradient descent over the rows in a fixed shuffled order, then calibration."""
    languages = sorted({r[0] for r in rows})
    label = {x: i for i, x in enumerate(languages)}
    dealt = np.random.default_rng(5)
    embedding = dealt.normal(0, 0.1, (BUCKETS, DIM))
    softmax = np.zeros((DIM, len(languages)))
    bias = np.zeros(len(languages))
    held = rows[::5] if len(rows) >= 50 else []
    train = [r for i, r in enumerate(rows) if i % 5] if held else rows
    for turn in range(turns):
        step = rate * (1 - turn / turns)
        for i in dealt.permutation(len(train)):
            lang, at, share = train[i]
            v = share @ embedding[at]
            z = v @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[lang]] -= 1
            back = softmax @ p
            softmax -= step * 0.1 * np.outer(v, p)
            bias -= step * 0.01 * p
            embedding[at] -= step * np.outer(share, back)
    model = Model(languages, (embedding @ softmax).astype(np.float32), bias, 1.0, 0.0)
    if held:
        y = np.array([label.get(r[0], -1) for r in held])
        z = np.array([r[2] @ model.logits[r[1]] + bias for r in held])

        def log_p(t):
            s = z / t
            return s - s.max(1, keepdims=True) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True))

        known = np.flatnonzero(y >= 0)
        grid = np.geomspace(0.1, 10, 41)
        model.temperature = float(min(grid, key=lambda t: -log_p(t)[known, y[known]].mean()))
        p = np.exp(log_p(model.temperature))
        right = p.max(1)[p.argmax(1) == y]
        if len(right):
            model.threshold = float(min(0.5, np.quantile(right, 0.001)))
    return model


def train(docs: DataFrame, learn: Column, most: int = MAX_TRAIN) -> Model:
    """A model from the rows of `docs` (text, lang) where `learn` holds."""
    return fit(labelled(docs.where(learn), most))


def predict(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The columns `keys` with lang_pred, score and rejected. The model has a fixed size (one
    number per bucket and language) and is sent to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = "text" if "text" in keys else "__text"
    rows = docs.select(*keys, *([] if held in keys else [F.col("text").alias(held)]))
    schema = rows.select(*keys).schema.add("lang_pred", "string").add("score", "double").add(
        "rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column(held).to_pylist()]
            new = [pa.array([g[i] for g in got], t)
                   for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keys], *new], [*keys, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo `parts` (NULL: of the empty text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % parts


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, fold(3) != 1)
    marked = docs.withColumn("held_out", fold(3) == 1)
    return predict(marked, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
