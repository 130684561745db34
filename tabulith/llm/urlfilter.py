"""URL verdicts: listed rules, and for the rest a logistic regression on hashed n-grams.

Features are the character 3- to 5-grams of the host (with marks at its ends) and, in a space of
their own, of the path, hashed into 2^16 buckets and counted once each. The model is trained from
a small labelled table of urls: at most `MAX_TRAIN` rows, in numpy. In the query those are the
pages whose url a rule decides, the ones with the smallest hashes; with no such page, or one
verdict only, that verdict (or `allow`) is all the model says.

A NULL url or one without `://` has empty host and path and is judged by the model like any other.
Repeated rows are judged alike; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulith.llm.common import lower_ascii, table

#: (verdict, host, path) of the listed rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS, SIZES, MAX_TRAIN = 1 << 16, (3, 4, 5), 10_000


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """A struct (rule, verdict): the longest rule that fits, or NULL."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
                     ).otherwise(out)
    return out


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and path."""
    host, path = f"^{host}$".encode(), f"{path}$".encode()
    grams = {b"h" + host[i: i + n] for n in SIZES for i in range(len(host) - n + 1)}
    grams |= {b"p" + path[i: i + n] for n in SIZES for i in range(len(path) - n + 1)}
    return np.unique(np.fromiter((zlib.crc32(g) % BUCKETS for g in grams), np.int64, len(grams)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def blocked(self, host: str, path: str) -> float:
        """The probability of `block`."""
        at = features(host, path)
        z = self.bias + self.weights[at].sum() / np.sqrt(max(len(at), 1))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(labelled: DataFrame, rounds: int = 30, rate: float = 0.5, decay: float = 1e-4,
        most: int = MAX_TRAIN) -> Model:
    """A model from rows (host, path, verdict); more than `most` rows: those with the smallest
    hash of host and path. Stochastic gradient descent in a fixed order of rows."""
    rows = (labelled.select("host", "path", "verdict").distinct()
            .orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(most).collect())
    y = np.array([r.verdict == "block" for r in rows], float)
    model = Model(np.zeros(BUCKETS, np.float64), 0.0)
    if not len(y) or y.min() == y.max():
        model.bias = 10.0 if len(y) and y[0] else -10.0
        return model
    x = [features(r.host, r.path) for r in rows]
    dealt = np.random.default_rng(7)
    for turn in range(rounds):
        step = rate / (1 + turn / 5)
        for i in dealt.permutation(len(x)):
            scale = 1 / np.sqrt(max(len(x[i]), 1))
            z = model.bias + model.weights[x[i]].sum() * scale
            slope = y[i] - 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            model.weights[x[i]] += step * (slope * scale - decay * model.weights[x[i]])
            model.bias += step * slope * 0.1
    return model


def judge(urls: DataFrame, model: Model) -> DataFrame:
    """`urls` (page_id, host, path, rule, verdict) with the model's verdict where there is none.
    The model has a fixed size and travels with the tasks."""
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("host", "path", "verdict")]
            out = [v or ("block" if shared.value.blocked(h, p) >= 0.5 else "allow")
                   for h, p, v in zip(*cols)]
            yield b.set_column(4, "verdict", pa.array(out, pa.string()))

    return urls.mapInArrow(
        decide, "page_id long, host string, path string, rule string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    parts = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("r", rule_of(F.col("host"), F.col("path"))).select(
        "page_id", "host", "path", "r.rule", "r.verdict")
    return judge(ruled, fit(ruled.where("verdict is not null")))


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {}
