"""Weighted rendezvous sharding of stable record keys, in SQL functions only.

Every (key, shard) pair has a score drawn from a digest of both and scaled by the shard's weight;
a record goes to the shard with the highest score. Whether shard s beats shard t for a key never
depends on the other shards, so a new shard takes records only into itself, and in proportion to
its weight. No state, no shuffle: a record's shard is an expression of its key.

NULL keys count as the key ''. Repeated rows have the same key and stay together; each gets a
slot of its own. Empty tables give empty results. Extra columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulith.llm.common import numbered, table

SHARDS = 24


def score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), with u in (0, 1) from 52 bits of an MD5 of key and shard."""
    digest = F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((bits + 0.5) / F.lit(float(2**52)))


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key (a string column); ties go to the higher shard number."""
    scored = [F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard"))
              for s, w in sorted(weights.items())]
    return (scored[0] if len(scored) == 1 else F.array_max(F.array(*scored)))["shard"]


def assign(df: DataFrame, key: Column, weights: Mapping[int, float],
           new: Mapping[int, float] | None = None) -> DataFrame:
    """Add `shard`, and `grown_shard` for the shards of `weights` and `new` together."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    scored = {s: F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard"))
              for s, w in sorted((dict(weights) | dict(new or {})).items())}
    best = F.array_max(F.array(*[scored[s] for s in sorted(weights)]))
    out = df.withColumn("__best", best)
    grown = F.array_max(F.array("__best", *[scored[s] for s in sorted(new or {})]))
    return (
        out.withColumn("grown_shard", grown["shard"])
        .withColumn("shard", F.col("__best.shard")).drop("__best")
    )


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of equal weight, by doc_id, with the shard each would have
    if shard 24 were added, and a slot in the shard without gaps (by digest prefix, then id)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign(docs, F.col("doc_id"), {s: 1.0 for s in range(SHARDS)}, {SHARDS: 1.0})
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    piece = F.substring(F.md5(key.cast("binary")), 1, 3)  # 4096 pieces of each shard
    return numbered(
        placed, ["shard"], piece, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot",
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
             "grown_shard")


QUERIES = {"op1_rendezvous_sharding": op1_rendezvous_sharding}

ORACLES = {"op1_rendezvous_sharding": f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, range(8)),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS text
         FROM documents),
ids AS (SELECT DISTINCT k FROM docs),
scored AS (
  SELECT k, s, -1.0 / ln((CAST(CAST('0x' || substr(md5(k || '#' || s), 1, 13) AS BIGINT)
                          AS DOUBLE) + 0.5) / 4503599627370496.0) AS score
  FROM ids, range({SHARDS} + 1) AS r(s)),
placed AS (
  SELECT k, arg_max(s, (score, s)) FILTER (s < {SHARDS}) AS shard,
         arg_max(s, (score, s)) AS grown_shard FROM scored GROUP BY k),
sized AS (
  SELECT doc_id, k, strlen(text) + 8 AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'),
                                            lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM docs, crc)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32,
       'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard
         ORDER BY substr(md5(k), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM sized JOIN placed USING (k)
"""}
