"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTINGS = {
    # Naive timestamps are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Cell parsing yields long generated methods. HotSpot does not compile methods above 8000
    # bytes, so larger ones must be split, which Spark does when whole-stage code is given up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

BROADCAST_ROWS = 100_000


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def methods_split(spark: SparkSession) -> Iterator[None]:
    """Long generated methods are split as under `tune`, for what is run inside only."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, SETTINGS[key])
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    Only a session on one machine gets a folder of its own where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tabulith-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result that several later steps read, and read it back.

    Being a table in the shared folder it outlives executors, and it cuts the lineage.
    """
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after seeing that the side is small; else leave it to the planner.

    The check reads at most `rows` + 1 rows.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Give parse-heavy work at least one partition per core.

    A table read from many files already has them and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, whatever the case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def narrowed(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose `key`, a long, is among the longs of `keys` (its only column), and
    some others: few while the keys are few, and none is left out.

    The keys are entered into a bitmap of 2^25 bits in 1024 pieces, 8 MB at most whatever their
    number, which travels to every task. So a join that follows moves little of a large `df`.
    """
    here = free(df, "here")
    return _marked(df, key, keys, here, "inner").where(here).drop(here)


def marked(df: DataFrame, key: Column, keys: DataFrame, out: str) -> DataFrame:
    """All rows of `df` with `out`: true for the rows that `narrowed` would keep."""
    return _marked(df, key, keys, out, "left")


def _marked(df: DataFrame, key: Column, keys: DataFrame, out: str, how: str) -> DataFrame:
    bits = 1024 * 32768

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    at = place(F.col(keys.columns[0]))
    bitmap = keys.groupBy(F.floor(at / 32768).cast("int").alias("piece")).agg(
        F.bitmap_construct_agg((at % 32768)).alias("bitmap"))
    # As numbers of 16 bits: a bit is read from one without going through texts.
    words = F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.conv(
        F.hex(F.substring(F.col("bitmap"), 2 * i + 1, F.lit(2))), 16, 10).cast("int"))
    piece, bitmap_name, here = free(df, "piece"), free(df, "bitmap"), free(df, "place")
    bitmap = bitmap.select(F.col("piece").alias(piece), words.alias(bitmap_name))
    found = df.withColumn(here, place(key))
    found = found.join(F.broadcast(bitmap), F.floor(F.col(here) / 32768).cast("int") == F.col(piece), how)
    bit = F.pmod(F.col(here), F.lit(32768)).cast("int")
    word = F.get(F.col(bitmap_name), F.shiftright(bit, 4))
    # The first of two bytes stands before the second, the first of eight bits at their end.
    turned = F.element_at(F.array(*[F.lit(1 << (i + 8) % 16) for i in range(16)]),
                          bit.bitwiseAND(F.lit(15)) + 1)
    set_bit = word.bitwiseAND(turned) != 0
    return found.withColumn(out, F.coalesce(set_bit, F.lit(False))).drop(piece, bitmap_name, here)
