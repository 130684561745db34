"""What several operators of this package need."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabulith.session import free, marked, materialize, narrowed

__all__ = ["connected", "free", "lower_ascii", "marked", "materialize", "narrowed", "numbered", "table", "word_pieces"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII white space, of about `size` bytes of the text at a time."""
    start = 0
    while start < len(raw):
        cut = SPACE.search(raw, start + size)
        end = cut.start() if cut else len(raw)
        yield raw[start:end].split()
        start = end


def numbered(df: DataFrame, by: list[str], piece: Column, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, whatever the size of a group.

    A group is dealt into pieces; rows are numbered inside a piece, and a table with a row per
    (group, piece) gives each piece its first number. No task holds a whole group. `df` is read
    twice, so it should be cheap or stored.
    """
    df = df.withColumn("__piece", piece)
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        df.groupBy(*by, "__piece").agg(F.count("*").alias("__n"))
        .withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*by, "__piece").orderBy(*order)
    return (
        df.withColumn("__at", F.row_number().over(inside) - 1)
        .join(firsts, [*by, "__piece"])
        .withColumn(out, (F.col("__first") + F.col("__at")).cast("long"))
        .drop("__piece", "__at", "__first")
    )


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the smallest node
    that can be reached.

    Large-star and small-star rounds in turn: every node hands its larger (then smaller)
    neighbours to its smallest one, until nothing changes, which takes a logarithmic number of
    rounds in practice. Each round is one min over a join and is stored in the shared folder. Both
    columns must be of one orderable type; self-links are harmless.
    """
    spark = edges.sparkSession
    links = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(), label,
    )
    state = None
    while True:
        # Large star: each neighbour above a node goes to the node's smallest neighbour.
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        links = materialize(small, label)
        now = tuple(
            links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        if now == state:
            break
        state = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
