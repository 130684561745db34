"""Names that must be unique within a scope: column headers, tables, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulith import fixed
from tabulith.functions.text import normalize_header, sanitize_name
from tabulith.session import small_side

# Rows of one key numbered by one task; keys larger than this are numbered in pieces.
PIECE = 1_000_000


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "__k") -> DataFrame:
    """1, 2, 3, … within each key by a unique integer column.

    A key may hold a large share of the rows, so numbering runs per piece of the order column;
    the counts of the pieces before give each piece its start.
    """
    pieced = df.withColumn("__piece", F.floor(F.col(order) / PIECE))
    before = Window.partitionBy(*keys).orderBy("__piece")
    starts = (
        pieced.groupBy(*keys, "__piece")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.sum("__n").over(before) - F.col("__n"))
        .where(F.col("__start") > 0)
        .drop("__n")
    )
    within = Window.partitionBy(*keys, "__piece").orderBy(order)
    left = pieced.withColumn(name, F.row_number().over(within)).alias("l")
    right = small_side(starts).alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__piece"]]
    start = F.coalesce(F.col("r.__start"), F.lit(0))
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{name}") + start).alias(name)
    )


def _unique_names(df: DataFrame, scope: list[str], base: str, spell, key) -> DataFrame:
    """`__k`-th use of a base name spelled with the `__k`-th suffix that is still free.

    A suffix is taken only when another base name spells it itself (`a_2` beside two `a`): the
    last number of a suffixed name tells its base apart from any other. Such names are found by
    an equi-join of the base names with the (stem, number) read from them.
    """
    pattern = r"^(.*)_([1-9][0-9]{0,8})$"
    text = key(F.col(base))
    taken = (
        df.select(*scope, text.alias("__t"))
        .distinct()
        .select(
            *scope,
            F.regexp_extract("__t", pattern, 1).alias("__stem"),
            F.regexp_extract("__t", pattern, 2).try_cast("int").alias("__number"),
        )
        .where(F.col("__number") >= 2)
        .groupBy(*scope, "__stem")
        .agg(F.array_sort(F.collect_set("__number")).alias("__taken"))
    )
    left, right = df.withColumn("__stem", text).alias("l"), taken.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*scope, "__stem"]]
    none_taken = F.array().cast("array<int>")
    suffix = F.aggregate(
        F.coalesce(F.col("r.__taken"), none_taken),
        F.col("l.__k").cast("int"),
        lambda n, t: F.when(t <= n, n + 1).otherwise(n),
    )
    name = F.when(F.col("l.__k") == 1, F.col(f"l.{base}")).otherwise(
        spell(F.col(f"l.{base}"), suffix.cast("string"))
    )
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in df.columns], name.alias("__name")
    )


def _append(base: Column, number: Column) -> Column:
    return F.concat(base, F.lit("_"), number)


def dedupe_headers(df: DataFrame, file: str = "file_id", unicode_form: bool = True) -> DataFrame:
    """(file, column_index, header) to a unique `normalized_name` per column of a file."""
    base = F.nullif(normalize_header(F.col("header"), unicode_form), F.lit(""))
    blank = F.concat(F.lit("col_"), (F.col("column_index") + 1).cast("string"))
    named = df.select(file, "column_index", F.coalesce(base, blank).alias("__base"))
    counted = numbered(named, [file, "__base"], "column_index")
    out = _unique_names(counted, [file], "__base", _append, key=lambda c: c)
    return out.select(file, "column_index", F.col("__name").alias("normalized_name"))


def claim_unique_names(df: DataFrame, scope: str, id_: str, name: str) -> DataFrame:
    """Table names made unique per scope, case ignored, in id order."""
    cleaned = F.coalesce(F.nullif(sanitize_name(F.col(name)), F.lit("")), F.lit("table"))
    named = df.select(id_, scope, cleaned.alias("__base"), F.lower(cleaned).alias("__folded"))
    counted = numbered(named, [scope, "__folded"], id_)
    out = _unique_names(counted, [scope], "__base", _append, key=F.lower)
    return out.select(id_, scope, F.col("__name").alias("unique_name"))


def claim_folder_names(df: DataFrame, scope: str, id_: str, name: str) -> DataFrame:
    """Folder names likewise; the base is cut so that the suffix fits the allowed length.

    Names that differ only where a suffix might cut them are numbered together, by the part that
    no suffix reaches: with one number, they would be the same after the cut. Numbers that some
    name already ends with are passed over.
    """
    length = fixed.FOLDER_NAME_LENGTH
    reach = length - 11  # a suffix has ten digits at most
    cleaned = F.substring(F.trim(F.col(name)), 1, length)
    stem = lambda text: F.lower(F.left(text, F.lit(reach)))
    named = df.select(id_, scope, cleaned.alias("__base"), F.lower(cleaned).alias("__folded"),
                      stem(cleaned).alias("__stem"))
    counted = numbered(named, [scope, "__folded"], id_, "__use")
    again = numbered(counted.where("__use > 1"), [scope, "__stem"], id_)
    pattern = r"^(.*)_([1-9][0-9]{0,8})$"
    taken = (
        named.select(scope, "__folded").distinct().select(
            scope, F.regexp_extract("__folded", pattern, 1).alias("__of"),
            F.regexp_extract("__folded", pattern, 2).try_cast("int").alias("__number"))
        .where("__number >= 2").select(F.col(scope).alias("__scope"), stem(F.col("__of")).alias("__of"), "__number")
        .groupBy("__scope", "__of").agg(F.array_sort(F.collect_set("__number")).alias("__taken"))
    )
    number = F.aggregate(
        F.coalesce("__taken", F.array().cast("array<int>")), (F.col("__k") + 1).cast("int"),
        lambda n, t: F.when(t <= n, n + 1).otherwise(n)).cast("string")
    spelled = F.concat(F.left("__base", F.lit(length) - F.length(number) - 1), F.lit("_"), number)
    same = F.col(scope).eqNullSafe(F.col("__scope")) & (F.col("__stem") == F.col("__of"))
    return counted.where("__use = 1").select(id_, scope, F.col("__base").alias("unique_name")).unionByName(
        again.join(taken, same, "left").select(id_, scope, spelled.alias("unique_name")))
