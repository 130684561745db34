"""Filters on normalized text, column-name resolution and projection.

Every predicate follows SQL three-valued logic: NULL satisfies none of them but IS NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tabulith.functions import cells
from tabulith.operators import inference

# --- fixed values: spellings accepted for an operator ---
ALIASES = {
    "==": "=", "EQ": "=", "<>": "!=", "NE": "!=", "NEQ": "!=", "GT": ">", "GTE": ">=",
    "LT": "<", "LTE": "<=", "DOES NOT CONTAIN": "NOT CONTAINS", "ISNULL": "IS NULL",
    "NOT NULL": "IS NOT NULL",
}


# ── column names ──────────────────────────────────────────────────────────────


def original_names(df: DataFrame) -> dict[str, str]:
    """Original header of each column, as stored in the schema."""
    return {
        f.name: f.metadata.get("original_name", f.name)
        for f in df.schema.fields
        if f.name in set(cells.value_columns(df))
    }


def resolve_column(df: DataFrame, name: str) -> str:
    """The one column that fits best: by its name, else its name or then its header in any case."""
    wanted = str(name).strip()
    fits: dict[int, list[str]] = {}
    for column, header in original_names(df).items():
        same = [column == wanted, column.casefold() == wanted.casefold(),
                header.strip().casefold() == wanted.casefold()]
        if any(same):
            fits.setdefault(same.index(True), []).append(column)
    best = fits[min(fits)] if fits else []
    if len(best) != 1:
        raise ValueError(f"{name!r} fits {', '.join(best) or 'no column'}")
    return best[0]


def resolve_columns(requests: DataFrame, columns: DataFrame) -> DataFrame:
    """Bulk form: (dataset_id, requested) against (dataset_id, original_name, normalized_name).

    Adds `resolved` and `status` (exact, folded, header, ambiguous, unknown).
    """
    key = lambda c: F.lower(F.trim(c))
    ask = requests.select("*", F.trim("requested").alias("__raw"), key(F.col("requested")).alias("__key"))
    exact = columns.select("dataset_id", F.col("normalized_name").alias("__raw"),
                           F.lit(True).alias("__exact")).distinct()
    folded = columns.groupBy("dataset_id", key(F.col("normalized_name")).alias("__key")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("normalized_name").alias("__folded")
    )
    header = (
        columns.groupBy("dataset_id", key(F.col("original_name")).alias("__key"))
        .agg(F.min("normalized_name").alias("__header"), F.max("normalized_name").alias("__other"))
        .where(F.col("__header") == F.col("__other"))
        .drop("__other")
    )
    joined = (
        ask.join(exact, ["dataset_id", "__raw"], "left")
        .join(folded, ["dataset_id", "__key"], "left")
        .join(header, ["dataset_id", "__key"], "left")
    )
    status = (
        F.when(F.col("__exact"), "exact")
        .when(F.col("__n") == 1, "folded")
        .when(F.col("__n") > 1, "ambiguous")
        .when(F.col("__header").isNotNull(), "header")
        .otherwise("unknown")
    )
    resolved = (
        F.when(status == "exact", F.col("__raw"))
        .when(status == "folded", F.col("__folded"))
        .when(status == "header", F.col("__header"))
    )
    return joined.select(*requests.columns, resolved.alias("resolved"), status.alias("status"))


def column_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Kinds kept in the schema; only columns without one are inferred."""
    stored = {f.name: f.metadata.get("kind") for f in df.schema.fields}
    missing = [c for c in dict.fromkeys(columns) if not stored.get(c)]
    found = inference.verdicts(inference.infer_column_kinds(df, missing)) if missing else {}
    return {c: stored.get(c) or found[c] for c in columns}


# ── predicates ────────────────────────────────────────────────────────────────


def _number(value: str) -> Column:
    digits = re.sub(r"[^0-9.\-]", "", value)
    try:
        return F.lit(float(digits))
    except ValueError:
        raise ValueError(f"{value!r} is not a number") from None


# What a condition's value stands for: the arguments of its test. Dates are ISO text.


def _none(value: str | None, kind: str) -> list:
    return []


def _one(value: str, kind: str) -> list:
    return [value]


def _ordered(value: str, kind: str) -> list:
    return [value if kind == "date" else _number(value)]


def _bounds(value: str, kind: str) -> list:
    low, _, high = value.partition("," if "," in value else "AND")
    if not (low.strip() and high.strip()):
        raise ValueError("two bounds are needed, like '3,6' or '3 AND 6'")
    return [*_ordered(low.strip(), kind), *_ordered(high.strip(), kind)]


def _listed(value: str, kind: str) -> list:
    found = [v.strip() for v in value.split(",") if v.strip()]
    if not found:
        raise ValueError("an empty list of values")
    return [found]


# Tests of a cell: of its text, or of what is ordered by (a number unless the kind is date).


def _like(text: Column, pattern: str) -> Column:
    # A backslash only escapes wildcards and itself.
    return text.like(re.sub(r"\\(?![%_\\])", r"\\\\", pattern))


def _holds(text: Column, part: str) -> Column:
    return _like(F.lower(text), f"%{part.lower()}%")


class Test(NamedTuple):
    arguments: Callable[[str, str], list]
    holds: Callable[..., Column]
    orders: bool = False


TESTS = {
    "=": Test(_one, Column.__eq__),
    "!=": Test(_one, Column.__ne__),
    ">": Test(_ordered, Column.__gt__, orders=True),
    ">=": Test(_ordered, Column.__ge__, orders=True),
    "<": Test(_ordered, Column.__lt__, orders=True),
    "<=": Test(_ordered, Column.__le__, orders=True),
    "BETWEEN": Test(_bounds, Column.between, orders=True),
    "IN": Test(_listed, Column.isin),
    "LIKE": Test(_one, _like),
    "NOT LIKE": Test(_one, lambda text, pattern: ~_like(text, pattern)),
    "CONTAINS": Test(_one, _holds),
    "NOT CONTAINS": Test(_one, lambda text, part: ~_holds(text, part)),
    "IS NULL": Test(_none, Column.isNull),
    "IS NOT NULL": Test(_none, Column.isNotNull),
}


def find_test(operator: str) -> Test:
    """The test behind any spelling of an operator."""
    spelling = re.sub(r"[\s_]+", " ", operator).strip().upper()
    test = TESTS.get(ALIASES.get(spelling, spelling))
    if test is None:
        raise ValueError(f"{operator!r} is none of {', '.join(TESTS)}")
    return test


def predicate(
    df: DataFrame, column: str, test: Test, value: str | None = None, kind: str = "text"
) -> Column:
    """One condition on a column of cells. `kind` is that of the column, wanted where a test orders."""
    if value is None and test.arguments is not _none:
        raise ValueError(f"a value for {column} is missing")
    text = F.col(f"`{column}`.normalized")
    tested = cells.plain_number(df, column) if test.orders and kind != "date" else text
    return test.holds(tested, *test.arguments(value, kind))


def bool_chain(df: DataFrame, conditions: list[dict]) -> Column:
    """Conditions folded from the left, AND and OR alike: ((a OR b) AND c)."""
    items = [
        (resolve_column(df, c["column"]), find_test(c["operator"]), c.get("value"),
         str(c.get("logical_operator") or "AND").strip().upper())
        for c in conditions
    ]
    kinds = column_kinds(df, [c for c, test, _, _ in items if test.orders])
    terms = [(predicate(df, c, test, v, kinds.get(c, "text")), joiner) for c, test, v, joiner in items]
    return reduce(
        lambda left, term: left | term[0] if term[1] == "OR" else left & term[0],
        terms[1:],
        terms[0][0],
    )


def filter_rows(df: DataFrame, conditions: list[dict] | None) -> DataFrame:
    return df.where(bool_chain(df, conditions)) if conditions else df


def _single(operator: str):
    def op(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
        return filter_rows(df, [{"column": column, "operator": operator, "value": value}])

    return op


filter_eq, filter_ne = _single("="), _single("!=")
filter_gt, filter_ge, filter_lt, filter_le = (_single(o) for o in (">", ">=", "<", "<="))
filter_like, filter_not_like = _single("LIKE"), _single("NOT LIKE")
filter_contains, filter_not_contains = _single("CONTAINS"), _single("NOT CONTAINS")
filter_in, filter_between = _single("IN"), _single("BETWEEN")
filter_is_null, filter_is_not_null = _single("IS NULL"), _single("IS NOT NULL")


# ── search with signatures ────────────────────────────────────────────────────

#: Rows per block, and bits of a block's signature (what a Spark bitmap of one bucket holds).
BLOCK_ROWS, SIGNATURE_BITS = 8192, 32768
#: So many ranges of rows reach the scan as a condition; more are joined.
RANGES = 200


def _gram_bits(text: Column) -> Column:
    """The bits of a text's distinct runs of three characters."""
    last = F.length(text) - 2
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(3)))
    bits = F.transform(F.array_distinct(grams), lambda g: F.pmod(F.xxhash64(g), F.lit(SIGNATURE_BITS)))
    return F.when(last > 0, bits).otherwise(F.array().cast("array<bigint>"))


def signatures(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, first_row, last_row, bitmap): for each block of rows the runs of three characters in
    any of its cells, hashed to the bits of a bitmap of 4 KB. To be stored beside the cells."""
    texts = [_gram_bits(F.lower(F.col(f"`{c}`.{side}"))) for c in cells.value_columns(df)
             for side in ("original", "normalized")]
    bits = F.array_distinct(F.flatten(F.array(*[F.coalesce(t, F.array().cast("array<bigint>")) for t in texts])))
    block = F.floor(F.col("row_index") / block_rows)
    rows = df.select("row_index", block.alias("block"), F.explode_outer(bits).alias("bit"))
    return rows.groupBy("block").agg(
        F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"),
        F.bitmap_construct_agg("bit").alias("bitmap"))


def may_hold(signed: DataFrame, needle: str) -> DataFrame:
    """The signed blocks in which every run of three characters of the needle occurs."""
    bits = signed.sparkSession.range(1).select(_gram_bits(F.lower(F.lit(needle)))).first()[0]
    hit = F.lit(True)
    for b in bits:
        byte = F.conv(F.hex(F.substring("bitmap", b // 8 + 1, 1)), 16, 10).cast("int")
        hit &= F.floor(byte / (1 << b % 8)).cast("int") % 2 == 1
    return signed.where(hit)


def _rows_that_may_hold(df: DataFrame, signed: DataFrame, needle: str) -> DataFrame:
    found = may_hold(signed, needle).select("first_row", "last_row")
    few = sorted(tuple(r) for r in found.limit(RANGES + 1).collect())
    if len(few) > RANGES:
        inside = F.col("row_index").between(F.col("first_row"), F.col("last_row"))
        width = signed.agg(F.max(F.col("last_row") - F.col("first_row") + 1)).first()[0]
        # Blocks and rows meet by equal multiples of the widest block: an equi-join.
        near = found.select("*", F.explode(F.array_distinct(F.array(
            F.floor(F.col("first_row") / width), F.floor(F.col("last_row") / width)))).alias("__at"))
        near = near.withColumnRenamed("__at", "__near")
        return df.join(near, (F.floor(F.col("row_index") / width) == F.col("__near")) & inside, "left_semi")
    ranges: list[list[int]] = []
    for first, last in few:
        if ranges and ranges[-1][1] + 1 >= first:
            ranges[-1][1] = last
        else:
            ranges.append([first, last])
    # These reach the scan: row groups of other blocks are not read.
    return df.where(reduce(lambda a, b: a | b, [F.col("row_index").between(a, b) for a, b in ranges], F.lit(False)))


def search_any_cell(df: DataFrame, text: str, signed: DataFrame | None = None) -> DataFrame:
    """Rows where any original or normalized value contains the text, ignoring case.

    With the table's stored `signatures`, blocks of rows that cannot hold the text are left out
    before any text is read. Texts of less than three characters gain nothing by that.
    """
    needle = text.strip().lower()
    if not needle:
        return df
    if signed is not None and len(needle) >= 3:
        df = _rows_that_may_hold(df, signed, needle)
    hits = [
        F.coalesce(F.lower(F.col(f"`{c}`.{side}")).contains(needle), F.lit(False))
        for c in cells.value_columns(df)
        for side in ("original", "normalized")
    ]
    return df.where(reduce(lambda a, b: a | b, hits))


def project_columns(df: DataFrame, columns: list[str], side: str = "original") -> DataFrame:
    """Requested columns once each, in order, as original values."""
    names = list(dict.fromkeys(resolve_column(df, c) for c in columns))
    return df.select("row_index", *[F.col(f"`{c}`.{side}").alias(c) for c in names])
