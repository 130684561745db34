"""CSV / TSV files: checks, header detection, reading, row numbering.

Files are read as lines, in splits, and lines put together to records: a line break inside quotes
does not end a record. Whether a line begins inside quotes depends on all lines before it, so each
split is worked through for both cases at once, and the outcomes of the splits of a file, a few
numbers each, are then combined in order. So a file with line breaks in quotes is read by as many
tasks as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabulith import fixed
from tabulith.functions import dates, numbers
from tabulith.operators.headers import dedupe_headers
from tabulith.session import materialize, small_side


def _file() -> Column:
    return F.col("_metadata.file_path")


def delimiter_of(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def _delimiter(file: Column) -> Column:
    return F.when(F.lower(file).endswith(".tsv"), "\t").otherwise(",")


def _text(spark: SparkSession, path: str | list[str], folders: bool = True) -> DataFrame:
    """The lines of all files under a path, blank ones too."""
    return spark.read.option("recursiveFileLookup", folders).text(path)


# ── checks over many files ────────────────────────────────────────────────────


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files, those of length zero too.

    Spark's scans leave out files of length zero, its listing does not. No content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = [(n,) for n in found.inputFiles()]
    listed = spark.createDataFrame(names, "listed string").select(_plain(F.col("listed")).alias("path"))
    sizes = found.select(_plain(F.col("path")).alias("path"), "length")
    return listed.distinct().join(sizes, "path", "left").select(
        "path", F.coalesce("length", F.lit(0)).alias("length"))


def _plain(path: Column) -> Column:
    """One spelling of a path: listings and metadata escape it and write its scheme differently."""
    bare = F.regexp_replace(path, "^file:/+", "file:/")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def check_files(spark: SparkSession, path: str, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """(path, length, reason); reason NULL for an acceptable file.

    The whole of every file is looked at, in splits: a character of several bytes never holds the
    byte of a line break, so a file is UTF-8 if each of its lines is. Files above the limit are
    left out before anything is read.
    """
    lines = _text(spark, path).where(F.col("_metadata.file_size") <= max_bytes)
    nul = F.col("value").contains("\0")
    seen = lines.select(_plain(_file()).alias("path"), nul.alias("nul"), F.is_valid_utf8("value").alias("valid"))
    seen = seen.groupBy("path").agg(F.bool_or("nul").alias("nul"), F.bool_and("valid").alias("valid"))
    reason = (
        F.when(F.col("length") > max_bytes, "too_large")
        .when(~F.lower("path").rlike(r"\.(csv|tsv)$"), "extension")
        .when(F.col("length") == 0, "empty")
        .when(F.col("nul"), "binary")
        .when(~F.col("valid"), "not_utf8")
    )
    return list_files(spark, path).join(seen, "path", "left").select("path", "length", reason.alias("reason"))


def looks_like_data(cell: Column) -> Column:
    """A number, a date or an amount rather than a label."""
    return F.coalesce(
        numbers.parse_number(cell).isNotNull() | dates.date_epoch(cell, "swap").isNotNull(),
        F.lit(False),
    )


def header_verdict(first: Column, second: Column) -> Column:
    """Whether the first of two records (arrays of text; second NULL if absent) is a header."""
    votes = lambda row: F.transform(row, looks_like_data)
    hits = lambda flags: F.size(F.filter(flags, lambda x: x))

    # Bound once by the lambdas below: flags of both records, padded to the same length.
    def decide(flags: Column) -> Column:
        a, b = flags["a"], flags["b"]
        width = F.greatest(F.size(a), F.size(b))
        label_then_data = F.exists(
            F.arrays_zip(a.alias("a"), b.alias("b")),
            lambda p: ~F.coalesce(p["a"], F.lit(False)) & F.coalesce(p["b"], F.lit(False)),
        )
        f1, f2 = hits(a) / width, hits(b) / width
        two = (
            F.when(label_then_data, True)
            .when((f1 == 0) & (f2 == 0), True)
            .when((f1 >= 0.4) & (f2 >= 0.4) & (F.abs(f1 - f2) <= 0.18), False)
            .otherwise(f2 - f1 >= 0.18)
        )
        return F.when(b.isNull(), hits(a) == 0).otherwise(two)

    flags = F.struct(votes(first).alias("a"), votes(second).alias("b"))
    return F.when(F.size(first) == 0, True).otherwise(F.transform(F.array(flags), decide)[0])


def split_record(record: Column, delimiter: Column) -> Column:
    """Fields of one delimited record, quotes removed; a blank line has none."""
    quoted = r'"[^"]*+(?:""[^"]*+)*+"?'
    csv = F.regexp_extract_all(record, F.lit(rf'(?:^|,)((?:{quoted})?[^,]*+)'), F.lit(1))
    tsv = F.regexp_extract_all(record, F.lit(rf'(?:^|\t)((?:{quoted})?[^\t]*+)'), F.lit(1))
    fields = F.when(delimiter == "\t", tsv).otherwise(csv)
    plain = F.transform(
        fields,
        lambda f: F.when(
            f.startswith('"'), F.replace(F.regexp_replace(f, r'(?s)^"(.*)"([^"]*)$', "$1$2"), F.lit('""'), F.lit('"'))
        ).otherwise(f),
    )
    return F.when(record == "", F.array().cast("array<string>")).otherwise(plain)


# ── records ───────────────────────────────────────────────────────────────────


def open_after(line: Column, delimiter: Column) -> Column:
    """Whether a quoted field is open after a line: (`out`, `inside`), for lines that begin
    outside or inside of one. A quote counts at the start of a field only, as in `5" pipe,3`."""
    def after(inside: Column, piece: Column) -> Column:
        quoted = inside | piece.startswith('"')
        rest = F.when(inside, piece).otherwise(F.substr(piece, F.lit(2)))
        # Doubled quotes stand for one; what is left of a run of odd length closes the field.
        return quoted & ~F.replace(rest, F.lit('""'), F.lit("")).contains('"')

    pieces = F.when(delimiter == "\t", F.split(line, "\t")).otherwise(F.split(line, ","))
    ends = lambda start: F.aggregate(pieces, F.lit(start), after)
    return F.when(
        line.contains('"'), F.struct(ends(False).alias("out"), ends(True).alias("inside"))
    ).otherwise(F.struct(F.lit(False).alias("out"), F.lit(True).alias("inside")))


_STATES = ("file string, block long, n long, value string, open0 boolean, open1 boolean, "
           "after0 boolean, after1 boolean, begun0 long, begun1 long")


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value, out, inside) in order to _STATES: what holds before and after
    each line, and how many records have begun, if the split begins outside (0) or inside (1) of
    a quoted field."""
    at, state, begun, done = None, [False, True], [0, 0], 0
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column(0).to_pylist(), b.column(1).to_pylist()
        cuts = [0, *(i for i in range(1, len(file)) if (file[i], block[i]) != (file[i - 1], block[i - 1])), len(file)]
        for a, z in zip(cuts, cuts[1:]):
            if (file[a], block[a]) != at:
                at, state, begun, done = (file[a], block[a]), [False, True], [0, 0], 0
            part = b.slice(a, z - a)
            out, inside = (part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4))
            # Since the last line after which the outcome is certain, lines either keep or turn it.
            place = np.arange(z - a)
            sure = np.maximum.accumulate(np.where(out == inside, place, -1))
            turns = np.cumsum(out & ~inside)
            turned = (turns - np.where(sure >= 0, turns[sure], 0)) % 2 == 1
            columns = [part.column(0), part.column(1), pa.array(done + place), part.column(2)]
            before, after, count = [], [], []
            for k in (0, 1):
                ends = np.where(sure >= 0, out[sure], state[k]) ^ turned
                starts = np.concatenate([[state[k]], ends[:-1]])
                records = begun[k] + np.cumsum(~starts)
                before.append(starts), after.append(ends), count.append(records)
                state[k], begun[k] = bool(ends[-1]), int(records[-1])
            done += z - a
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, [*before, *after, *count])],
                [c.split()[0] for c in _STATES.split(", ")])


def _follow(splits: pa.Table) -> pa.Table:
    """The splits of one file in order: whether each begins inside quotes, and after how many records."""
    rows = sorted(splits.to_pylist(), key=lambda r: r["block"])
    out, inside, records = [], False, 0
    for r in rows:
        out.append((r["file"], r["block"], inside, records))
        inside, records = (r["after1"], records + r["begun1"]) if inside else (r["after0"], records + r["begun0"])
    return pa.table({k: [o[i] for o in out] for i, k in enumerate(("file", "block", "inside", "before"))}
                    | {"total": [records] * len(out)},
                    schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()),
                                      ("before", pa.int64()), ("total", pa.int64())]))


def read_records(
    spark: SparkSession, path: str | list[str], delimiter: str | None = None, folders: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(file, record, value): the records of all files, numbered from 0 within their file, and
    (file, records), both stored. Blank lines are records without text; breaks inside quotes come
    back as line feeds.

    A file in which some line ends inside quotes takes the way described above; most have none,
    and there every line is a record, numbered by the counts of the splits.
    """
    raw = _text(spark, path, folders)
    separator = F.lit(delimiter) if delimiter else _delimiter(_file())
    ends = open_after(F.col("value"), separator)
    lines = raw.select(
        _file().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        ends["out"].alias("out"), ends["inside"].alias("inside"))
    if lines.where(F.col("out")).isEmpty():
        stored = materialize(
            lines.select("file", "block", F.monotonically_increasing_id().alias("id"), "value"), "raw-lines")
        splits = stored.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        within = Window.partitionBy("file").orderBy("block")
        splits = materialize(splits.withColumn("before", F.sum("n").over(within) - F.col("n")), "splits")
        totals = splits.groupBy("file").agg(F.sum("n").alias("records"))
        number = F.col("before") + F.col("id") - F.col("first")
        records = stored.join(small_side(splits), ["file", "block"]).select(
            "file", number.alias("record"), "value")
        return records, totals

    stored = materialize(lines.mapInArrow(_both_ways, _STATES), "raw-lines")
    last = [F.max_by(c, "n").alias(c) for c in ("after0", "after1", "begun0", "begun1")]
    splits = materialize(
        stored.groupBy("file", "block").agg(*last).groupBy("file").applyInArrow(
            _follow, "file string, block long, inside boolean, before long, total long"), "splits")
    totals = splits.groupBy("file").agg(F.max("total").alias("records"))

    def of_split(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    placed = stored.join(small_side(splits), ["file", "block"]).select(
        "file", "block", "n", "value", (F.col("before") + of_split("begun") - 1).alias("record"),
        (of_split("open") | of_split("after")).alias("part"))
    whole = placed.where(~F.col("part")).select("file", "record", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "n", "value")))
    # Only lines of records with breaks meet, record by record.
    joined = placed.where("part").groupBy("file", "record").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined), totals


def _heads(records: DataFrame, delimiter: str | None) -> DataFrame:
    """(file, first, second, has_header): the fields of each file's first two records, from the
    first with a verdict. A mark of the byte order is no part of them."""
    record = lambda i: F.max(F.when(F.col("record") == i, F.col("value")))
    two = records.where("record < 2").groupBy("file").agg(record(0).alias("first"), record(1).alias("second"))
    separator = F.lit(delimiter) if delimiter else _delimiter(F.col("file"))
    first = split_record(F.regexp_replace("first", "^﻿", ""), separator)
    fields = two.select("file", first.alias("first"), split_record(F.col("second"), separator).alias("second"))
    return fields.withColumn("has_header", header_verdict(F.col("first"), F.col("second")))


def infer_header(spark: SparkSession, path: str) -> DataFrame:
    """(path, has_header) of many files, one row each, from their first two records; NULL for a
    file without any."""
    records, _ = read_records(spark, path)
    # Some files are not UTF-8 at all, which is no error here.
    heads = _heads(records.withColumn("value", F.make_valid_utf8("value")), None)
    return list_files(spark, path).select("path").join(
        heads.select(_plain(F.col("file")).alias("path"), "has_header"), "path", "left")


# ── reading ───────────────────────────────────────────────────────────────────


def _layout(heads: DataFrame, path: str | list[str]) -> tuple[list[str], list[str]]:
    """(names, originals) of the columns. All files with a header must name the same columns."""
    spark = heads.sparkSession
    named = heads.where("has_header").groupBy("first").agg(F.min("file").alias("file"))
    # A row per different header line: two are enough to tell an error, unless they only look different.
    found = named.orderBy("file").collect()
    if not found:
        width = heads.orderBy("file").select(F.size("first")).first()
        if width is None:
            raise ValueError(f"no records in {path}")
        originals = [f"col_{i + 1}" for i in range(width[0])]
        return originals, originals
    asked = spark.createDataFrame(
        [(k, i, h or "") for k, r in enumerate(found) for i, h in enumerate(r["first"])],
        "file_id int, column_index int, header string")
    rows = dedupe_headers(asked).orderBy("file_id", "column_index").collect()
    names: dict[int, list[str]] = {k: [] for k in range(len(found))}
    for r in rows:
        names[r["file_id"]].append(r["normalized_name"])
    for k, r in enumerate(found):
        if names[k] != names[0]:
            raise ValueError(f"{r['file']} has columns {names[k]}, but {found[0]['file']} has {names[0]}")
    return names[0], [h or "" for h in found[0]["first"]]


def read_delimited(
    spark: SparkSession, path: str | list[str], has_header: bool | None = None, delimiter: str | None = None,
    folders: bool = True,
) -> DataFrame:
    """All-text table of the files under a path (or several): `row_index`, then columns named in snake case.

    Each file is judged by itself whether it begins with a header line, unless `has_header` says
    so for all; files without one give their fields in the order of the others' columns. Headers
    that name other columns are an error. Rows are numbered from 0 by path and place; a blank line
    is a row of NULLs. Short rows end in NULLs, long rows are cut. Empty files have no rows.
    """
    records, totals = read_records(spark, path, delimiter, folders)
    heads = _heads(records, delimiter)
    if has_header is not None:
        heads = heads.withColumn("has_header", F.lit(has_header))
    heads = materialize(heads.select("file", "first", "has_header"), "heads")
    names, originals = _layout(heads, path)

    # A row per file: as many as Spark's own listing holds.
    of_file = totals.join(heads.select("file", F.col("has_header").cast("int").alias("skip")), "file")
    kept = F.col("records") - F.col("skip")
    start = F.sum(kept).over(Window.orderBy("file")) - kept
    files = materialize(of_file.select("file", "skip", start.alias("start")), "files")
    rows = records.join(small_side(files), "file").where(F.col("record") >= F.col("skip"))
    text = F.when(F.col("record") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    if not names:
        return rows.select((F.col("start") + F.col("record") - F.col("skip")).alias("row_index"))

    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = lambda sep: F.from_csv("text", schema, {"sep": sep, "quote": '"', "escape": '"'})
    if delimiter:
        fields = parsed(delimiter)
    else:
        fields = F.when(_delimiter(F.col("file")) == "\t", parsed("\t")).otherwise(parsed(","))
    rows = rows.select(
        (F.col("start") + F.col("record") - F.col("skip")).alias("row_index"), "file",
        F.nullif(text, F.lit("")).alias("text"))
    return rows.select("row_index", fields.alias("fields")).select(
        "row_index",
        *[F.col(f"fields.c{i}").alias(n, metadata={"original_name": o}) for i, (n, o) in enumerate(zip(names, originals))])


def assign_row_index(df: DataFrame) -> DataFrame:
    """Dense 0-based `row_index` in file order for a DataFrame read straight from files; a table
    from `read_delimited` has it already.

    Rows are counted per file split; each split starts where the ones before it end, and a row
    adds its place within the split. Only the split counts meet in one place. The rows are stored
    once with their split: later scans may split the files otherwise, which must not renumber them.
    """
    if "row_index" in df.columns:
        return df
    located = materialize(df.select(
        "*",
        _file().alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    ), "raw-rows")
    splits = located.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    # One row per file first, then per block of a file: no window sees more than the splits.
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__file_rows"))
    file_starts = files.select(
        "__file",
        (F.sum("__file_rows").over(Window.orderBy("__file")) - F.col("__file_rows")).alias("__file_start"),
    )
    within = Window.partitionBy("__file").orderBy("__block")
    starts = (
        splits.withColumn("__before", F.sum("__n").over(within) - F.col("__n"))
        .join(file_starts, "__file")
        .select("__file", "__block", "__first",
                (F.col("__file_start") + F.col("__before")).alias("__start"))
    )
    # One row per split, counted once however often the numbered rows are read later.
    starts = materialize(starts, "splits")
    index = F.col("__start") + F.col("__id") - F.col("__first")
    return located.join(small_side(starts), ["__file", "__block"]).select(
        index.alias("row_index"), *[F.col(f"`{c}`") for c in df.columns]
    )
