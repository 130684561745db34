"""Column functions on dates.

A parsed date is STRUCT<iso_date STRING, epoch_seconds BIGINT>. Each layout is rewritten to
`y-m-d` by one regular expression and checked by a failure-tolerant cast.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabulith.functions.text import starts_with_digit, strip

_SEP = r"[/.-]"
_CLOCK = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?"
ISO_LAYOUT = rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}}){_CLOCK}$"
PAIR_LAYOUT = rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{2,4}}){_CLOCK}$"

# What all layouts and timestamps start with, in few steps.
_DATE_START = r"^\d{1,4}(?:[/.-]|W|\d{4})"

# The suffix appended before matching supplies the century: years below 100 mean 20xx,
# three-digit years stay as written.
_CENTURIES = "|200"
_YEAR = (
    rf"(?:0{{0,2}}(\d{{2}}){_CLOCK}\|(20)0|(\d{{3}}){_CLOCK}\|20(0)|(\d{{4}}){_CLOCK}\|200)$"
)

# Timestamp-like texts start with a basic, extended or week date.
_STAMP_START = r"^\d{4}(?:-\d{2}-\d{2}|\d{4}|-?W\d{2}(?:-?[1-7])?)(?:\D|$)"
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?"
_ZONES = "[XXX][XX][X]"
_EXTENDED = f"yyyy-MM-dd['T'HH[:mm[:ss]]{_ZONES}]"
_BASIC_CLOCK = f"yyyy-MM-dd['T'HH[mm[ss]]{_ZONES}]"


def _as_date(text: Column) -> Column:
    """Calendar date of `y-m-d`; the era starts with year 1."""
    return F.regexp_replace(text, "^0+-", "x").try_cast("date")


def _pair_date(text: Column, order: str | None) -> Column:
    """`a/b/year`. `order`: dmy, mdy, swap (day first unless b > 12), None (day first)."""

    def rewrite(source: Column, first: str, second: str, parts: str) -> Column:
        layout = rf"^({first}){_SEP}({second}){_SEP}{_YEAR}"
        return F.regexp_replace(source, layout, "$4$6$3$5$7" + parts)

    source, part = F.concat(text, F.lit(_CENTURIES)), r"\d{1,2}"
    if order == "swap":
        source = rewrite(source, r"0?\d|1[0-2]", r"1[3-9]|[2-9]\d", "-$1-$2")
    return _as_date(rewrite(source, part, part, "-$1-$2" if order == "mdy" else "-$2-$1"))


def _week_day(text: Column) -> Column:
    week = F.regexp_extract(text, _WEEK, 2).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, _WEEK, 3).try_cast("int"), F.lit(1))
    january = F.regexp_replace(F.substring(text, 1, 4), "$", "-01-04").try_cast("date")
    december = F.regexp_replace(F.substring(text, 1, 4), "$", "-12-28").try_cast("date")
    return F.when(
        week.between(1, F.weekofyear(december)),
        F.date_add(F.trunc(january, "week"), (week - 1) * 7 + day - 1),
    )


def _stamp_text(text: Column) -> Column:
    """A basic, extended or week date, with its optional clock, as `y-m-d[Tclock]`."""
    day = F.when(
        text.rlike(_WEEK),
        F.concat(_week_day(text).cast("string"), F.regexp_replace(text, _WEEK, "")),
    ).otherwise(F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3"))
    return F.regexp_replace(day, r"^(.{10})\D(.*?)(?:[.,]\d+)?([Z+-].*)?$", "$1T$2$3")


def _stamp(text: Column) -> Column:
    extended = text.contains(":") & ~text.rlike(r"T\d{4}")
    layout = F.when(extended, F.lit(_EXTENDED)).otherwise(F.lit(_BASIC_CLOCK))
    return F.unix_seconds(F.try_to_timestamp(text, layout))


def date_epoch(col: Column, order: str | None, stripped: bool = False) -> Column:
    """Seconds since 1970 of a date text, NULL when it is none."""
    text = col if stripped else strip(col)
    seconds = lambda date: F.unix_date(date).cast("bigint") * 86400
    iso = _as_date(F.regexp_replace(text, ISO_LAYOUT, "$1-$2-$3"))
    # The rare layouts sit in a lambda: that keeps their long code out of the generated method,
    # which would otherwise grow past what the JVM compiles.
    stamp = F.transform(F.transform(F.array(text), _stamp_text), _stamp)[0]
    return F.when(
        starts_with_digit(text) & text.rlike(_DATE_START),
        F.when(text.rlike(ISO_LAYOUT), seconds(iso))
        .when(text.rlike(PAIR_LAYOUT), seconds(_pair_date(text, order)))
        .when(text.rlike(_STAMP_START), stamp),
    )


def epoch_to_iso(epoch: Column) -> Column:
    return F.date_from_unix_date(F.floor(epoch / 86400).cast("int")).cast("string")


def _record(epoch: Column) -> Column:
    return F.when(
        epoch.isNotNull(),
        F.struct(epoch_to_iso(epoch).alias("iso_date"), epoch.alias("epoch_seconds")),
    )


def parse_date(col: Column) -> Column:
    """Day first, unless only month first can be valid."""
    return _record(date_epoch(col, "swap"))


def parse_date_with_format(col: Column, hint: str | None = None) -> Column:
    """`hint` dmy or mdy; without one, day first and never swapped."""
    return _record(date_epoch(col, hint))


def is_iso_text(col: Column) -> Column:
    return strip(col).rlike(r"^\d{4}-\d{2}-\d{2}$")


_ABOVE_12 = r"(?:1[3-9]|[2-9]\d)"
_ANY_LAYOUT = (
    rf"^(?:\d{{4}}{_SEP}\d{{1,2}}{_SEP}\d{{1,2}}|\d{{1,2}}{_SEP}\d{{1,2}}{_SEP}\d{{2,4}}){_CLOCK}$"
)
_FIRST_ABOVE = rf"^{_ABOVE_12}{_SEP}\d{{1,2}}{_SEP}\d{{2,4}}{_CLOCK}$"
_SECOND_ABOVE = rf"^\d{{1,2}}{_SEP}{_ABOVE_12}{_SEP}\d{{2,4}}{_CLOCK}$"


def is_date_layout(col: Column, stripped: bool = False) -> Column:
    return (col if stripped else strip(col)).rlike(_ANY_LAYOUT)


def first_above_12(col: Column, stripped: bool = False) -> Column:
    """An `a/b/year` text whose a can only be a day."""
    return (col if stripped else strip(col)).rlike(_FIRST_ABOVE)


def second_above_12(col: Column, stripped: bool = False) -> Column:
    return (col if stripped else strip(col)).rlike(_SECOND_ABOVE)


def date_part_bucket(col: Column, part: str) -> Column:
    """ISO text to YYYY-MM, YYYY-Qn or YYYY."""
    if part == "month":
        return F.substring(col, 1, 7)
    if part == "year":
        return F.substring(col, 1, 4)
    if part == "quarter":
        date = col.try_cast("date")
        return F.concat(F.date_format(date, "yyyy"), F.lit("-Q"), F.quarter(date).cast("string"))
    raise ValueError(f"unknown date part: {part}")


def sort_date(col: Column) -> Column:
    """Epoch used by interactive sorting: the layouts above, or a written-out month."""
    text = strip(col)
    plain = F.when(is_date_layout(text), date_epoch(text, "swap", stripped=True))
    written = F.when(
        text.rlike(r"(?i)^[a-z]{3,9}\.? \d{1,2},? \d{4}$|^\d{1,2} [a-z]{3,9} \d{4}$"),
        F.coalesce(*[
            F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, "[.,]", ""), F.lit(p)))
            for p in ("MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy")
        ]),
    )
    return F.coalesce(plain, written)
