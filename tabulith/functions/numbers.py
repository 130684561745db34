"""Column functions on numbers, money and measurements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabulith import fixed
from tabulith.functions.text import starts_with_digit, strip

_NUMBER = r"^[-+]?[0-9]*\.?[0-9]+$"
_STRICT = r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
_SCALES = {"k": 1_000.0, "m": 1_000_000.0, "b": 1_000_000_000.0}
_SKIPPED = r"[$€£¥₹,\s]*"


def _literal_map(values: dict) -> Column:
    """Map literal, written as SQL text: one call instead of one per entry."""
    text = lambda x: f"{x!r}D" if isinstance(x, float) else f"'{x}'"
    return F.expr("map(" + ", ".join(text(x) for pair in values.items() for x in pair) + ")")


def _plain_digits(col: Column) -> Column:
    """The number left after deleting every character that is not part of one."""
    digits = F.regexp_replace(col, r"[^0-9.+-]+", "")
    # NULL, not "", for no number: a failing cast is slow.
    return F.nullif(F.regexp_extract(digits, _NUMBER, 0), F.lit("")).try_cast("double")


#: One expression for "a number is left": no sign but in front, at most one point, digits at the end.
_HAS_NUMBER = r"^[^0-9.+-]*+[-+]?+(?:[^.+-]*+\.)?+[^0-9.+-]*+[0-9][^.+-]*+$"


def has_number(col: Column) -> Column:
    """Whether `parse_number` reads a number, without working it out. Whitespace, suffix and
    parentheses have no say in that."""
    return col.rlike(_HAS_NUMBER)


def _whole(pattern: str) -> str:
    """A pattern up to the very end: `$` also holds before a last line break."""
    return pattern[:-1] + r"\z"


def parse_number(col: Column, stripped: bool = False) -> Column:
    """Loose number: symbols and stray characters ignored, k/m/b suffix, (x) negative.

    The null spellings hold no digit, so they come out NULL without a test of their own. A text
    that is a number as it stands is cast; of the others those are worked out that hold one.
    """
    if not stripped:
        return _loose_number(strip(col))
    return F.when(col.rlike(_whole(_NUMBER)), col.try_cast("double")).when(has_number(col), _loose_number(col))


def _loose_number(text: Column) -> Column:
    opened = text.startswith("(")  # tells cheaply that there are no parentheses
    inner = F.when(opened, F.regexp_replace(text, r"(?s)^\((.*)\)$", "$1")).otherwise(text)
    scale_letter = F.lower(F.regexp_extract(inner, rf"(?U)([kmbKMB]){_SKIPPED}$", 1))
    scale = F.coalesce(F.try_element_at(_literal_map(_SCALES), scale_letter), F.lit(1.0))
    sign = F.when(opened & text.rlike(r"(?s)^\(.*\)$"), -1.0).otherwise(1.0)
    return _plain_digits(text) * scale * sign


def sql_number(col: Column) -> Column:
    """The stricter rule of filters and aggregates: no suffixes, no signs but minus."""
    return F.when(col.rlike(_whole(_STRICT)), col.try_cast("double")).when(col.rlike("[0-9]"), _strict_digits(col))


def _strict_digits(col: Column) -> Column:
    digits = F.regexp_replace(col, r"[^0-9.\-]+", "")
    # As above: what is no number is not cast.
    return F.nullif(F.regexp_extract(digits, _STRICT, 0), F.lit("")).try_cast("double")


def sort_number(col: Column) -> Column:
    """The rule interactive sorting uses: (x) negative, no suffixes."""
    return _plain_digits(F.regexp_replace(strip(col), r"\((.*)\)", "-$1"))


def two_decimals(number: Column) -> Column:
    return F.coalesce(
        number.try_cast("decimal(38,2)").cast("string"), F.format_string("%.2f", number)
    )


def currency_of(col: Column) -> Column:
    """Code of the first known symbol, symbols looked for in their fixed order."""
    found = None
    for symbol, code in fixed.SYMBOL_CURRENCY.items():
        test = col.contains(symbol)
        found = F.when(test, code) if found is None else found.when(test, code)
    return found


def parse_money(col: Column) -> Column:
    """STRUCT<normalized, number, currency>, NULL unless a known symbol and a number."""
    number = parse_number(col)
    currency = currency_of(col)
    return F.when(
        currency.isNotNull() & number.isNotNull(),
        F.struct(
            two_decimals(number).alias("normalized"),
            number.alias("number"),
            currency.alias("currency"),
        ),
    )


def looks_like_money(col: Column, stripped: bool = False) -> Column:
    """A symbol in front or a currency code at either end, and a number in the rest.

    Symbols and codes hold no digit, so the number test may read the whole value.
    """
    codes = "|".join(fixed.MONEY_CODES)
    text = col if stripped else strip(col)
    # A code at the end is looked for there, not from every character on.
    longest = max(map(len, fixed.MONEY_CODES))
    last = F.right(text, F.lit(1))
    front = ~starts_with_digit(text) & text.rlike(rf"(?s)^(?:[{fixed.MONEY_SYMBOLS}]|(?i:{codes}))")
    back = (last >= "A") & (last < "{") & F.substring(text, -longest, longest).rlike(rf"(?i)(?:{codes})$")
    marked = front | back
    return F.coalesce(marked & has_number(text), F.lit(False))


_UNIT = "|".join(sorted(fixed.UNITS, key=len, reverse=True))
_QUANTITY = r"-?[0-9]+(?:[.,][0-9]+)*"
_SPACED_NUMBER = r"[0-9]\s|\s-?[0-9]"
_MEASUREMENT = rf"(?i)^(?:{_QUANTITY}\s+({_UNIT})|({_UNIT})\s+{_QUANTITY})$"


def _unit_table() -> Column:
    rows = [
        f"'{unit}', named_struct('unit', '{rule[0]}', 'factor', {rule[1]!r}D, 'offset', {rule[2]!r}D)"
        for unit, rule in fixed.UNITS.items()
        if rule is not None
    ]
    return F.expr("map(" + ", ".join(rows) + ")")


def convert_unit(number: Column, unit: Column) -> Column:
    """STRUCT<number, unit> in the standard unit; units without a standard are kept."""
    rule = F.try_element_at(_unit_table(), F.lower(F.btrim(unit)))
    return F.struct(
        F.coalesce(number * rule["factor"] + rule["offset"], number).alias("number"),
        F.coalesce(rule["unit"], unit).alias("unit"),
    )


def format_measurement(number: Column, unit: Column) -> Column:
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    # Both round half up; the cast is quicker, but knows no -0.
    exact = F.when(F.abs(number) >= 0.0001, number.try_cast("decimal(38,4)").cast("string"))
    digits = F.coalesce(exact, F.format_string("%.4f", number))
    short = F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))
    amount = F.when(whole, number.try_cast("bigint").cast("string")).otherwise(short)
    return F.concat(amount, F.lit(" "), unit)


def _is_measurement(text: Column) -> Column:
    """The long list of units is gone through only where a number stands beside a space."""
    return text.rlike(_SPACED_NUMBER) & text.rlike(_MEASUREMENT)


def measurement_parts(text: Column) -> tuple[Column, Column]:
    """(unit as written, quantity) of a trimmed measurement text, NULLs when it is none."""
    is_one = _is_measurement(text)
    unit = F.when(is_one, F.regexp_replace(text, _MEASUREMENT, "$1$2"))
    return unit, F.when(is_one, _plain_digits(text))


def parse_measurement(col: Column) -> Column:
    """STRUCT<normalized, number, unit> for `number unit` or `unit number`, else NULL."""
    unit, number = measurement_parts(strip(col))

    # Bound once by the lambda, used several times in its body.
    def record(m: Column) -> Column:
        return F.when(
            m["number"].isNotNull(),
            F.struct(
                format_measurement(m["number"], m["unit"]).alias("normalized"),
                m["number"].alias("number"),
                m["unit"].alias("unit"),
            ),
        )

    return F.transform(F.array(convert_unit(number, unit)), record)[0]


def looks_like_measurement(col: Column, stripped: bool = False) -> Column:
    text = col if stripped else strip(col)
    return F.coalesce(_is_measurement(text) & has_number(text), F.lit(False))


def format_number_display(number: Column) -> Column:
    """Thousands separators; whole numbers without decimals, others with two."""
    rounded = F.rint(number)
    return F.when(F.abs(number - rounded) < 1e-9, F.format_number(rounded, 0)).otherwise(
        F.format_number(number, 2)
    )


def _number_text(number: Column) -> Column:
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(number.cast("string"))


def format_measure_display(number: Column, currency: Column, unit: Column) -> Column:
    symbol = F.coalesce(
        F.try_element_at(_literal_map(fixed.DISPLAY_SYMBOLS), currency),
        F.concat(currency, F.lit(" ")),
    )
    return (
        F.when(F.coalesce(currency, F.lit("")) != "", F.concat(symbol, two_decimals(number)))
        .when(F.coalesce(unit, F.lit("")) != "", F.concat(_number_text(number), F.lit(" "), unit))
        .otherwise(_number_text(number))
    )
