"""Column functions on names and free text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tabulith import fixed

WS = r"[\s\x1c-\x1f]"


def strip(col: Column) -> Column:
    """Both ends trimmed of every kind of whitespace."""
    return F.btrim(col, F.lit(fixed.WHITESPACE))


def strip_column(col: Column) -> Column:
    """`strip` of a column that is there already, looked at several times: most values have nothing
    to trim but spaces, and plain comparisons tell that of both ends."""
    bare = F.btrim(col)
    last = F.right(bare, F.lit(1))
    plain = (bare >= "!") & (bare < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(plain, bare).otherwise(strip(col))


def starts_with_digit(col: Column) -> Column:
    """Whether the first character is one of 0-9, told by comparisons."""
    return (col >= "0") & (col < ":")


def collapse_spaces(col: Column) -> Column:
    return strip(F.regexp_replace(col, rf"(?U){WS}+", " "))


def word_set(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


# ── Unicode forms ─────────────────────────────────────────────────────────────
# Text made only of these code points is already in NFC: up to Latin, Cyrillic, punctuation and currency
# signs, Kana, Han, Hangul syllables. None is changed by NFC, a mark or the latter part of another character.
NFC_STABLE = (
    r"\x{0000}-\x{02FF}\x{0400}-\x{0482}\x{048A}-\x{052F}\x{2002}-\x{20C0}\x{3041}-\x{3096}\x{30A1}-\x{30FA}"
    r"\x{4E00}-\x{9FEF}\x{AC00}-\x{D7A3}")
NFC_SUSPECT = rf"[^{NFC_STABLE}]"
NFKC_SUSPECT = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


@F.pandas_udf(StringType())
def _compose_compat(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def is_nfc_suspect(col: Column) -> Column:
    """Whether NFC may change the text; one byte per character settles it for most."""
    return (F.octet_length(col) != F.char_length(col)) & col.rlike(NFC_SUSPECT)


def to_nfc(col: Column) -> Column:
    """NFC form. Only suspect values cross into Python; the rest travel as NULL."""
    suspect = F.when(is_nfc_suspect(col), col)
    return F.coalesce(_compose(suspect), col)


def to_nfkc(col: Column) -> Column:
    suspect = F.when(col.rlike(NFKC_SUSPECT), col)
    return F.coalesce(_compose_compat(suspect), col)


# ── names ─────────────────────────────────────────────────────────────────────


def normalize_header(col: Column, unicode_form: bool = True) -> Column:
    """Header text to snake_case; `unicode_form` folds compatibility characters first."""
    c = to_nfkc(col) if unicode_form else col
    c = collapse_spaces(F.coalesce(c, F.lit("")))
    for hump in fixed.CAMEL_HUMPS:
        c = F.regexp_replace(c, hump, "$1_$2")
    c = F.regexp_replace(F.lower(c), fixed.NOT_A_WORD, "_")
    return F.btrim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def sanitize_name(col: Column) -> Column:
    c = F.regexp_replace(strip(col), r"(?i)\.(csv|tsv)$", "")
    c = F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"[^A-Za-z0-9 _-]", "")
    c = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.substring(c, 1, fixed.NAME_LENGTH)


def name_collision_key(col: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(sanitize_name(col), r"[^A-Za-z0-9]+", " ")))


def match_token(col: Column) -> Column:
    """Lower-case alphanumeric words, one space between: the form names are compared in."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", " "))


def clean_description(col: Column) -> Column:
    c = strip(F.regexp_replace(col, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.nullif(F.substring(c, 1, fixed.DESCRIPTION_LENGTH), F.lit(""))


# ── values ────────────────────────────────────────────────────────────────────


NULL_LIKE = "(?i)^(?:" + "|".join(fixed.NULL_LIKES) + ")$"

#: What may hold more than single spaces between words, in a trimmed text.
_SPACED_OUT = r"[^ -~]|  "


def normalize_text_value(col: Column, unicode_form: bool = False) -> Column:
    """Spaces collapsed, null spellings to NULL."""
    c = collapse_spaces(to_nfc(col) if unicode_form else col)
    return F.nullif(F.regexp_replace(c, NULL_LIKE, ""), F.lit(""))


def normalize_trimmed(col: Column) -> Column:
    """`normalize_text_value` of a trimmed column: spaces are only collapsed where there may be some
    to collapse, and only short texts can be null spellings."""
    longest = max(map(len, fixed.NULL_LIKES))
    nothing = (F.octet_length(col) <= longest) & F.lower(col).isin(fixed.NULL_LIKES)
    return F.when(nothing, F.lit(None).cast("string")).when(
        col.rlike(_SPACED_OUT), collapse_spaces(col)).otherwise(col)


# ── tokens ────────────────────────────────────────────────────────────────────


def stem_tokens(col: Column) -> Column:
    """Lower-case alphanumeric tokens with a light plural / tense stem, in text order."""
    words = F.regexp_replace(F.lower(col), r"[^a-z0-9]+", " ")
    # `ies` first; what it yields ends in y, so the suffix rule below leaves it alone.
    words = F.regexp_replace(words, r"\b(\w{2,})ies\b", "$1y")
    words = F.regexp_replace(
        words, r"\b(?:(\w{3,})ing|(\w{3,})ed|(\w{3,})es|(\w{3,})s)\b", "$1$2$3$4"
    )
    return F.array_remove(F.split(words, " "), "")


def normalize_phrase(col: Column) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9% ]+", " ")
    return F.btrim(F.regexp_replace(c, " +", " "))


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whole-word containment of one normalized phrase in another."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (haystack != "") & (needle != "") & pad(haystack).contains(pad(needle))


def extract_keywords(col: Column) -> Column:
    """Tokens of two or more characters that are not stop words; repeats kept."""
    tokens = F.split(F.regexp_replace(F.lower(col), r"(?U)[^\w\s]", " "), rf"(?U){WS}+")
    stop = word_set(fixed.STOP_WORDS)
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def word_tokens(col: Column) -> Column:
    """Distinct search tokens: letters and digits, 2 or more, lower case."""
    tokens = F.split(F.lower(col), r"[^\p{L}\p{N}\p{M}]+")
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 2))


def space_tokens(col: Column) -> Column:
    """Distinct lower-case tokens split on whitespace only."""
    tokens = F.split(F.lower(col), rf"(?U){WS}+")
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))
