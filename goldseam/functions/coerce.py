"""Text to typed value, as native column expressions.

Two families: ``coerce_*`` for text files, where a value that does not parse
becomes null, and ``strict_*`` for database rows, which have other rules for
booleans, integers and blanks. None of them raises, also under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at either end of a value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Words read as true, and words a boolean column may hold.
TRUE_WORDS = ("true", "1", "yes", "t", "y")
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "t", "f", "y", "n")

# Numbers with optional sign, fraction and exponent; ``_`` may stand between
# two digits. Spark's own cast would also take ``1d`` and refuse ``1_000``. The
# plain forms are tested first: their patterns have no nested repeats.
_DIGITS = r"[0-9](?:_?[0-9])*"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
NUMBER_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
GROUPED_INTEGER_PATTERN = rf"^[+-]?{_DIGITS}$"
GROUPED_NUMBER_PATTERN = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
NON_FINITE_PATTERN = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def strip(value: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes spaces only)."""
    text = value.cast("string")
    # Most text begins and ends with a visible ASCII character and has nothing to strip, which needs no pattern.
    bare = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(bare, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def _blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def _parsed(text: Column, pattern: str, grouped_pattern: str, kind: str) -> Column:
    """Number of stripped text in one of the two forms, else null."""
    grouped = F.contains(text, F.lit("_")) & text.rlike(grouped_pattern)
    return F.when(text.rlike(pattern), text.try_cast(kind)).when(
        grouped, F.replace(text, F.lit("_"), F.lit("")).try_cast(kind)
    )


def _finite(text: Column) -> Column:
    return _parsed(text, NUMBER_PATTERN, GROUPED_NUMBER_PATTERN, "double")


def _integer(text: Column, kind: str) -> Column:
    return _parsed(text, INTEGER_PATTERN, GROUPED_INTEGER_PATTERN, kind)


def parse_double(text: Column) -> Column:
    """Double of stripped text, including ``nan`` and ``inf``; else null."""
    special = F.when(
        text.rlike(NON_FINITE_PATTERN),
        F.when(F.lower(text).contains("nan"), F.lit(float("nan")))
        .when(text.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf"))),
    )
    return F.coalesce(_finite(text), special)


def coerce_bool(value: Column, stripped: Column | None = None) -> Column:
    """A true-word gives true, any other text false, blank or null gives null."""
    text = value.cast("string")
    stripped = strip(text) if stripped is None else stripped
    return F.when(~_blank(text), F.lower(stripped).isin(*TRUE_WORDS))


def coerce_int(value: Column, stripped: Column | None = None) -> Column:
    """Whole part of the number, cut toward zero; plain digits keep every digit.

    Null beyond 64 bits: inference gives columns with such values the type ``wide``.
    """
    text = strip(value) if stripped is None else stripped
    whole = _finite(text).try_cast("bigint")
    # No double equals the largest long: the cast has met 2^63, which does not fit.
    return F.coalesce(_integer(text, "bigint"), F.nullif(whole, F.lit((1 << 63) - 1)))


def coerce_wide_int(value: Column, stripped: Column | None = None) -> Column:
    """As :func:`coerce_int` for identifiers of up to 38 digits."""
    text = strip(value) if stripped is None else stripped
    number = _finite(text)
    # From 2^53 on, a double has no fraction to cut.
    cut = F.when(F.abs(number) < float(1 << 53), number.try_cast("bigint").cast("decimal(38,0)")).otherwise(
        number.try_cast("decimal(38,0)")
    )
    return F.coalesce(_integer(text, "decimal(38,0)"), cut)


def coerce_float(value: Column, stripped: Column | None = None) -> Column:
    return parse_double(strip(value) if stripped is None else stripped)


def coerce_str(value: Column, stripped: Column | None = None) -> Column:
    """Stripped text. Blank text of length 0 gives null, mere white space ``''``."""
    text = value.cast("string")
    return F.when(~_blank(text), strip(text) if stripped is None else stripped)


_COERCERS = {"bool": coerce_bool, "int": coerce_int, "float": coerce_float, "str": coerce_str, "wide": coerce_wide_int}


def coerce(value: Column, kind: str, stripped: Column | None = None) -> Column:
    """Value of the given type; ``stripped`` may pass text that is already stripped."""
    return _COERCERS[kind](value, stripped)


def strict_bool(value: Column, source_kind: str = "str") -> Column:
    """Truth of a database value: any non-empty text, any non-zero number."""
    return value != "" if source_kind == "str" else value.cast("double") != 0


def strict_int(value: Column, source_kind: str = "str") -> Column:
    """Whole-number text only (``'3.7'`` fails); a stored number is cut."""
    if source_kind != "str":
        return value.try_cast("bigint")
    return _integer(strip(value), "bigint")


def strict_wide_int(value: Column, source_kind: str = "str") -> Column:
    """As :func:`strict_int` for identifiers of up to 38 digits."""
    if source_kind != "str":
        return coerce_wide_int(value)
    return _integer(strip(value), "decimal(38,0)")


def strict_float(value: Column, source_kind: str = "str") -> Column:
    return parse_double(strip(value)) if source_kind == "str" else value.cast("double")


def strict_str(value: Column, source_kind: str = "str") -> Column:
    """The text as stored: no stripping, and ``''`` stays."""
    return value.cast("string")


_STRICT = {"bool": strict_bool, "int": strict_int, "wide": strict_wide_int, "float": strict_float, "str": strict_str}


def coerce_strict(value: Column, kind: str, source_kind: str = "str") -> Column:
    return _STRICT[kind](value, source_kind)
