"""Sparse feature strings: ``field \\x02 fid \\x03 value`` tokens separated by ``\\x01``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators of the raw log.
TOKEN_SEP = "\x01"
FIELD_SEP = "\x02"
VALUE_SEP = "\x03"

_DIGITS = r"\d+(?:_\d+)*"
_FINITE = rf"^\s*[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$"
_DOUBTFUL = r"[dDfFxXpP]"
_NAN = r"(?i)^\s*[+-]?nan\s*$"
_INF = r"(?i)^\s*[+-]?inf(?:inity)?\s*$"


def parse_number(text: Column) -> Column:
    """The double a number text stands for, NULL for anything else.

    Spark's own cast takes ``1.0f`` and refuses ``1_000``; the log format has it the other way round.
    Ordinary numbers pass on the cast alone; only texts with a letter it may misread meet the grammar.
    """
    cast = text.try_cast("double")
    plain = F.regexp_replace(F.trim(text), "_", "")
    return (
        F.when(cast.isNotNull() & ~text.rlike(_DOUBTFUL), cast)
        .when(text.rlike(_FINITE), plain.try_cast("double"))
        .when(text.rlike(_NAN), F.lit(float("nan")))
        .when(text.rlike(_INF), F.lower(plain).try_cast("double"))
    )


def raw_tokens(feature_string: Column) -> Column:
    """The non-empty token texts of one feature string."""
    return F.filter(F.split(feature_string, TOKEN_SEP), lambda t: t != F.lit(""))


def token_parts(token: Column) -> Column:
    """struct(field, fid, val); a part that is missing or not a number is NULL."""
    halves = F.split(token, FIELD_SEP, 2)
    rest = F.try_element_at(halves, F.lit(2))
    pair = F.split(rest, VALUE_SEP, 2)
    value_text = F.try_element_at(pair, F.lit(2))
    return F.struct(
        F.element_at(halves, 1).alias("field"),
        F.element_at(pair, 1).alias("fid"),
        parse_number(value_text).cast("float").alias("val"),
    )
