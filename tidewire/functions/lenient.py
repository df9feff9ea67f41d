"""Lenient casts, text clean-up and timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as blank when a log field is trimmed.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: date and time with a blank or a T between them, fraction optional.
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$"


def once(value: Column) -> Column:
    """``value``, worked out once however often it is used further on; for ``select``.

    The outer form keeps the filters that use it above it.
    """
    return F.explode_outer(F.array(value))


def trim_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def parse_timestamp(c: Column) -> Column:
    """Both log forms (blank or T separator); anything else becomes null."""
    text = c.cast("string")
    return F.when(text.rlike(TIMESTAMP_PATTERN), text.try_cast("timestamp"))


def size_field(c: Column) -> Column:
    """A size field of a log line as bigint; blank and unparsable give null.

    A value with a dot is cut towards zero, one without must be a whole number.
    """
    plain = F.replace(c, F.lit("_"), F.lit(""))
    whole = F.when(c.rlike(r"^[+-]?\d+(_\d+)*$"), plain.try_cast("bigint"))
    dotted = F.when(
        c.rlike(r"^[+-]?(\d+(_\d+)*\.(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"),
        plain.try_cast("double").try_cast("bigint"),
    )
    return F.coalesce(whole, dotted)


def nonnegative(c: Column) -> Column:
    return F.when(c < 0, F.lit(0)).otherwise(c)
