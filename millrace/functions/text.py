"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes. Spark's trim() removes the space only.
STRIP_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends; a character set is linear where a regex backtracks."""
    return F.btrim(text, F.lit(STRIP_CHARACTERS))


def email_domain(email: Column) -> Column:
    """The text between the first and the second ``@``; NULL without an ``@``."""
    return F.get(F.split(email, "@"), F.lit(1))


def packed_field(packed: Column, delimiter: str, index: int) -> Column:
    """Field ``index`` of a delimited string; NULL when the string is too short."""
    return F.get(F.split(packed, rf"\Q{delimiter}\E"), F.lit(index))


def uuid_text(binary: Column) -> Column:
    """A 16-byte value as lower-case UUID text."""
    return F.regexp_replace(
        F.lower(F.hex(binary)),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )
