"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that makes a value blank: Unicode separators and the ASCII and C1 controls that count as space.
BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*$"
#: What separates tokens: anything but letters and numbers.
SEPARATOR = r"[^\p{L}\p{N}]+"


def is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(BLANK)


def tokens(value: Column) -> Column:
    return F.array_remove(F.split(F.lower(value), SEPARATOR), "")


def document(title: Column, text: Column) -> Column:
    """Title and text on two lines; the text alone under a blank title. Nothing is normalised."""
    return F.when(is_blank(title), text).otherwise(F.concat(title, F.lit("\n"), text))


def close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Whether two doubles agree within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def hash_fraction(*parts) -> Column:
    """A number in [0, 2**32) from the parts: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
