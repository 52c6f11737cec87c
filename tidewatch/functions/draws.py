"""Seeded draws as column expressions, the same in any engine with MD5: no state, no order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(*parts: Column | int | str) -> Column:
    """A whole number of 60 bits from the parts, columns (or names) and seeds, as text joined by colons."""
    text = F.concat_ws(":", *[(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def share(*parts: Column | int | str) -> Column:
    """A number from 0 to 1, 1 excluded."""
    return F.shiftright(number(*parts), 7) / float(1 << 53)


def number_sql(*parts: str) -> str:
    """The SQL of :func:`number` for expressions of whole numbers."""
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
