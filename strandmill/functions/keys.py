"""Keys as they are compared, not as they are written."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def comparable_key(column: Column | str) -> Column:
    """Lower case, without surrounding Unicode white space (line ends included); null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
