"""Canonical forms of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guid(col: Column | str) -> Column:
    """A GUID in lower case without braces and blanks around it; null stays null, an empty one is null."""
    c = F.col(col) if isinstance(col, str) else col
    plain = F.lower(F.regexp_replace(c, r"^[\s{}]+|[\s{}]+$", ""))
    return F.when(plain != "", plain)


def month(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM")
