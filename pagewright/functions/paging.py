"""Pages shown together and the way between them. A spread has its even page left; the first page stands alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pages_for(page: Column, total: Column, spread: bool) -> Column:
    """The pages that are shown with ``page``, those beyond the end left out."""
    if not spread:
        return F.array(page)
    left = F.when(page <= 1, 1).otherwise(page - page % 2)
    both = F.when(left == 1, F.array(left)).otherwise(F.array(left, left + 1))
    return F.filter(both, lambda p: p.between(F.lit(1), total))


def next_page(page: Column, total: Column, spread: bool) -> Column:
    """The page to go on to; the last stays."""
    step = page + 1 if not spread else F.when(page <= 1, 2).otherwise(page - page % 2 + 2)
    return F.when(step <= total, step).otherwise(page)


def previous_page(page: Column, spread: bool) -> Column:
    """The page to go back to; the first stays."""
    step = page - 1 if not spread else page - page % 2 - 2
    return F.greatest(F.lit(1), step)
