"""Predicates on memories."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def live() -> Column:
    return ~F.col("tombstoned")


def current() -> Column:
    return live() & ~F.col("superseded")


def where(layer: int | None = None, entity_mask: int | None = None, created: tuple | None = None, valid: tuple | None = None) -> Column:
    """All given conditions; layer -1 or None is any, a mask needs a common bit, ranges are inclusive."""
    terms = []
    if layer is not None and layer != -1:
        terms.append(F.col("layer") == layer)
    if entity_mask is not None:
        terms.append(F.col("entity_bitmap").bitwiseAND(F.lit(entity_mask)) != 0)
    if created is not None:
        terms.append(F.col("created_at_ns").between(*created))
    if valid is not None:
        terms.append(F.col("valid_from_ns").between(*valid))
    return reduce(lambda a, b: a & b, terms, F.lit(True))
