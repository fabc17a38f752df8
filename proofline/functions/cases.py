"""Reason lists and literal look-ups that stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR = "\x1f"


def listed(*cases: Column) -> Column:
    """Array of the non-null, non-empty strings among ``cases``, in order.

    Joining and splitting text is compiled; ``array_compact`` over the same cases
    would evaluate every condition in interpreted mode.
    """
    return F.array_remove(F.split(F.concat_ws(_SEPARATOR, *cases), _SEPARATOR), "")


def lookup(key: Column, values: Mapping, default: Column | None = None) -> Column:
    """Value of a constant map at ``key``; the map folds into one literal."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)
