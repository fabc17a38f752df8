"""Canonical JSON and SHA-256 as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZERO_HASH = "0" * 64
HEX64 = "^[0-9a-f]{64}$"


def sorted_struct(columns: Mapping[str, Column]) -> Column:
    return F.struct(*[columns[name].alias(name) for name in sorted(columns)])


def canonical_json(columns: Mapping[str, Column]) -> Column:
    """Compact sorted-key JSON for strings, integers, booleans, nulls and nested sorted structs."""
    return F.to_json(sorted_struct(columns), {"ignoreNullFields": "false"})


@F.pandas_udf(StringType())
def _recode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(
            lambda t: None if t is None else json.dumps(
                json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False
            )
        )


def canonical_json_text(raw: Column) -> Column:
    """Canonical form of JSON text of any shape; floats get their shortest decimal form."""
    return _recode(raw)


def finite(col: Column, name: str) -> Column:
    """The value, or a failed query when it is NaN or infinite."""
    bad = F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} is not a finite number")).cast("double")).otherwise(col)


def canonical_json_floats(columns: Mapping[str, Column], floats: set[str]) -> Column:
    """As ``canonical_json`` with floating-point members; NaN and infinity are rejected."""
    checked = {n: finite(c, n) if n in floats else c for n, c in columns.items()}
    return canonical_json_text(canonical_json(checked))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical_sha256(columns: Mapping[str, Column]) -> Column:
    return sha256(canonical_json(columns))
