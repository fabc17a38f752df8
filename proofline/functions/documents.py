"""JSON documents as variants, read as strictly as one whole document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_variant(raw: Column | str) -> Column:
    """The document as the only element of a list, or null when the text is not exactly one JSON value.

    The parser stops after the first value; inside brackets anything left over is an error.
    """
    text = F.col(raw) if isinstance(raw, str) else raw
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def with_document(docs: DataFrame, raw: str, name: str = "_v") -> DataFrame:
    """Add the parsed document; the generator keeps the parse from being repeated per use."""
    parsed = docs.select("*", F.explode(F.array(strict_variant(raw))).alias(name))
    alone = F.try_variant_get(name, "$[0]", "variant").isNotNull() & F.try_variant_get(name, "$[1]", "variant").isNull()
    return parsed.withColumn(name, F.when(alone, F.col(name)))


def value_at(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, f"$[0].{path}" if path else "$[0]", kind)


def text_at(variant: Column, path: str) -> Column:
    return value_at(variant, path, "string")


def kind_at(variant: Column, path: str = "") -> Column:
    """Type name of a value: BIGINT, BOOLEAN, STRING, ARRAY<...>, OBJECT<...>, VOID, or null when absent."""
    return F.schema_of_variant(value_at(variant, path, "variant"))
