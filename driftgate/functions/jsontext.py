"""JSON text helpers: strict validity, canonical JSON and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_ok(body) -> Column:
    """The whole text is exactly one JSON value (trailing text rejected, as a strict
    parser does): wrapped in brackets it must be an array of length one."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), _c(body), F.lit("]"))) == 1, F.lit(False))


def canonical_json(*cols: str) -> Column:
    """A row as JSON with keys in sorted order at the top level and nulls kept.
    Nested structs should already list their fields alphabetically (the schemas here do
    where a digest is taken)."""
    names = sorted(cols)
    return F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})


def sha256(text) -> Column:
    """Hex sha-256 of the UTF-8 text."""
    return F.sha2(_c(text), 256)


def sorted_struct(col: Column, dtype) -> Column:
    """A column with every struct's fields in alphabetical order, at every level (the key
    order of canonical JSON, X9)."""
    from pyspark.sql import types as T
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[sorted_struct(col[f.name], f.dataType).alias(f.name)
                                                  for f in sorted(dtype.fields, key=lambda f: f.name)]))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda x: sorted_struct(x, dtype.elementType))
    return col
