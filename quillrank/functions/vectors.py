"""Column functions on vectors and vector ids."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, an error for unequal lengths."""
    scale = norm(a) * norm(b)
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
        .when(scale == 0, F.lit(0.0))
        .otherwise(dot(a, b) / scale)
    )


def vector_id(strategy: Column, model: Column, chunk_id: Column) -> Column:
    return F.concat_ws(":", strategy, F.replace(model, F.lit("/"), F.lit("_")), chunk_id)


def chunk_id_of(vector_id_col: Column) -> Column:
    parts = F.split(vector_id_col, ":", 3)
    return F.when(F.size(parts) == 3, parts[2]).otherwise(vector_id_col)


def metadata_predicate(conditions: Mapping[str, Any], arrays: frozenset[str] | set[str] = frozenset()) -> Column:
    """Equality and `$in` tests; `$in` on a column named in `arrays` means any-of."""
    keep = F.lit(True)
    for name, expected in conditions.items():
        col = F.col(name)
        if isinstance(expected, Mapping) and "$in" in expected:
            options = list(expected["$in"])
            if name in arrays:
                test = F.arrays_overlap(col, F.array(*[F.lit(o) for o in options]))
            else:
                test = col.isin(options)
        else:
            test = col.eqNullSafe(F.lit(expected))
        keep = keep & F.coalesce(test, F.lit(False))
    return keep
