"""Vector column functions (Column -> Column).

Spark 4.1 has no built-in vector distance for ``array<double>``; these are
written with higher-order functions so they stay inside the JVM.  The heavy
k-NN path (``operators.knn``) uses numpy over packed blocks instead, because
higher-order functions over wide arrays fall back from whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column | str) -> Column:
    """``array<float>`` -> ``array<double>`` (exact widening)."""
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x)


def sq_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance (V1), summed left to right."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity (V2); null when one of the norms is zero."""
    den = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(den > 0, dot(a, b) / den)


def vector_shape(df, vec: str = "vec"):
    """V5: number of vectors and their smallest / largest width (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vec)).alias("min_dim"),
                  F.max(F.size(vec)).alias("max_dim"))
