"""Vector expressions; arithmetic is in double whatever the stored type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import Col, _c


def dot(a: Col, b: Col) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Col) -> Column:
    return F.sqrt(dot(a, a))


def cosine_with_norms(a: Col, b: Col, norm_a: Col, norm_b: Col) -> Column:
    denominator = _c(norm_a) * _c(norm_b)
    usable = (F.size(_c(a)) == F.size(_c(b))) & (denominator != 0)
    return F.when(usable, dot(a, b) / denominator).otherwise(F.lit(0.0))


def cosine(a: Col, b: Col) -> Column:
    """Cosine similarity; 0 for a zero vector and for unequal lengths."""
    return cosine_with_norms(a, b, norm(a), norm(b))
