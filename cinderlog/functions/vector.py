"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def as_sent(vector: Column) -> Column:
    """A query vector as its text form keeps it: six decimals."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), 6))


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.length(text)
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = F.transform(letters, lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double") / F.greatest(n, F.lit(1)))
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))
