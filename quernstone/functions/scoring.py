"""Scores as column expressions: cosines, normalisation, fusion, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HYBRID = (0.55, 0.35, 0.10)
SUMMARY = (0.65, 0.25, 0.10)
FUSION = (0.65, 0.35)
#: Named filter profiles: least score, least semantic and least lexical score.  Fixed values.
PROFILES = [("宽松", 0.0, 0.50, 0.08), ("均衡", 0.20, 0.56, 0.12), ("严格", 0.35, 0.62, 0.18)]


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_zip(a: Column, b: Column) -> Column:
    """Cosine whose product runs over the shorter vector and whose norms over whole vectors; 0 without a length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_strict(a: Column, b: Column) -> Column:
    """Cosine of vectors of one size, 0 for empty ones or different sizes."""
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 0.0).otherwise(cosine_zip(a, b))


def max_normalised(score: Column, *by: str) -> Column:
    """The score divided by its group's greatest, 0 where that isn't positive."""
    top = F.max(score).over(Window.partitionBy(*by))
    return F.when(top > 0, score / top).otherwise(F.lit(0.0))


def passes_any(semantic: Column, lexical: Column, score: Column, t: tuple[float, float, float], both_zero: bool = False) -> Column:
    """Semantic or lexical score (or, with ``both_zero``, neither channel) reaches its threshold, and the score its own."""
    either = (semantic >= t[0]) | (lexical >= t[1])
    if both_zero:
        either = either | ((semantic == 0) & (lexical == 0))
    return either & (score >= t[2])


def exact_bonus(terms: Column, content: Column, cap: int = 8) -> Column:
    """Share of ``cap`` different terms that the lower-case content holds, at most 1."""
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(content), t)))
    return F.least(F.lit(1.0), hits / float(cap))
