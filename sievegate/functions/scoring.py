"""Column functions for relevance scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions.text import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, v: s + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 for empty, unequal or zero ones."""
    a, b = col(a), col(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def distance_to_similarity(d: Column | str) -> Column:
    d = col(d).cast("double")
    return F.when(finite(d), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - d))).otherwise(0.0)


def keyword_score(raw: Column | str) -> Column:
    """Batch-independent keyword score in (0.5, 1); 0 for no score."""
    raw = col(raw).cast("double")
    return F.when(
        finite(raw) & (raw > 0), 1.0 / (1.0 + F.exp(-raw / fixed.BM25_SATURATION))
    ).otherwise(0.0)


def display_score(similarity: Column | str, raw: Column | str) -> Column:
    """Shown relevance: weighted mix when both exist, else the one that does."""
    sim, raw = col(similarity), col(raw)
    w = fixed.DISPLAY_SEMANTIC_WEIGHT
    mix = (
        F.when(sim.isNull() & raw.isNull(), 0.0)
        .when(sim.isNull(), keyword_score(raw))
        .when(raw.isNull(), sim)
        .otherwise(w * sim + (1 - w) * keyword_score(raw))
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mix)), 6)


def rrf(rank: Column | str) -> Column:
    """Reciprocal rank share of a 0-based rank."""
    return 1.0 / (fixed.RRF_K + 1 + col(rank))


def overlap_f1(query_set: Column, text_set: Column) -> Column:
    both = F.size(F.array_intersect(query_set, text_set))
    p = both / F.greatest(F.lit(1), F.size(text_set))
    r = both / F.greatest(F.lit(1), F.size(query_set))
    return F.when(both > 0, 2 * p * r / F.greatest(F.lit(1e-9), p + r)).otherwise(0.0)


def numeric_score(score: Column, relevance: Column) -> Column:
    """First present of the two as a number; null if it is not numeric."""
    return F.coalesce(score, relevance).try_cast("double")


def clamp_level(c: Column) -> Column:
    return F.greatest(F.lit(fixed.MIN_LEVEL), F.least(F.lit(fixed.MAX_LEVEL), c))


def level_rank(name: Column | str) -> Column:
    """0-based rank of a sensitivity name; 0 for unknown names."""
    names = F.array(*[F.lit(n) for n in fixed.LEVEL_NAMES])
    return F.greatest(
        F.lit(0), F.coalesce(F.array_position(names, col(name)), F.lit(0)).cast("int") - 1
    )


def level_name(rank: Column) -> Column:
    names = F.array(*[F.lit(n) for n in fixed.LEVEL_NAMES])
    top = len(fixed.LEVEL_NAMES) - 1
    return F.element_at(names, F.greatest(F.lit(0), F.least(F.lit(top), rank)) + 1)
