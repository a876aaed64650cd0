"""Sets of features as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bundlelens import rules


def jaccard(a: Column, b: Column) -> Column:
    """Shared by united elements; 0 where a set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(of: Column, within: Column) -> Column:
    """The share of `of` that `within` has; 0 of an empty set."""
    return F.when(F.size(of) == 0, 0.0).otherwise(F.size(F.array_intersect(of, within)) / F.size(F.array_distinct(of)))


def distinctive(features: Column) -> Column:
    """Features that tell modules apart."""
    return F.filter(features, lambda f: ~f.startswith("A:") & ~f.isin(rules.GENERIC_FEATURES))


def ranked_first(items: Column) -> Column:
    """Distinct elements in the order of their first appearance."""
    return F.array_distinct(items)
