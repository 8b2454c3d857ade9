"""Similarity of names and search confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; 1 if equal, 0 if only one is empty."""
    x, y = F.split(a, ""), F.split(b, "")
    ratio = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(ratio)


def position(pos: Column, n_results: Column) -> Column:
    return 1 - pos / F.greatest(n_results, F.lit(1))


def search_confidence(query: Column, label: Column, pos: Column, n_results: Column, similarity_weight: float = 0.7, position_weight: float = 0.3) -> Column:
    return similarity_weight * characters(F.lower(query), F.lower(label)) + position_weight * position(pos, n_results)
