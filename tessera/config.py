"""Settings of an annotation run."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    sample_size: int | None = None  # rows of a table to use; None or 0: all
    use_dbpedia: bool = True
    use_wikidata: bool = True
    language: str = "en"
    use_column_relations: bool = True
    use_uri_analysis: bool = True
    min_value_length: int = 1
    similarity_weight: float = 0.7
    position_weight: float = 0.3
    exact_match_boost: float = 0.2
    min_candidate_confidence: float = 0.3
    candidates_per_cell: int = 3
    cross_source_below: float = 0.7
    min_relation_confidence: float = 0.3
    relations_per_column: int = 3
    min_uri_value_length: int = 3
    uri_boost: float = 0.2
    min_type_confidence: float = 0.2
    types_per_column: int = 5
    parent_weight: float = 0.7
    as_of_year: int = field(default_factory=lambda: datetime.date.today().year)
    # Opt-in steps.
    correct: bool = True
    apply_relation_boost: bool = False
    relation_boost: float = 0.2
    confidence_threshold: float | None = None

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    @classmethod
    def preset(cls, name: str) -> Config:
        """low, medium or high: sample size, column relations, URI analysis."""
        sample, relations, uris = {"low": (20, False, False), "medium": (50, True, True), "high": (100, True, True)}[name]
        return cls(sample_size=sample, use_column_relations=relations, use_uri_analysis=uris)
