"""Presets and closed vocabularies; plain values that operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# English function words that carry no meaning for retrieval.
STOPWORDS = (
    "a an the and or nor but so if then else than that this these those there here it its is are was were be been being am do does did "
    "have has had having will would shall should may might can could must of in on at by for with without from to into onto as not no "
    "such via when while where which who whom whose also any all each per own same too very s"
).split()

# Allowed words of requirement documents.
STATUSES = ("proposed", "partial", "implemented")
PRIORITIES = ("P0", "P1", "P2")
DEFAULT_PRIORITY = "P1"
DIFFICULTIES = ("high-overlap", "partial-overlap", "domain-vocabulary")
CLASSIFICATIONS = ("implements", "supports", "unrelated")
BANDS = ("suggest", "review", "discard")


@dataclass(frozen=True)
class LexicalConfig:
    """Field weights and priors of lexical retrieval."""

    configuration_id: str = "bm25f-v5"
    k1: float = 1.2
    b: float = 0.75
    weights: dict[str, float] = field(default_factory=lambda: {"name": 4.0, "signature": 3.0, "documentation": 2.0, "path": 2.0, "source": 1.0})
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    kind_weights: dict[str, float] = field(default_factory=lambda: {"file": 0.5, "module": 0.5})
    fold_plurals: bool = True
    plural_revision: int = 2
    protect_identifiers: bool = True
    containment: float | None = 0.15


LEXICAL_V5 = LexicalConfig()
LEXICAL_V4 = LexicalConfig(configuration_id="bm25f-v4", containment=None)
LEXICAL_V3 = LexicalConfig(configuration_id="bm25f-v3", containment=None, plural_revision=1, protect_identifiers=False)


@dataclass(frozen=True)
class Budget:
    """Greatest lengths of the texts in a payload."""

    requirement: int = 4000
    signature: int = 500
    documentation: int = 1000
    source: int = 2000
