"""The configuration file: never fails, falls back to defaults and says so."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from linkloom.sources.frontmatter import read_mapping

MODES = ("lexical", "semantic", "hybrid")


@dataclass
class Settings:
    spec_paths: list[str] = field(default_factory=lambda: ["specs/requirements"])
    exclude: list[str] = field(default_factory=list)
    mode: str = "lexical"
    top_k: int = 10
    ranking_model: str | None = None
    embedding_model: str | None = None
    suggest: float = 0.75
    review: float = 0.5
    warnings: list[tuple[str, str]] = field(default_factory=list)


_KEYS = {"version", "spec_paths", "exclude", "retrieval", "model", "bands"}
_NESTED = {"retrieval": {"mode", "top_k"}, "model": {"ranking", "embedding"}, "bands": {"suggest", "review"}}


def parse_settings(text: str | None) -> Settings:
    """Settings of a YAML text; what is missing or wrong keeps its default and is named in ``warnings`` (key, rule)."""
    out = Settings()
    if text is None:
        out.warnings.append(("", "missing-config"))
        return out
    try:
        raw = read_mapping(text)
    except ValueError:
        raw = None
    if not isinstance(raw, dict):
        out.warnings.append(("", "malformed-config"))
        return out
    raw = {{"specPaths": "spec_paths"}.get(k, k): v for k, v in raw.items()}
    out.warnings += [(k, "unknown-key") for k in raw if k not in _KEYS]
    for group, known in _NESTED.items():
        if isinstance(raw.get(group), dict):
            raw[group] = {{"topK": "top_k"}.get(k, k): v for k, v in raw[group].items()}
            out.warnings += [(f"{group}.{k}", "unknown-key") for k in raw[group] if k not in known]
        elif raw.get(group) is not None:
            out.warnings.append((group, "invalid-value"))
            raw[group] = {}

    def take(key: str, value: Any, valid: bool, name: str) -> None:
        if value is None:
            return
        if valid:
            setattr(out, name, value)
        else:
            out.warnings.append((key, "invalid-value"))

    texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    take("spec_paths", raw.get("spec_paths"), texts(raw.get("spec_paths")), "spec_paths")
    take("exclude", raw.get("exclude"), texts(raw.get("exclude")), "exclude")
    retrieval, model, bands = (raw.get(g) or {} for g in ("retrieval", "model", "bands"))
    take("retrieval.mode", retrieval.get("mode"), retrieval.get("mode") in MODES, "mode")
    k = retrieval.get("top_k")
    take("retrieval.top_k", k, number(k) and k == int(k) and k > 0, "top_k")
    take("model.ranking", model.get("ranking"), isinstance(model.get("ranking"), str), "ranking_model")
    take("model.embedding", model.get("embedding"), isinstance(model.get("embedding"), str), "embedding_model")
    for name in ("suggest", "review"):
        take(f"bands.{name}", bands.get(name), number(bands.get(name)) and 0 <= bands[name] <= 1, name)
    if out.review > out.suggest:
        out.warnings.append(("bands", "invalid-value"))
        out.suggest, out.review = Settings.suggest, Settings.review
    return out


def load_settings(path: str) -> Settings:
    if not os.path.exists(path):
        return parse_settings(None)
    with open(path, encoding="utf-8") as f:
        return parse_settings(f.read())


def parse_ks(text: str, default: tuple[int, ...] = (1, 3, 5, 10)) -> tuple[int, ...]:
    """Cut-offs as ``1,3,5``: distinct positive whole numbers in ascending order."""
    if not text.strip():
        return default
    ks = sorted({int(p) for p in text.split(",")})
    if ks[0] < 1:
        raise ValueError("cut-offs must be positive")
    return tuple(ks)
