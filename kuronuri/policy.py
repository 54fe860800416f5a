"""Masking policy: a frozen driver-side object whose values become literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from kuronuri import vocab


@dataclass(frozen=True)
class Policy:
    allow_terms: tuple[str, ...] = ("甲", "乙", "丙", "丁")
    mode: str = "LABEL"
    black_min_len: int = 3
    label_format: Mapping[str, str] = field(default_factory=lambda: dict(vocab.LABEL_FORMATS))
    review_threshold: float = 0.8
    address_granularity: str = "UNTIL_CITY"
    japanese_ratio_threshold: float = 0.2
    # 0 switches a limit off.  Limits leave hits unmasked or change what is found, so none is set
    # unless a user asks for it.
    max_rects_per_term: int = 0
    min_term_length: int = 1
    priorities: Mapping[str, int] = field(default_factory=lambda: dict(vocab.PRIORITIES))
    force_fast: bool = False
    fast_threshold_chars: int = 0
    chunk_size: int = 0
    chunk_overlap: int = 300
    prefectures: tuple[str, ...] = vocab.PREFECTURES
    municipalities: tuple[str, ...] = vocab.MUNICIPALITIES

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any] | None) -> Policy:
        """Policy from a parsed document; a missing section takes its code default.

        An empty document therefore has no allow-list, formats or priorities,
        which differs from ``Policy()``, the shipped settings.
        """
        doc = doc or {}
        out, perf = doc.get("output") or {}, doc.get("performance") or {}
        pdf = doc.get("pdf") or {}
        allow = ((doc.get("global") or {}).get("allowlist") or {}).get("terms") or []
        return cls(
            allow_terms=tuple(allow),
            mode=out.get("mode", "LABEL"),
            black_min_len=int(out.get("black_min_len", 3)),
            label_format=dict(out.get("label_format") or {}),
            review_threshold=float((doc.get("review") or {}).get("threshold", 0.8)),
            address_granularity=(doc.get("address") or {}).get("granularity", "UNTIL_CITY"),
            japanese_ratio_threshold=float(pdf.get("japanese_ratio_threshold", 0.2)),
            max_rects_per_term=int(pdf.get("max_rects_per_term", 0)),
            min_term_length=int(pdf.get("min_term_length", 1)),
            priorities={
                (e.get("name") or ""): int(e.get("priority", 0) or 0)
                for e in doc.get("entities") or []
                if isinstance(e, Mapping)
            },
            force_fast=bool(perf.get("force_fast", False)),
            fast_threshold_chars=int(perf.get("fast_threshold_chars") or 0),
            chunk_size=int(perf.get("nlp_chunk_size") or 0),
            chunk_overlap=int(perf.get("nlp_chunk_overlap") or 300),
        )


def load_policy(path: str) -> Policy:
    """Read a YAML policy file (JSON is YAML too); an empty file gives the defaults."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        import yaml
    except ImportError:  # PyYAML is optional: without it only JSON files load
        import json

        return Policy.from_dict(json.loads(raw) if raw.strip() else {})
    return Policy.from_dict(yaml.safe_load(raw))
