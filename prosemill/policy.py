"""Thresholds, weights and bands. All of them can be replaced; none is calibrated."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace


class ConfigError(ValueError):
    """A policy whose values contradict each other."""


# The thresholds, weights, scales and bands that results must agree with.
STATUS_ORDER = (
    "UNSUPPORTED_LANGUAGE", "MIXED_LANGUAGE", "INSUFFICIENT_TEXT", "INSUFFICIENT_STRUCTURE", "UNVERIFIED_PROVENANCE", "UNVALIDATED",
)
TEXT_STATUSES = STATUS_ORDER[:4]
PROVENANCES = ("supervised_unaided", "unsupervised", "unknown")
TEXT_TYPES = ("formal_prose", "informal", "unknown")
COMPONENTS = {"lexical": 0.35, "syntactic": 0.25, "semantic": 0.25, "readability": 0.15}
STYLE_BANDS = ((0, 40, 55, 74), (40, 55, 75, 89), (55, 70, 90, 109), (70, 85, 110, 124), (85, 100, 125, 145))
COMPLEXITY_BANDS = (
    (1, 0, 0, 0.0), (2, 5, 4, 0.30), (3, 7, 6, 0.36), (4, 9, 8, 0.42), (5, 11, 10, 0.48), (6, 14, 13, 0.55), (7, 17, 16, 0.60),
)
LENGTH_TIERS = ((30, "VERY LOW"), (100, "LOW"), (300, "MEDIUM"), (None, "HIGH"))


@dataclass(frozen=True)
class Policy:
    """languages: code -> (IQ mapping validated, complexity bands validated)."""

    version: str = "2026-10-11"
    languages: dict[str, tuple[bool, bool]] = field(default_factory=lambda: {"en": (False, False), "id": (False, False)})
    native_band_languages: tuple[str, ...] = ("en",)
    min_words: int = 250
    min_confidence: float = 0.80
    max_mixed_share: float = 0.20
    max_words_per_mark: float = 40
    max_regional_share: float = 0.15
    min_drift_transitions: int = 5
    max_chars: int = 100_000
    half_width: int = 25
    near_duplicate: float = 0.8
    max_duplicate_ratio: float = 0.2
    max_repeated_share: float = 0.2
    stuffing_min_lexical: float = 60
    max_rare_share: float = 0.15
    min_similarity: float = 0.15
    similarity_scale: tuple[float, float] = (0.3, 0.9)
    weights: dict[str, float] = field(default_factory=lambda: dict(COMPONENTS))
    style_bands: tuple[tuple[float, float, int, int], ...] = STYLE_BANDS
    complexity_bands: tuple[tuple[int, float, float, float], ...] = COMPLEXITY_BANDS
    iq_mean: float = 100
    iq_sd: float = 15
    max_ratio_age: int = 16

    def __post_init__(self) -> None:
        validate(self)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        """A policy from a JSON object of some of its fields."""
        values = json.loads(text)
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ConfigError(f"unknown fields: {sorted(unknown)}")
        kept = {k: tuple(map(tuple, v)) if k.endswith("_bands") else v for k, v in values.items()}
        if "languages" in kept:
            kept["languages"] = {k: tuple(v) for k, v in kept["languages"].items()}
        return replace(cls(), **kept)

    def percentile(self, iq: int) -> int:
        """Share of a normal population below, in percent, from 1 to 99."""
        z = (iq - self.iq_mean) / self.iq_sd
        return int(min(99, max(1, round(50 * (1 + math.erf(z / math.sqrt(2)))))))


def validate(p: Policy) -> None:
    """Style bands must tile 0 to 100 in order; complexity bands must ascend in every threshold."""
    at = 0.0
    for low, high, iq_low, iq_high in p.style_bands:
        if low != at or high <= low or iq_high < iq_low:
            raise ConfigError(f"style band {low} to {high} doesn't continue at {at}")
        at = high
    if at != 100:
        raise ConfigError("style bands must end at 100")
    for a, b in zip(p.complexity_bands, p.complexity_bands[1:], strict=False):
        if any(y <= x for x, y in zip(a, b, strict=True)):
            raise ConfigError(f"complexity band {b[0]} must exceed band {a[0]} in every threshold")
    if set(p.weights) != set(COMPONENTS) or min(p.weights.values()) < 0 or sum(p.weights.values()) <= 0:
        raise ConfigError("weights must be given for the four components")
