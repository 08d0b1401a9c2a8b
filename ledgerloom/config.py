"""Settings of a run, from defaults, a mapping or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Limits and thresholds of the report pipeline."""

    skip_rows: int = 3
    batch_size: int = 200
    min_confidence: float = 0.7
    fuzzy_threshold: int = 80
    high_confidence: int = 95
    filter_private: bool = True

    def __post_init__(self) -> None:
        if self.batch_size <= 0:
            raise ValueError("the batch size must be positive")
        if not 0 < self.fuzzy_threshold <= 100:
            raise ValueError("the fuzzy threshold lies between 0 and 100")


def _parsed(text: str, kind: type):
    if kind is bool:
        if text.strip().lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"not a truth value: {text!r}")
        return text.strip().lower() in ("1", "true", "yes", "on")
    return kind(text)


def load_config(settings: Mapping[str, str] | None = None, prefix: str = "LEDGERLOOM_") -> Config:
    """The settings named ``prefix`` and the field in capitals, from a mapping or the environment; absent and blank ones keep their defaults."""
    source = os.environ if settings is None else settings
    given = {f.name: source[prefix + f.name.upper()] for f in fields(Config) if source.get(prefix + f.name.upper(), "").strip()}
    return Config(**{name: _parsed(text, type(getattr(Config, name))) for name, text in given.items()})
