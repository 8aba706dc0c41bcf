"""Settings and their checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace


# The defaults below are fixed values.


@dataclass(frozen=True)
class Tiers:
    enabled: bool = True
    tier2_trigger: int = 5
    tier3_trigger: int = 10


@dataclass(frozen=True)
class Nudge:
    max_context_limit_pct: float = 0.75
    min_context_limit_pct: float = 0.45
    growth_ratio: float = 0.05
    growth_floor: int = 50_000
    growth_cap: int = 50_000
    min_growth_floor: float = 20_000
    min_growth_ratio: float = 0.45
    emergency_threshold_pct: float = 0.95
    tier2_growth_multiplier: float = 1.5


@dataclass(frozen=True)
class Compress:
    min_compress_range: int = 5000
    max_summary_length: int = 20_000
    min_summary_length: int = 50


@dataclass(frozen=True)
class Config:
    model_context_limit: float
    tiers: Tiers = field(default_factory=Tiers)
    nudge: Nudge = field(default_factory=Nudge)
    compress: Compress = field(default_factory=Compress)
    truncate_threshold: float = 0.95
    promotion_threshold: int = 5
    protected_tools: tuple[str, ...] = ()
    preserve_recent_messages: int = 5
    preserve_recent_tokens: int = 5000
    #: Extra protection hook: (tool name, text) to bool.
    is_tool_protected: Callable[[str, str | None], bool] | None = None
    #: Names of registered text filters that are off, and whether filters run at all.
    filters_enabled: bool = False
    filters_off: frozenset[str] = frozenset()

    def with_(self, **parts) -> Config:
        return replace(self, **parts)


def validate(c: Config) -> list[str]:
    """What is wrong with the settings; nothing is changed or raised."""
    n = c.nudge
    checks = [
        (0 < c.model_context_limit < float("inf"), "model_context_limit must be a positive number"),
        (n.min_context_limit_pct <= n.max_context_limit_pct, "min_context_limit_pct must not exceed max_context_limit_pct"),
        (n.max_context_limit_pct <= n.emergency_threshold_pct, "max_context_limit_pct must not exceed emergency_threshold_pct"),
        (c.promotion_threshold >= 1, "promotion_threshold must be at least 1"),
        (0 < c.truncate_threshold <= 1, "truncate_threshold must lie in (0, 1]"),
        (c.tiers.tier2_trigger >= 1, "tier triggers must be at least 1"),
        (c.tiers.tier3_trigger >= 1, "tier triggers must be at least 1"),
        (c.tiers.tier3_trigger > c.tiers.tier2_trigger, "tier3_trigger must be greater than tier2_trigger"),
    ]
    return [text for fine, text in checks if not fine]
