"""Parameters with their default values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

#: Fixed values of the scoring task: normalisation divisors and merchant-category risks.
MCC_RISK = {4511: 0.35, 5311: 0.25, 5411: 0.15, 5812: 0.30, 5912: 0.20, 5944: 0.45, 5999: 0.50, 7801: 0.80, 7802: 0.75, 7995: 0.85}
DEFAULT_RISK = 0.5
NEVER = 9223372036854775807


@dataclass(frozen=True)
class Norm:
    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0


@dataclass(frozen=True)
class SearchParams:
    """k neighbours; probes of the fast and of the full pass; the grid; escalation thresholds by fraud count (index 0 is not used)."""

    k: int = 5
    fast: int = 5
    full: int = 16
    cells: int = 32
    radius: int = 2
    scale: int = 10000
    fast_t: tuple[int, ...] = (NEVER,) * 6

    def probes(self, n: int) -> int:
        return min(n, self.full)

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> SearchParams:
        """FAST_NPROBE and FAST_T1 to FAST_T5; what is missing or no number keeps its default (all probes, never escalate)."""

        def number(key: str, default: int) -> int:
            try:
                return int(env[key])
            except (KeyError, ValueError):
                return default

        return cls(fast=number("FAST_NPROBE", cls.full), fast_t=(NEVER, *(number(f"FAST_T{i}", NEVER) for i in range(1, 6))))
