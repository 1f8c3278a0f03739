"""L1 - settings of a run: the watched municipality, its neighbours, and all thresholds.

A config is a frozen dataclass; the operators read it on the driver and turn it into literals, so nothing
is looked up per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import fixed


def fold_py(text: str) -> str:
    """Driver-side twin of ``functions.text.fold`` for the (small) config strings."""
    return text.lower().translate(str.maketrans(fixed.FOLD_FROM, fixed.FOLD_TO))


@dataclass(frozen=True)
class DetectionConfig:
    """Who is watched and how strictly. ``target`` is the display name of the municipality."""

    target: str
    tax_ids: tuple[str, ...] = ()          # formatted, e.g. "12.345.678/0001-90"; the first is the executive's
    postal_prefixes: tuple[str, ...] = ()  # e.g. ("87670",)
    neighbours: tuple[str, ...] = ()
    extra_terms: tuple[str, ...] = ()
    scan_variants: tuple[str, ...] = ()    # regexes of broken spellings of the target
    named_persons: tuple[str, ...] = ()    # office holders that sign acts, folded
    truncated_stem: str | None = None      # first letters left over by a cut header
    ignored_context: tuple[str, ...] = fixed.IGNORED_CONTEXT
    min_chars_per_page: int = 100
    fast_min_chars: int = 300

    @property
    def key(self) -> str:
        return fold_py(self.target)

    @property
    def tax_roots(self) -> tuple[str, ...]:
        return tuple(re.sub(r"\D", "", t)[:8] for t in self.tax_ids)

    @property
    def neighbour_keys(self) -> tuple[str, ...]:
        return tuple(fold_py(n).strip() for n in self.neighbours)

    @property
    def base_terms(self) -> tuple[str, ...]:
        t = self.target
        return (
            t, f"Prefeitura de {t}", f"Prefeitura Municipal de {t}", f"Câmara de {t}",
            f"Câmara Municipal de {t}", f"Município de {t}",
        ) + self.tax_ids

    @property
    def lexicon(self) -> tuple[tuple[str, str], ...]:
        """D1 - (folded term, label): one per folded form, longest label kept, longest label first."""
        best: dict[str, str] = {}
        for term in self.base_terms + self.extra_terms:
            if not term.strip():
                continue
            folded = fold_py(term)
            if folded not in best or len(term) > len(best[folded]):
                best[folded] = term
        return tuple(sorted(best.items(), key=lambda kv: (-len(kv[1]), kv[1].lower())))

    @property
    def stem(self) -> str:
        return fold_py(self.truncated_stem) if self.truncated_stem else self.key


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of scoring, queues, budgets and liveness."""

    max_future_years: int = 1
    high_min: int = 85
    medium_min: int = 55
    max_attempts: int = 3
    gap_mode: str = "reprocess"
    gap_min_hits: int = 3
    gap_max_acts: int = 1
    alert_importance: int = 3
    absence_days: int = 30
    quarantine_failures: int = 3
    cooldown_minutes: int = 60
    per_cycle: int = 5
    per_hour: int = 15
    per_day: int = 40
    calls_per_cycle: int = 80
    night_start: int = 22
    night_end: int = 6
    night_factor: int = 3
    heartbeat_seconds: int = 180
    cycle_seconds: int = 600
    stuck_minutes: int = 30
