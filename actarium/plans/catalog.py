"""Loads all modules that register queries."""

from importlib import import_module

MODULES = ("q_functions", "q_detect", "q_linkage", "q_enrich", "q_quality", "q_search", "q_reports", "q_sources", "q_streaming")


def load() -> None:
    for m in MODULES:
        import_module(f"{__package__}.{m}")


load()
