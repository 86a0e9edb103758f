"""Query plans composed from the operators; ``load`` fills the registry."""

from importlib import import_module

MODULES = ("ledger", "stats", "inventory", "codes", "evidence", "learning", "evaluation", "sessions")


def load() -> None:
    for name in MODULES:
        import_module(f"ledgerlens.plans.{name}")
