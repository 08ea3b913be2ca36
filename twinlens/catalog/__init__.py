"""The registered queries."""

from __future__ import annotations


def load():
    """Import every catalog module and return the registry."""
    from twinlens.catalog import fidelity, models, scoring, tables  # noqa: F401
    from twinlens.catalog.registry import REGISTRY

    return REGISTRY
