"""Operators for text corpora: clusters, personal items, near-duplicates, new text, tokens, mixtures, pieces.

Nothing outside this package imports it.
"""

from __future__ import annotations

import importlib
import importlib.util

_PLANS = ["clusters_plan", "personal_plan", "near_plan", "newtext_plan", "token_plan", "mixture_plan", "pieces_plan"]


def plans() -> list:
    """The modules that hold QUERIES and ORACLES."""
    return [importlib.import_module(f"{__name__}.{name}") for name in _PLANS if importlib.util.find_spec(f"{__name__}.{name}")]
