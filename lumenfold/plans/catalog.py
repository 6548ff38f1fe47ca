"""All registered queries."""

import importlib

from lumenfold.plans.registry import CHECKS, QUERIES

for _part in ("spectra", "quantity", "maps", "fits", "sources", "io", "known", "manymaps", "streams"):
    importlib.import_module(f"lumenfold.plans.queries_{_part}")

__all__ = ["CHECKS", "QUERIES"]
