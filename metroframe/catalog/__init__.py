"""Named queries over the driver tables, with the SQL that checks them."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _name in ("clouds", "joins", "lines", "columns", "signals", "feeds", "networks", "cameras", "shapes", "reports", "streams", "files"):
    importlib.import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
