"""The queries of this package, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("lines", "licenses", "language", "neardup", "quality", "decontaminate", "mixing", "media", "sharding", "repeats", "secrets", "codes", "alignment")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"millrace.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(getattr(_module, "SQL", {}))
