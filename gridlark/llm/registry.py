"""The queries of the corpus operators and their SQL, for the entry module."""

from __future__ import annotations

import importlib

MODULES = ("alignment", "chat", "decontaminate", "language", "media", "merkle", "mixing", "neardup", "packing", "secrets", "sharding", "substrings", "toxicity")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"gridlark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
