"""All queries by name, with their SQL equivalents."""

from __future__ import annotations

from .plans import acquisition, budgets, conversion, integrity, layout, linking, numbering, reporting
from .plans.base import Entry

MODULES = (acquisition, layout, budgets, integrity, numbering, linking, conversion, reporting)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for m in MODULES:
        for name, entry in m.ENTRIES.items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = entry
    return out


def queries():
    return {name: e.run for name, e in entries().items()}


def oracle_sql():
    return {name: e.sql for name, e in entries().items() if e.sql}
