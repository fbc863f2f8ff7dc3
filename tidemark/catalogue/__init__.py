"""Every result as a named query over the driver's tables, with its SQL counterpart.

`queries()` and `oracle_sql()` collect the modules below. The library itself never imports this.
"""

from __future__ import annotations

from . import domains, extracts, incremental, operators, stateful, text
from .registry import Entry

_MODULES = (operators, domains, incremental, stateful, extracts, text)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for module in _MODULES:
        for entry in module.ENTRIES:
            if entry.name in out:
                raise ValueError(f"query {entry.name!r} is registered twice")
            out[entry.name] = entry
    return out
