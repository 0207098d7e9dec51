"""Header and table-name clean-up shared by sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable

SHEET_NAME_LIMIT = 31


def unique_headers(headers: Iterable[object]) -> list[str]:
    """Trim headers, number the blank ones by position and add ``__2``, ``__3`` … to repeats."""
    taken: dict[str, None] = {}
    for position, header in enumerate(headers, start=1):
        stem = ("" if header is None else str(header)).strip() or f"column_{position}"
        name, copy = stem, 1
        while name in taken:
            copy += 1
            name = f"{stem}__{copy}"
        taken[name] = None
    return list(taken)


def unique_table_names(names: Iterable[object]) -> list[str]:
    """Names safe for workbook tabs and folders: at most 31 characters, no reserved characters, no repeats."""
    taken: dict[str, None] = {}
    for raw in names:
        stem = re.sub(r"[\[\]:*?/\\]", "-", str(raw))[:SHEET_NAME_LIMIT] or "Results"
        name, copy = stem, 1
        while name in taken:
            copy += 1
            ending = f"_{copy}"
            name = stem[: SHEET_NAME_LIMIT - len(ending)] + ending
        taken[name] = None
    return list(taken)
