"""Column naming: category text becomes part of a name, so it is sanitised."""

from __future__ import annotations

import re
from collections.abc import Iterable


def clean_name(text: str) -> str:
    """Letters, digits and underscores only, so names never need quoting."""
    return re.sub(r"[^A-Za-z0-9_]", "_", text)


def unique_names(names: Iterable[str]) -> list[str]:
    """Suffix later case-insensitive repeats with ``_2``, ``_3`` and so on."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 1
        while candidate.lower() in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate.lower())
        result.append(candidate)
    return result
