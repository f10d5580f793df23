"""Column names taken from a header row. Works on the schema only."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from itertools import count

# The limit and the fallback that imported names follow.
MAX_COLUMN_NAME = 56
FALLBACK_NAME = "Column"

_LETTER_OR_DIGIT = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")


def identifier(text: str) -> str:
    """Letters and digits stay, the rest becomes an underscore; never starts with a digit."""
    kept = "".join(
        "__" if ord(ch) > 0xFFFF else ch if unicodedata.category(ch) in _LETTER_OR_DIGIT else "_"
        for ch in text.strip()
    ).strip("_")
    kept = kept or FALLBACK_NAME
    if unicodedata.category(kept[0]) == "Nd":
        kept = f"{FALLBACK_NAME}_{kept}"
    return kept[:MAX_COLUMN_NAME].rstrip("_") if len(kept) > MAX_COLUMN_NAME else kept


def generated_names(count: int) -> list[str]:
    return [f"{FALLBACK_NAME}{position}" for position in range(1, count + 1)]


def first_free(candidates: Iterable[str], taken: set[str]) -> str:
    """The first candidate that is not taken, case aside; it is taken from now on."""
    name = next(c for c in candidates if c.lower() not in taken)
    taken.add(name.lower())
    return name


def numbered(base: str) -> Iterable[str]:
    """``base``, ``base_2``, ``base_3`` and so on."""
    yield base
    for number in count(2):
        yield f"{base}_{number}"


def column_names(headers: Sequence[str]) -> list[str]:
    """One usable, distinct name per header; repeats get the next free number."""
    taken: set[str] = set()
    given = [identifier(h) if h and h.strip() else f"{FALLBACK_NAME}{i}" for i, h in enumerate(headers, start=1)]
    return [first_free(numbered(base), taken) for base in given]
