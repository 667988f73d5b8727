"""Named SQL table definitions, put together by dependency."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    PARTS[name] = sql


def _needed(sql: str, seen: dict[str, None]) -> None:
    for word in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql):
        if word in PARTS and word not in seen:
            own = PARTS[word]
            # A recursive part names itself; everything else comes first.
            if word in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", own):
                rest = re.sub(rf"\b(FROM|JOIN)\s+{word}\b", "", own)
                _needed(rest, seen)
            else:
                _needed(own, seen)
            seen[word] = None


def query(body: str) -> str:
    """``body`` with the definitions it needs in front."""
    seen: dict[str, None] = {}
    _needed(body, seen)
    if not seen:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in seen) + "\n" + body
