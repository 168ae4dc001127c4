"""Puts a checking query together: the derived tables and shared steps it names, as CTEs, in order."""

from __future__ import annotations

import re

from wardledger.sources.derived import DERIVED, derived_cte

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def _mentioned(text: str, steps: dict[str, str]) -> list[str]:
    found = []
    for word in _WORD.findall(text):
        if (word in steps or word in DERIVED) and word not in found:
            found.append(word)
    return found


def build(text: str, steps: dict[str, str]) -> str:
    """``WITH`` every table or step that ``text`` needs, directly or not, then ``text``."""
    ordered: list[str] = []

    def need(name: str, trail: tuple[str, ...]) -> None:
        if name in ordered or name in trail:
            return
        if name in steps:
            for other in _mentioned(steps[name], steps):
                need(other, (*trail, name))
        ordered.append(name)

    for name in _mentioned(text, steps):
        need(name, ())
    ctes = [f"{n} AS ({steps[n] if n in steps else derived_cte(n)})" for n in ordered]
    return f"WITH {', '.join(ctes)} {text}" if ctes else text
