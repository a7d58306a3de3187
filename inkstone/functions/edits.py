"""The algebra of edits: ranges of a text and what replaces them, in code points."""

from __future__ import annotations

from itertools import pairwise
from typing import NamedTuple


class Edit(NamedTuple):
    """``text[start:end]`` becomes ``to``; an empty range is an insertion.  Of conflicting edits the higher priority stays."""

    start: int
    end: int
    to: str
    priority: int = 0


def edit(text: str, start: int, end: int, to: str, priority: int = 0) -> Edit:
    """An edit of a text; a range that isn't in it raises."""
    if not 0 <= start <= end <= len(text):
        raise ValueError(f"no range of the text: {start}..{end}")
    return Edit(start, end, to, priority)


def conflict(a: Edit, b: Edit) -> bool:
    """Ranges that share a character, insertions at one place, and an insertion strictly within a range."""
    if a.start == a.end and b.start == b.end:
        return a.start == b.start
    return max(a.start, b.start) < min(a.end, b.end) or any(y.start < x.start == x.end < y.end for x, y in ((a, b), (b, a)))


def arbitrate(edits: list[Edit]) -> list[Edit]:
    """Edits without conflicts, by place: of higher priority first, then those that start earlier, then the longer."""
    kept: list[Edit] = []
    for e in sorted(edits, key=lambda e: (-e.priority, e.start, e.start - e.end)):
        if not any(conflict(e, k) for k in kept):
            kept.append(e)
    return sorted(kept, key=lambda e: e[:2])


def apply(text: str, edits: list[Edit]) -> str:
    """The edited text; ranges are those of the text as it is.  Edits that conflict, or aren't in the text, raise."""
    ordered = sorted((edit(text, *e) for e in edits), key=lambda e: e[:2])
    if any(conflict(a, b) for a, b in pairwise(ordered)):
        raise ValueError("edits overlap: arbitrate them first")
    out, at = [], 0
    for e in ordered:
        out += [text[at : e.start], e.to]
        at = e.end
    return "".join([*out, text[at:]])
