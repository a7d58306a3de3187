"""Scanners for structure and meaning in a text, and the algebra of their spans.

Most scanners are one regular expression; balanced brackets are recursive patterns.  Offsets are code points.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import regex

from .chars import MIDDOTS, NOT_NL_SPACE, SPACE, SPACE_CHARS, SUB, SUPER
from .rules import TEMPERATURES, measurements

SEMANTIC, OPAQUE = 1, 2


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    priority: int


# Tags that open a block of HTML.
BLOCK_TAGS = "div section article aside header footer nav main table thead tbody tr ul ol li pre script style".split()

_B = f"[{NOT_NL_SPACE}]*"
_SQUARE = r"(?P<sq>\[(?:[^\[\]\\\n]|\\[\s\S]|(?&sq))*+\])"
_ROUND = r"(?P<ro>\((?:[^()\\\n]|\\[\s\S]|(?&ro))*+\))"
_CURLY = r"(?P<cu>\{(?:[^{}\\\n]|\\[\s\S]|(?&cu))*+\})"
URL = rf"(?i:https?://[^{SPACE}，。；：！？、（）《》【】「」“”‘’…—<>'\"]+)"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_ATOM = f"[A-Z][a-z]?(?:[0-9]+|[{SUB}]+)?"
_UNIT = rf"(?:{_ATOM}|\((?:{_ATOM})+\)(?:[0-9]+|[{SUB}]+)?)"
_CHARGE = f"(?:[{SUPER}]+|[0-9]*[+-])?"

FRONT_MATTER = regex.compile(rf"\A\ufeff?{_B}---{_B}\n(?:[^\n]*\n)*?{_B}---{_B}(?=\n|\Z)")
FENCE = regex.compile(rf"(?m)^[ \t]{{0,3}}(?P<run>(?P<c>[`~])(?P=c){{2,}}+)[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?P=run)(?P=c)*+{_B}$")
REFERENCE = regex.compile(rf"(?m)^[ \t]{{0,3}}\[(?:(?!\]:)[^\n])*\]:{_B}(?:<|https?://)[^\n]*$")
INDENTED = regex.compile(r"(?m)^(?:    |\t)[^\n]*(?:\n(?:    |\t)[^\n]*)*")
CODE = regex.compile(r"(?<!`)(`++)(?:[^\n]*?(?<!`)\1(?!`))?")
LINK = regex.compile(rf"(?P<link>!?{_SQUARE}{_ROUND})|(?P<ref>(?&sq)(?&sq))|(?&sq)")
ADDRESS = regex.compile(f"(?P<url>{URL})|{EMAIL}")
ONLY_URL = regex.compile(f"(?P<url>{URL})")
BLOCK = regex.compile(rf"(?mi)^[ \t]{{0,3}}<(?P<tag>{'|'.join(BLOCK_TAGS)})(?=[ \t\n\r\f>/])[\s\S]*?</(?P=tag)[^\n]*")
TAG = regex.compile(r"""<(?:[^>"'\n]++|"[^"]*"|'[^']*')*+>""")
TAG_HEAD = regex.compile(r"<(/?)([A-Za-z]+)(?=[>/ \t])")
BREAK = regex.compile(r"(?m)(?: {2,}|\\)$")
COMMAND = regex.compile(rf"\\[A-Za-z]++\*?(?:{_SQUARE})?+(?:{_CURLY})++")
DOLLAR = regex.compile(r"(?<!\\)(?:\\\\)*+\K\$")
FORMULA = regex.compile(rf"(?:{_UNIT}|\[{_UNIT}+\])+{_CHARGE}(?:[{MIDDOTS}][0-9]*(?:{_UNIT})+{_CHARGE})*")
FEATURE = regex.compile(f"[{SUPER}{SUB}{MIDDOTS}]")
SCIENTIFIC = regex.compile(f"[{MIDDOTS}⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉⁺⁻]")
MATH = [regex.compile(p) for p in (r"∂[A-Za-z]+/[∂A-Za-z]+", "(?<![A-Za-z0-9])[A-Za-z0-9]++(?:≤|≥|≈)[A-Za-z0-9]+", r"(?<!\p{Nd})\p{Nd}+(?:\.\p{Nd}+)?(?:±|×)\p{Nd}+(?:\.\p{Nd}+)?")]


def _an(c: str) -> bool:
    return bool(c) and c.isascii() and c.isalnum()


def _table_rows(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for line in text.split("\n"):
        if "|" in line:
            cells = [c for x in line.split("|") if (c := x.strip(SPACE_CHARS))]
            if len(cells) >= 2 and all(regex.fullmatch(":?-{3,}:?", c) for c in cells):
                yield at, at + len(line)
        at += len(line) + 1


def _comments(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("<!--")
    while at >= 0 and (end := text.find("-->", at + 4)) >= 0:
        yield at, end + 3
        at = text.find("<!--", end + 3)


def _inline_html(text: str) -> Iterator[tuple[int, int]]:
    """Tags, with all up to their closing tag where there is one.  A tag that doesn't end stops the scan."""
    unclosed: set[str] = set()  # names that no closing tag follows any more
    at = text.find("<")
    while at >= 0 and (tag := TAG.match(text, at)):
        head, end = TAG_HEAD.match(text, at, tag.end()), tag.end()
        if not head:
            at = text.find("<", at + 1)
            continue
        name = head[2].lower()
        if not head[1] and not tag[0][1:-1].rstrip(" \t\n\r\f").endswith("/") and name not in unclosed:
            closing = regex.compile(rf"(?i)</{name}(?=[> \t])").search(text, end)
            if closing is None:
                unclosed.add(name)
            elif last := TAG.match(text, closing.start()):
                end = last.end()
        yield at, end
        at = text.find("<", end)


def _delimited(text: str) -> Iterator[tuple[int, int]]:
    for opening, closing in ((r"\(", r"\)"), (r"\[", r"\]")):
        at = text.find(opening)
        while at >= 0:
            if (end := text.find(closing, at + 2)) < 0:
                yield at, at + 2
                break
            yield at, end + 2
            at = text.find(opening, end + 2)


def _dollars(text: str) -> Iterator[tuple[int, int]]:
    marks = [m.start() for m in DOLLAR.finditer(text)]
    i = 0
    while i < len(marks):
        start = marks[i]
        display = text.startswith("$$", start)
        if not display and (start + 1 >= len(text) or text[start + 1] in " \t\n\r\f"):
            i += 1
            continue
        first, stop = start + 1 + display, len(text) if display else text.find("\n", start) % (len(text) + 1)
        end = 0
        for m in marks[bisect_right(marks, first - 1) :]:
            if m >= stop:
                break
            if text.startswith("$", m + 1) == display:
                end = m + 1 + display
                break
        if end:
            yield start, end
        i = bisect_right(marks, (end or first) - 1)


def _links(text: str) -> Iterator[tuple[int, int]]:
    for m in LINK.finditer(text) if "[" in text else ():
        if m["link"] is not None or m["ref"] is not None:
            yield m.span()


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" not in text and "://" not in text:
        return
    for m in (ADDRESS if "@" in text else ONLY_URL).finditer(text):
        yield ("url" if m["url"] is not None else "email"), *m.span()


def address_spans(text: str) -> list[Span]:
    """URLs and email addresses wherever they stand."""
    return [Span(s, e, kind, OPAQUE) for kind, s, e in _addresses(text)]


def structure_spans(text: str) -> list[Span]:
    """Markdown, HTML, LaTeX and addresses, arbitrated; the last few texts are remembered, as stages ask again."""
    return list(_structure_spans(text))


@lru_cache(maxsize=4)
def _structure_spans(text: str) -> list[Span]:
    found: list[tuple[str, int, int]] = []

    def every(kind: str, rx: regex.Pattern) -> None:
        found.extend((kind, *m.span()) for m in rx.finditer(text))

    if m := FRONT_MATTER.match(text):
        found.append(("front_matter", *m.span()))
    if "```" in text or "~~~" in text:
        every("fenced_code", FENCE)
    if "    " in text or "\t" in text:
        every("indented_code", INDENTED)
    if "  " in text or "\\" in text:
        every("hard_break", BREAK)
    if "]:" in text:
        every("reference_definition", REFERENCE)
    if "`" in text:
        every("inline_code", CODE)
    if "<" in text:
        found += [("html_comment", *x) for x in _comments(text)]
        every("html_block", BLOCK)
        found += [("inline_html", *x) for x in _inline_html(text)]
    if "\\" in text:
        found += [("latex_math", *x) for x in _delimited(text)]
        every("latex_math", COMMAND)
    if "$" in text:
        found += [("latex_math", *x) for x in _dollars(text)]
    if "|" in text:
        found += [("table_separator", *x) for x in _table_rows(text)]
    found += [("markdown_link", *x) for x in _links(text)]
    found += _addresses(text)
    return arbitrate([Span(s, e, kind, OPAQUE) for kind, s, e in found if e > s])


def chemical_formulas(text: str) -> list[tuple[int, int]]:
    if not FEATURE.search(text):
        return []
    return [m.span() for m in FORMULA.finditer(text) if FEATURE.search(m[0]) and not _an(text[m.start() - 1 : m.start()]) and not _an(text[m.end() : m.end() + 1])]


def math_expressions(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for s, e in sorted({m.span() for rx in MATH for m in rx.finditer(text)}, key=lambda x: x[0]):
        if s >= free:
            out.append((s, e))
            free = e
    return out


# Units that are written with different code points, and one name for each.
UNIT_KEYS = {"μm": "um", "\u00b5m": "um", "\u00c5": "angstrom", "\u212b": "angstrom"}


def unit_key(unit: str) -> str:
    """A unit's name whatever its code points; it never changes a text."""
    return UNIT_KEYS.get(unit, "unit")


def semantic_spans(text: str) -> list[Span]:
    """Formulas, measurements and expressions, arbitrated."""
    found = [("chemical_formula", *x) for x in chemical_formulas(text)]
    for m in measurements(text):
        found.append(("temperature" if m[3] in TEMPERATURES else "scientific_unit" if SCIENTIFIC.search(m[3]) else "measurement", *m.span()))
    found += [("math_expression", *x) for x in math_expressions(text)]
    return arbitrate([Span(s, e, kind, SEMANTIC) for kind, s, e in found])


def all_spans(text: str) -> list[Span]:
    return arbitrate(semantic_spans(text) + structure_spans(text))


def protected_spans(text: str) -> list[Span]:
    """What rules, replacements and conversion must not change: structure and formulas."""
    return [s for s in all_spans(text) if s.priority == OPAQUE or s.kind == "chemical_formula"]


def editable_spans(text: str) -> list[Span]:
    """The protection that rules within a line work around; measurements and expressions stay editable."""
    return arbitrate([Span(s, e, "chemical_formula", SEMANTIC) for s, e in chemical_formulas(text)] + structure_spans(text))


def arbitrate(spans: list[Span]) -> list[Span]:
    """Spans that don't overlap: of higher priority first, then those that start earlier, then the longer."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s.priority, s.start, s.start - s.end)):
        i = bisect_right(kept, s.start, key=lambda k: k.start)
        if (i == 0 or kept[i - 1].end <= s.start) and (i == len(kept) or s.end <= kept[i].start):
            insort(kept, s)
    return kept
