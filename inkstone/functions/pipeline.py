"""The protected pipeline: one request applied to one text, and its parts.

A protected span is held as one private-use character that the text doesn't have, in order, so no token can clash with
the input and restoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import regex

from .chars import CLOSING_MARKS, SPACE, SPACE_CHARS, H
from .registry import BY_KEY, EDITABLE_PHASES, MAX_TEXT_BYTES, PROTECTED_PHASES, Request, RequestError
from .rules import apply_rule
from .spans import EMAIL, LINK, OPAQUE, URL, Span, all_spans, arbitrate, editable_spans, protected_spans

SUFFIX = regex.compile("[A-Za-z0-9²³⁰-⁹₀-₉⁻⁺]+")
AUTOLINK = rf"(?i:<(?:https?://[^>{SPACE}]+|{EMAIL})>)"
LINE_LINKS = [regex.compile(p) for p in (AUTOLINK, URL, EMAIL)]
SENTINELS = [chr(c) for c in (*range(0xE000, 0xF900), *range(0xF0000, 0xF0400))]


def split_newlines(text: str) -> tuple[str, str]:
    """The text with line feeds, and what its line ends were: the first of CR LF, CR and LF that it has."""
    for style in ("\r\n", "\r"):
        if style in text:
            return text.replace(style, "\n"), style
    return text, "\n"


def limit_blank_lines(text: str) -> str:
    """Of unprotected lines that follow each other and hold only white space, the first."""
    spans, out, at, after_blank, i = protected_spans(text), [], 0, False, 0
    for line in regex.findall(r"[^\n]*\n|[^\n]+", text):
        end = at + len(line)
        while i < len(spans) and spans[i].end <= at:
            i += 1
        blank = not line.strip(SPACE_CHARS) and not (i < len(spans) and spans[i].start < end)
        if not (blank and after_blank):
            out.append(line)
        after_blank, at = blank, end
    return "".join(out)


def replace_literal(text: str, source: str, target: str) -> str:
    """Leftmost occurrences, but for those that overlap a protected span."""
    if source not in text:
        return text
    spans, out, at, i = protected_spans(text), [], 0, 0
    while (start := text.find(source, at)) >= 0:
        end = start + len(source)
        while i < len(spans) and spans[i].end <= start:
            i += 1
        out += [text[at:start], source if i < len(spans) and spans[i].start < end else target]
        at = end
    return "".join([*out, text[at:]])


def convert(text: str, dictionary: Mapping[str, str]) -> str:
    """Longest matches of a dictionary from the left, outside protected spans; without one, the text as it is."""
    if not dictionary:
        return text
    longest = max(map(len, dictionary))

    def part(s: str) -> str:
        out, i = [], 0
        while i < len(s):
            n = next((n for n in range(min(longest, len(s) - i), 0, -1) if s[i : i + n] in dictionary), 0)
            out.append(dictionary[s[i : i + n]] if n else s[i])
            i += n or 1
        return "".join(out)

    return "".join(s if kept else part(s) for s, kept in _pieces(text, protected_spans(text)))


def _pieces(text: str, spans: list[Span]) -> Iterator[tuple[str, bool]]:
    """All of the text in order, as what is between spans and the spans themselves."""
    at = 0
    for s in spans:
        yield text[at : s.start], False
        yield text[s.start : s.end], True
        at = s.end
    yield text[at:], False


def edit_fragments(text: str, rules: list[str]) -> str:
    """Rules within fragments: parts of a line between protected spans."""
    if not rules:
        return text
    out = []
    for piece, kept in _pieces(text, editable_spans(text)):
        if kept or not piece:
            out.append(piece)
            continue
        lines = piece.split("\n")
        for i, line in enumerate(lines):
            for key in rules:
                line = apply_rule(key, line) if line else line
            lines[i] = line
        out.append("\n".join(lines))
    return "".join(out)


def protect(text: str) -> tuple[str, list[Span], str]:
    """The text with a sentinel for each span that is held back, those spans, and the sentinel."""
    spans = all_spans(text)
    held = [s for s in spans if s.priority == OPAQUE or s.kind == "chemical_formula"]
    for s in spans:  # an expression goes with a unit that follows at once, as in 2×3cm²
        if s.kind == "math_expression" and (m := SUFFIX.match(text, s.end)):
            held.append(Span(s.start, m.end(), s.kind, OPAQUE))
    held = arbitrate(held)
    mark = next((c for c in SENTINELS if c not in text), None)
    if mark is None:
        raise RequestError("no_sentinel", "the text uses every private-use character")
    return "".join(mark if kept else s for s, kept in _pieces(text, held)), held, mark


def around_links(line: str, mark: str = "", spaced: Mapping[int, bool] | None = None, first: int = 0) -> str:
    """A space on each side of links and addresses in a line, next to what isn't white space.

    mark: a sentinel that stands for a held span, and is spaced as well, but for hard breaks (``spaced`` is false then).
    """
    found, seen = [], first
    for m in LINK.finditer(line):
        if m["link"] is not None:
            found.append(m.span())
    for rx in LINE_LINKS:
        found += [m.span() for m in rx.finditer(line) if not any(s < m.end() and m.start() < e for s, e in found)]
    if mark:
        for i, c in enumerate(line):
            if c == mark:
                if spaced is None or spaced.get(seen, True):
                    found.append((i, i + 1))
                seen += 1
    cuts = set()
    for s, e in found:
        if s and line[s - 1] not in SPACE_CHARS:
            cuts.add(s)
        if e < len(line) and line[e] not in SPACE_CHARS:
            cuts.add(e)
    at, out = 0, []
    for c in sorted(cuts):
        out.append(line[at:c])
        at = c
    return " ".join([*out, line[at:]])


@cache
def _edges(mark: str) -> tuple[regex.Pattern, ...]:
    return (
        regex.compile(f"([^{SPACE}])({mark})"),
        regex.compile(f"({mark})([^{SPACE}{CLOSING_MARKS}])"),
        regex.compile(f"({H})({mark})"),
        regex.compile(f"({mark})({H})"),
    )


def space_spans(text: str, spans: list[Span], values: list[str], mark: str) -> str:
    """Spaces at the edges of held spans within a line: of formulas in LaTeX only against Han, of others against all."""
    inline = [s.kind != "latex_math" and "\n" not in v and not (len(v) == 2 and v[0] == "\\") and not (v == "\\" or len(v) >= 2 and not v.strip(" ")) for s, v in zip(spans, values, strict=True)]
    math = [s.kind == "latex_math" and "\n" not in v for s, v in zip(spans, values, strict=True)]
    for rx, wanted, group in zip(_edges(mark), (inline, inline, math, math), (2, 1, 2, 1), strict=True):
        if not any(wanted):
            continue
        places = {m.start(): i for i, m in enumerate(regex.finditer(mark, text))}
        text = rx.sub(lambda m, places=places, wanted=wanted, group=group: f"{m[1]} {m[2]}" if wanted[places[m.start(group)]] else m[0], text)
    return text


def edit_lines(text: str, rules: list[str], mark: str, values: list[str]) -> str:
    """Rules on whole lines in which spans are held; blank lines and lines that are one held span are left out."""
    hard = {i: not (v == "\\" or len(v) >= 2 and not v.strip(" ")) for i, v in enumerate(values)}
    for key in rules:
        lines, seen = text.split("\n"), 0
        for i, line in enumerate(lines):
            if line.strip(SPACE_CHARS) and line != mark:
                lines[i] = around_links(line, mark, hard, seen) if key == "spacing.around-links" else apply_rule(key, line)
            seen += line.count(mark)
        text = "\n".join(lines)
    return text


def format_text(text: str, request: Request = Request(), dictionary: Mapping[str, str] | None = None) -> str:
    """A request applied to a whole text."""
    if len(text) * 4 > MAX_TEXT_BYTES and len(text.encode("utf-8", "surrogatepass")) > MAX_TEXT_BYTES:
        raise RequestError("input_too_large", f"the text is longer than {MAX_TEXT_BYTES} bytes")
    rules = request.rules()
    text, newline = split_newlines(text)
    if "cleanup.limit-blank-lines" in rules:
        text = limit_blank_lines(text)
    for r in request.replacements:
        if r.active and r.source:
            text = replace_literal(text, r.source, r.target)
    if request.conversion != "none":
        text = convert(text, dictionary or {})
    text = edit_fragments(text, [k for k in rules if BY_KEY[k].phase in EDITABLE_PHASES and k != "cleanup.limit-blank-lines"])
    held, spans, mark = protect(text)
    values = [text[s.start : s.end] for s in spans]
    held = edit_lines(held, [k for k in rules if BY_KEY[k].phase in PROTECTED_PHASES], mark, values)
    held = space_spans(held, spans, values, mark)
    parts = held.split(mark)
    text = parts[0] + "".join(v + p for v, p in zip(values, parts[1:], strict=True))
    return text if newline == "\n" else text.replace("\n", newline)
