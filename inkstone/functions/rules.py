"""The rules as data: each is a short list of rewrites that a Column or a Python string can be put through.

A rewrite is a regular expression in the part of the syntax that Java and the ``regex`` module share, with its replacement
in Java's form, or a translation of single characters.  So a rule has one definition, and two ways to run: as native
Catalyst expressions, and inside the protected pipeline.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import AN, CLOSING_QUOTES, DIGITS, FULLWIDTH_MARKS, HAN, LATIN_WIDE, MARKS, MIDDOTS, NOT_AN_AFTER, NOT_AN_BEFORE, SPACE, SUB, SUPER, H, S, W

SUPERSUB = f"[{SUPER}{SUB}]+"

# Names in their usual spelling, abbreviations with what they stand for, and units.
PROPER_NOUNS = (
    "GitHub Foursquare Microsoft Google Facebook Twitter YouTube LinkedIn Instagram Wikipedia WeChat JavaScript TypeScript HTML5 CSS3 JSON "
    "HTTP HTTPS API SQL PHP iOS iPadOS Android iPhone iPad iMac Mac macOS Windows Linux Bluetooth Wi-Fi npm React Vue MongoDB Corporation Inc"
).split()
PROPER_NOUN_FORMS = {x.lower(): x for x in PROPER_NOUNS} | {"wifi": "Wi-Fi", "nextjs": "Next.js"}
ABBREVIATIONS = {"ts": "TypeScript", "h5": "HTML5", "rjs": "React", "nextjs": "Next.js", "fed": "前端开发者"}
RATIO_UNIT = "(?:mg|kg|mol|mL|m|g|s|L|Pa|Hz|N|J|W|V|A|rad|rpm|px|eV|mmHg)"
UNITS = (
    f"(?:mg|kg|mol){S}*[{MIDDOTS}]{S}*[A-Za-z]+{SUPERSUB}",
    f"{RATIO_UNIT}{S}*[/／]{S}*{RATIO_UNIT}(?:{SUPERSUB})?",
    "mmHg|hPa|dB|rpm|Hz|Pa|mol|rad|px|eV|TB|GB|bps|kbps|Mbps|Gbps|Tbps|KiB|MiB|GiB|TiB|kΩ|MΩ|GΩ|Ω|cm|cL",
    "mmol|μmol|\u00b5mol|nmol|pmol|mM|μM|\u00b5M|mAh|kWh",
    "[kMGTmμ\u00b5np]?(?:m|g|s|L|K|Pa|Hz|N|J|W|V|A|B)",
    "\u00c5|\u212b|℃|℉|°C|°F|‰|%",
)
TEMPERATURES = ("℃", "℉", "°C", "°F")
UNIT = "(?:" + "|".join(UNITS) + ")"
MEASUREMENT = rf"(\p{{Nd}}+(?:\.\p{{Nd}}+)?)({S}*)({UNIT})"


@dataclass(frozen=True)
class Rewrite:
    """A substitution; ``guard``: only if the whole input has a match of it."""

    pattern: str
    to: str
    guard: str | None = None


@dataclass(frozen=True)
class Translate:
    """Single characters for single characters."""

    source: str
    target: str


def any_case(word: str) -> str:
    """A pattern for a word in any ASCII case, without a flag whose meaning differs between dialects."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else regex.escape(c) for c in word)


def between(left: str, mark: str, right: str) -> str:
    return f"(?<={left}){mark}(?={right})"


def _quotes(opening: str, closing: str, to: str) -> Rewrite:
    body = f"[^{closing}\\n]"
    return Rewrite(f"{opening}({body}*?{H}{body}*?){closing}", to)


STRAIGHT_QUOTES = (_quotes('"', '"', "「$1」"), _quotes("'", "'", "『$1』"))
NUMBER_CHAIN = r"[0-9]+(?:[ \t]*\.[ \t]*[0-9]+){2,}"
_kangxi = "".join(map(chr, range(0x2F00, 0x2FD6)))
_fullwidth = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if not 0xFF10 <= c <= 0xFF19)
_superscript_unit = f"[A-Za-z]{AN}*(?:[{MIDDOTS}]{AN}+)*[{SUPER}]+"
_emphasis = r"\*[A-Za-z]+\*"


def _spaced(a: str, b: str) -> tuple[Rewrite, Rewrite]:
    """A space between what matches a and b, in either order; both are consumed."""
    return Rewrite(f"({a})({b})", "$1 $2"), Rewrite(f"({b})({a})", "$1 $2")


def _neighbours(a: str, b: str) -> tuple[Rewrite, Rewrite]:
    """A space between neighbouring graphemes of two classes."""
    return Rewrite(f"([{a}]{MARKS})(?=[{b}])", "$1 "), Rewrite(f"([{b}]{MARKS})(?=[{a}])", "$1 ")


REWRITES: dict[str, tuple[Rewrite | Translate, ...]] = {
    "cleanup.reference-square": (
        Rewrite(rf"\[[0-9]+(?:{S}*[,\-–—]{S}*[0-9]+)*\]", ""),
        Rewrite(rf"【[0-9]+(?:{S}*[,，\-–—]{S}*[0-9]+)*】", ""),
    ),
    "cleanup.collapse-horizontal-spaces": (Rewrite(" {2,}", " "),),
    "cleanup.limit-blank-lines": (),  # works on lines; see limit_blank_lines()
    "cleanup.kangxi-radicals": (Translate(_kangxi, unicodedata.normalize("NFKC", _kangxi)),),
    "cleanup.cjk-internal-space": (Rewrite(f"({W}{MARKS}) (?={W})", "$1"),),
    "punctuation.no-repetition": (
        Rewrite(r"([！？!?~～])\1+", "$1"),
        Rewrite(r"([。，；：、])\1+", "$1"),
        Rewrite("[！？!?]{2,}", "？！"),
    ),
    "punctuation.fullwidth-cjk": tuple(
        Rewrite(r.pattern, r.to, guard=H)
        for r in (
            *(Rewrite(f"{NOT_AN_BEFORE}{a}{NOT_AN_AFTER}", b) for a, b in ((",", "，"), (";", "；"), (":", "："), (r"\.", "。"))),
            *(Rewrite(f"{a}{NOT_AN_AFTER}", b) for a, b in (("!", "！"), (r"\?", "？"), (r"\)", "）"))),
            Rewrite(rf"{NOT_AN_BEFORE}\(", "（"),
            *STRAIGHT_QUOTES,
        )
    ),
    "text.halfwidth-digits": (Translate("０１２３４５６７８９", "0123456789"),),
    "text.halfwidth-ascii": (Translate(_fullwidth, "".join(chr(ord(c) - 0xFEE0) for c in _fullwidth)),),
    "text.ascii-punct-in-latin": (
        *(Rewrite(between(AN, a, f"[A-Za-z0-9{CLOSING_QUOTES}]"), b) for a, b in (("。", "."), ("！", "!"), ("？", "?"))),
        *(Rewrite(between("[A-Za-z]", a, AN), b) for a, b in (("，", ", "), ("：", ": "), ("；", "; "), ("＆", " & "))),
        *(Rewrite(between(AN, a, AN), b) for a, b in (("（", "("), ("）", ")"))),
        Rewrite(" {2,}", " "),
    ),
    "naming.proper-nouns": tuple(Rewrite(f"{NOT_AN_BEFORE}{any_case(k)}{NOT_AN_AFTER}", v) for k, v in sorted(PROPER_NOUN_FORMS.items(), key=lambda x: (-len(x[0]), x[0]))),
    "naming.expand-abbreviations": (
        *(Rewrite(rf"(^|[^A-Za-z0-9]){any_case(k)}([^A-Za-z0-9]|(?![\s\S]))", f"$1{v}$2") for k, v in ABBREVIATIONS.items()),
        *(Rewrite(f"{S}+{v}", v) for v in ABBREVIATIONS.values() if regex.search(H, v)),
    ),
    "spacing.around-links": (Rewrite(rf"([^{SPACE}])(?=https?://)", "$1 "),),  # bare addresses only; see pipeline.around_links()
    "punctuation.corner-quotes": (*STRAIGHT_QUOTES, _quotes("“", "”", "「$1」"), _quotes("‘", "’", "『$1』")),
    "text.unicode-equivalents": (Translate("\u00b5\u212b", "\u03bc\u00c5"),),
    "spacing.cjk-latin": (*_neighbours(HAN + "\U00020000-\U0002a6df", LATIN_WIDE), *_spaced(f"[{HAN}<>=]", _emphasis), *_spaced(H, _superscript_unit)),
    "spacing.cjk-number": (*_neighbours(HAN + "\U00020000-\U0002a6df", DIGITS), *_spaced(H, "[∂±×≈≤≥]")),
    "spacing.number-unit": (
        # the exact form is number_unit(): a rejected candidate there uses up its text
        Rewrite(rf"{NOT_AN_BEFORE}(?<![0-9]\.)(?>(\p{{Nd}}+(?:\.\p{{Nd}}+)?)(?!{S}|[%‰℃℉]|°[CF])({UNIT})){NOT_AN_AFTER}", "$1 $2"),
        Rewrite(rf"(\p{{Nd}}){S}+([°%％‰])", "$1$2"),
        Rewrite(f"(‰)({H})", "$1 $2"),
    ),
    "spacing.numeric-punctuation": (Rewrite(rf"({NUMBER_CHAIN})|([0-9])[ \t]*([.,:/])[ \t]*(?!{NUMBER_CHAIN})([0-9])", "$1$2$3$4"),),
    "spacing.temperature-cjk": (Rewrite(f"([℃℉])({H})", "$1 $2"),),
    "spacing.no-space-around-fw-punct": (
        Rewrite(f"(?<!{S}){S}+([{FULLWIDTH_MARKS}])", "$1"),
        Rewrite(f"([{FULLWIDTH_MARKS}]){S}+", "$1"),
    ),
}


#: What a text must have at all for a rule to change it.
NEEDS = {
    "cleanup.reference-square": r"[\[【]",
    "cleanup.collapse-horizontal-spaces": "  ",
    "cleanup.kangxi-radicals": "[\u2f00-\u2fd5]",
    "cleanup.cjk-internal-space": " ",
    "punctuation.no-repetition": "[！？!?~～。，；：、]",
    "punctuation.fullwidth-cjk": "[,;:.!?()\"']",
    "text.halfwidth-digits": "[０-９]",
    "text.halfwidth-ascii": "[！-～]",
    "text.ascii-punct-in-latin": "[。！？，：；＆（）]|  ",
    "naming.proper-nouns": "[A-Za-z]",
    "naming.expand-abbreviations": "[A-Za-z]",
    "punctuation.corner-quotes": "[\"'“‘]",
    "text.unicode-equivalents": "[\u00b5\u212b]",
    "spacing.cjk-latin": f"[{HAN}\U00020000-\U0002a6df<>=]",
    "spacing.cjk-number": f"[{HAN}\U00020000-\U0002a6df]",
    "spacing.number-unit": r"[\p{Nd}‰]",
    "spacing.numeric-punctuation": "[0-9]",
    "spacing.temperature-cjk": "[℃℉]",
    "spacing.no-space-around-fw-punct": f"[{FULLWIDTH_MARKS}]",
}
#: Rules that look at no more than a word and its neighbours, so they need no division into lines.
LINE_FREE = {"naming.proper-nouns"}


@cache
def _needed(key: str) -> regex.Pattern:
    return regex.compile(NEEDS.get(key, ""))


@cache
def _names() -> regex.Pattern:
    """All names in one pass: longer ones first, as the rule's rewrites go."""
    return regex.compile(f"{NOT_AN_BEFORE}(?:{'|'.join(map(any_case, sorted(PROPER_NOUN_FORMS, key=lambda x: (-len(x), x))))}){NOT_AN_AFTER}")


@cache
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def number_unit(text: str) -> str:
    """A space between a number and its unit, but for temperatures and percents; then the marks that belong to numbers."""
    out, at = [], 0
    for m in measurements(text):
        out.append(text[at : m.end(1)])
        glued = m[3] in TEMPERATURES or m[3] in ("%", "‰") or m[2]
        out.append(f"{m[2]}{m[3]}" if glued else f" {m[3]}")
        at = m.end()
    text = "".join([*out, text[at:]])
    for r in REWRITES["spacing.number-unit"][1:]:
        text = rewrite(text, r)
    return text


def measurements(text: str) -> list[regex.Match]:
    """Matches of a number and a unit with no ASCII letter or digit on either side."""
    an = lambda c: c.isascii() and c.isalnum()
    return [m for m in _compiled(MEASUREMENT).finditer(text) if not an(text[m.start() - 1 : m.start()] or " ") and not an(text[m.end() : m.end() + 1] or " ")]


def rewrite(text: str, r: Rewrite | Translate) -> str:
    if isinstance(r, Translate):
        return text.translate(str.maketrans(r.source, r.target))
    if r.guard and not _compiled(r.guard).search(text):
        return text
    return _compiled(r.pattern).sub(_python_form(r.to), text)


@cache
def _python_form(to: str) -> str:
    return regex.sub(r"\$([0-9])", r"\\g<\1>", to.replace("\\", "\\\\"))


def apply_rule(key: str, text: str) -> str:
    """A rule on a fragment of one line; the two rules that need structure are in the pipeline."""
    if not _needed(key).search(text):
        return text
    if key == "spacing.number-unit":
        return number_unit(text)
    if key == "naming.proper-nouns":
        return _names().sub(lambda m: PROPER_NOUN_FORMS[m[0].lower()], text)
    for r in REWRITES[key]:
        text = rewrite(text, r)
    return text


def native_rule(key: str, col: Column) -> Column:
    """A rule on a whole string column without protection: built-in expressions only, line by line."""
    if key == "cleanup.limit-blank-lines":
        return limit_blank_lines(col)
    steps = REWRITES[key]
    if key in LINE_FREE:
        return _words_that_occur(col, list(zip(sorted(PROPER_NOUN_FORMS, key=lambda x: (-len(x), x)), steps, strict=True)))
    if all(isinstance(r, Translate) for r in steps):  # can't reach over a line end
        return _native(steps, col)
    return F.when(F.instr(col, "\n") == 0, _native(steps, col)).otherwise(F.array_join(F.transform(F.split(col, "\n", -1), lambda line: _native(steps, line)), "\n"))


def _words_that_occur(col: Column, steps: list[tuple[str, Rewrite]]) -> Column:
    """Rewrites of words, in order; a text goes through those whose word it has in some case, which a plain search tells."""
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(r.pattern).alias("pattern"), F.lit(r.to).alias("to")) for w, r in steps])
    found = F.transform(F.array(F.lower(col)), lambda low: F.filter(words, lambda w: F.contains(low, w["word"])))[0]
    return F.aggregate(found, col, lambda text, w: F.regexp_replace(text, w["pattern"], w["to"]))


def _native(steps: tuple[Rewrite | Translate, ...], col: Column) -> Column:
    out, guarded = col, []
    for r in steps:
        if isinstance(r, Translate):
            out = F.translate(out, r.source, r.target)
        else:
            out = F.regexp_replace(out, F.lit(r.pattern), F.lit(r.to))
            guarded.append(r.guard)
    guards = {g for g in guarded if g}
    return F.when(col.rlike(guards.pop()), out).otherwise(col) if guards else out


def limit_blank_lines(col: Column) -> Column:
    """Of lines that follow each other and hold only white space, the first."""
    lines = F.split(col, "\n", -1)
    blank = lambda line: line.rlike(f"^[{SPACE}]*$")
    # a line end at the very end of the text begins no line
    kept = F.filter(lines, lambda line, i: ~((i > 0) & blank(line) & blank(F.get(lines, i - 1)) & ~((i == F.size(lines) - 1) & (line == ""))))
    return F.array_join(kept, "\n")
