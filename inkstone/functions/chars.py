"""Character classes, written out so that Java's and Python's regular expressions agree on them."""

from __future__ import annotations

# Ranges of code points and sets of marks.
HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
HAN_WIDE = HAN + "\U00020000-\U0002a6df"  # for neighbouring graphemes, Extension B counts too
LATIN_WIDE = "A-Za-z\u00c0-\u024f"
DIGITS = "0-9０-９"
SUPER = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾"
SUB = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
MIDDOTS = "·⋅"
FULLWIDTH_MARKS = "，。；：！？、（）《》【】「」『』…—"
CLOSING_MARKS = "，。；：！？、）】》」』"
CLOSING_QUOTES = "」』》’”）"
SPACE = "\\t-\\r\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space
NOT_NL_SPACE = "\\t\\x0b-\\r\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

H, W, S = f"[{HAN}]", f"[{HAN_WIDE}]", f"[{SPACE}]"
#: What may follow a base character within its grapheme.
MARKS = "[\\p{M}\u200d]*"
AN = "[A-Za-z0-9]"
NOT_AN_BEFORE, NOT_AN_AFTER = f"(?<!{AN})", f"(?!{AN})"
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
SPACE_CHARS = "".join(sorted(SPACES))


def kind_of(ch: str) -> str:
    """One of nine classes of a character."""
    o = ord(ch)
    if 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "cjk"
    if ch.isascii() and ch.isalpha():
        return "latin"
    if "0" <= ch <= "9" or "０" <= ch <= "９":
        return "digit"
    for name, members in (("superscript", SUPER), ("subscript", SUB), ("middot", MIDDOTS), ("fullwidth_punctuation", FULLWIDTH_MARKS)):
        if ch in members:
            return name
    return "whitespace" if ch in SPACES else "other"


def script_of(cluster: str) -> str:
    """han, latin, digit or other: that of a grapheme's first character that isn't a combining mark, a variation selector or
    a joiner."""
    base = next((c for c in cluster if not 0x300 <= ord(c) <= 0x36F and not 0xFE00 <= ord(c) <= 0xFE0F and c != "\u200d"), cluster[:1])
    if kind_of(base) == "cjk" or 0x20000 <= ord(base) <= 0x2A6DF:
        return "han"
    if kind_of(base) in ("latin", "digit"):
        return kind_of(base)
    return "latin" if "\u00c0" <= base <= "\u024f" else "other"
