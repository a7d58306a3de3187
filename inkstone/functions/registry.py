"""The catalogue of rules, their order, selections, presets and requests."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

# Limits of a request, and the catalogue.
MAX_TEXT_BYTES, MAX_KEYS, MAX_REPLACEMENTS, MAX_REPLACEMENT_BYTES = 10 * 1024 * 1024, 500, 200, 16 * 1024
PHASES = ["cleanup", "punctuation", "naming", "structure", "boundary", "final"]


@dataclass(frozen=True)
class Rule:
    key: str
    phase: int
    name: str
    kind: str
    risk: str
    default: bool
    before: str  # an example, and what the rule alone makes of it
    after: str
    disputed: bool = False
    legacy: tuple[str, ...] = ()
    run_after: tuple[str, ...] = ()


def _rule(phase: str, key: str, name: str, kind: str, before: str, after: str, *, default=False, risk="contextual", disputed=False, legacy=None, run_after=()) -> Rule:
    return Rule(key, PHASES.index(phase), name, kind, risk, default, before, after, disputed, () if legacy is None else (legacy,), run_after)


RULES = [
    _rule("cleanup", "cleanup.reference-square", "Delete reference marks", "cleanup", "结论[1]成立", "结论成立", legacy="删除方括号引用角标"),
    _rule("cleanup", "cleanup.collapse-horizontal-spaces", "Collapse spaces", "cleanup", "甲  乙", "甲 乙", legacy="折叠连续空格"),
    _rule("cleanup", "cleanup.limit-blank-lines", "Limit blank lines", "cleanup", "上。\n\n\n下。", "上。\n\n下。", legacy="限制连续空行"),
    _rule("cleanup", "cleanup.kangxi-radicals", "Repair Kangxi radicals", "cleanup", "⼀⼁", "一丨", legacy="修复康熙部首"),
    _rule("cleanup", "cleanup.cjk-internal-space", "Delete spaces between Han", "cleanup", "中 文", "中文"),
    _rule("punctuation", "punctuation.no-repetition", "No repeated marks", "typography", "好！！", "好！", default=True, legacy="不重复使用标点符号"),
    _rule("punctuation", "punctuation.fullwidth-cjk", "Fullwidth marks among Han", "typography", "你好,再见!", "你好，再见！", default=True, legacy="使用全角中文标点", run_after=("punctuation.no-repetition",)),
    _rule("punctuation", "text.halfwidth-digits", "Halfwidth digits", "conversion", "１２３", "123", default=True, risk="safe", legacy="数字使用半角字符", run_after=("punctuation.fullwidth-cjk",)),
    _rule("punctuation", "text.halfwidth-ascii", "Halfwidth letters and marks", "conversion", "ＡＢ！", "AB!", run_after=("text.halfwidth-digits",)),
    _rule("punctuation", "text.ascii-punct-in-latin", "ASCII marks among Latin", "typography", "Yes，no", "Yes, no", default=True, legacy="遇到完整的英文整句_特殊名词_其内容使用半角标点", run_after=("text.halfwidth-ascii",)),
    _rule("structure", "text.unicode-equivalents", "Equivalent unit signs", "conversion", "3\u212b", "3\u00c5", run_after=("punctuation.corner-quotes",)),
    _rule("naming", "naming.proper-nouns", "Usual spelling of names", "typography", "用 github", "用 GitHub", legacy="专有名词使用正确的大小写"),
    _rule("naming", "naming.expand-abbreviations", "Expand abbreviations", "typography", "用 ts 写", "用 TypeScript 写", legacy="不要使用不地道的缩写", run_after=("naming.proper-nouns",)),
    _rule("structure", "spacing.around-links", "Space around links", "typography", "看[此](https://a.cn)吧", "看 [此](https://a.cn) 吧", disputed=True, legacy="链接之间增加空格"),
    _rule("structure", "punctuation.corner-quotes", "Corner quotes", "typography", "说“好”", "说「好」", disputed=True, legacy="简体中文使用直角引号", run_after=("spacing.around-links",)),
    _rule("boundary", "spacing.cjk-latin", "Space between Han and Latin", "typography", "用Spark算", "用 Spark 算", default=True, risk="safe", legacy="中英文之间需要增加空格"),
    _rule("boundary", "spacing.cjk-number", "Space between Han and numbers", "typography", "共30个", "共 30 个", default=True, risk="safe", legacy="中文与数字之间需要增加空格", run_after=("spacing.cjk-latin",)),
    _rule("boundary", "spacing.number-unit", "Space before units", "typography", "长5km", "长5 km", default=True, legacy="数字与单位之间需要增加空格", run_after=("spacing.cjk-number",)),
    _rule("boundary", "spacing.numeric-punctuation", "No spaces within numbers", "cleanup", "约1 . 5", "约1.5", legacy="修复数值标点异常空格", run_after=("spacing.number-unit",)),
    _rule("boundary", "spacing.temperature-cjk", "Space after degrees", "typography", "4℃时", "4℃ 时", default=True, run_after=("spacing.numeric-punctuation",)),
    _rule("final", "spacing.no-space-around-fw-punct", "No space around fullwidth marks", "typography", "好 ， 是", "好，是", default=True, risk="safe", legacy="全角标点与其他字符之间不加空格", run_after=("spacing.temperature-cjk",)),
]
BY_KEY = {r.key: r for r in RULES}
EDITABLE_PHASES, PROTECTED_PHASES = range(3), range(3, 6)


def execution_order(rules: list[Rule] = RULES) -> list[Rule]:
    """Topological order; ties by phase and then by place in the catalogue."""
    place = {r.key: (r.phase, i) for i, r in enumerate(rules)}
    if len(place) != len(rules):
        raise ValueError("a rule's key is repeated")
    open_, blocks = {}, {}
    for r in rules:
        if missing := [k for k in r.run_after if k not in place]:
            raise ValueError(f"{r.key} runs after the unknown {missing[0]}")
        open_[r.key] = len(r.run_after)
        for k in r.run_after:
            blocks.setdefault(k, []).append(r.key)
    ready = [(place[k], k) for k, n in open_.items() if not n]
    heapq.heapify(ready)
    by_key, out = {r.key: r for r in rules}, []
    while ready:
        _, k = heapq.heappop(ready)
        out.append(by_key[k])
        for b in blocks.get(k, ()):
            open_[b] -= 1
            if not open_[b]:
                heapq.heappush(ready, (place[b], b))
    if len(out) != len(rules):
        raise ValueError("rules depend on each other in a circle")
    return out


ORDER = [r.key for r in execution_order()]
DEFAULTS = [k for k in ORDER if BY_KEY[k].default]


def normalize_keys(keys: list[str]) -> list[str]:
    """Stable keys for old names; unknown ones go, and of equal ones the first stays."""
    alias = {a: r.key for r in RULES for a in r.legacy}
    return list(dict.fromkeys(k for x in keys if (k := x if x in BY_KEY else alias.get(x))))


def expand(selection: str | list[str]) -> list[str]:
    """Keys in order of execution of ``all``, ``defaults``, ``none`` or a list of stable keys; unknown ones are ignored."""
    if isinstance(selection, str):
        return {"all": ORDER, "defaults": DEFAULTS, "none": []}[selection]
    chosen = set(selection)
    return [k for k in ORDER if k in chosen]


def canonical(keys: list[str]) -> str | list[str]:
    """The shortest way to say a set of keys."""
    chosen = set(keys)
    for name in ("none", "all", "defaults"):
        if chosen == set(expand(name)):
            return name
    return sorted(chosen)


def adjust(base: str | list[str], enable: list[str] = (), disable: list[str] = ()) -> list[str]:
    """A selection without some rules and with others; enabling wins."""
    return expand([*(set(expand(base)) - set(disable)), *enable])


@dataclass(frozen=True)
class Replacement:
    source: str
    target: str
    active: bool = True


@dataclass(frozen=True)
class Request:
    selection: str | tuple[str, ...] = "defaults"
    replacements: tuple[Replacement, ...] = ()
    conversion: str = "none"

    def rules(self) -> list[str]:
        return expand(self.selection if isinstance(self.selection, str) else list(self.selection))

    def check(self) -> None:
        """Raises RequestError beyond a limit; limits themselves are allowed."""
        if not isinstance(self.selection, str) and len(self.selection) > MAX_KEYS:
            raise RequestError("too_many_rules", f"more than {MAX_KEYS} rules are selected")
        if len(self.replacements) > MAX_REPLACEMENTS:
            raise RequestError("too_many_replacements", f"more than {MAX_REPLACEMENTS} replacements")
        if any(len(x.encode()) > MAX_REPLACEMENT_BYTES for r in self.replacements for x in (r.source, r.target)):
            raise RequestError("replacement_too_large", f"a replacement is longer than {MAX_REPLACEMENT_BYTES} bytes")
        if self.conversion not in ("none", "t2s", "s2t"):
            raise RequestError("unknown_conversion", f"unknown conversion {self.conversion!r}")


class RequestError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


PRESETS = {
    "copywriting": Request("defaults"),
    "pdf-cleaning": Request(tuple(sorted({"cleanup.reference-square", "cleanup.collapse-horizontal-spaces", "cleanup.limit-blank-lines", *DEFAULTS}, key=ORDER.index))),
    "technical-docs": Request(tuple(sorted({"naming.proper-nouns", "naming.expand-abbreviations", *DEFAULTS}, key=ORDER.index))),
}
