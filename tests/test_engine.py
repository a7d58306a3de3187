"""Rules, spans and the protected pipeline, on inputs and expectations written for these tests."""

import random

import pytest

from inkstone import cli
from inkstone.functions import pipeline, registry, rules, spans
from inkstone.functions.pipeline import format_text
from inkstone.functions.registry import Replacement, Request

KINDS_BY_TEXT = [
    ("---\na: b\n---\n正文", [("front_matter", "---\na: b\n---")]),
    ("﻿---\nk\n--- \n好", [("front_matter", "﻿---\nk\n--- ")]),
    ("---\n没有结束", []),
    ("```py\nx,y\n```\n好", [("fenced_code", "```py\nx,y\n```")]),
    ("~~~~\na\n~~~\n~~~~~ \n好", [("fenced_code", "~~~~\na\n~~~\n~~~~~ ")]),
    ("```\n没有结束", [("inline_code", "```")]),
    ("甲<!-- 注\n释 -->乙<!-- 开", [("html_comment", "<!-- 注\n释 -->")]),
    ("[a]: https://b.c/d e", [("reference_definition", "[a]: https://b.c/d e")]),
    ("甲\n    码\n\t码\n乙", [("indented_code", "    码\n\t码")]),
    ("|a|b|\n|---|:---:|\n|1|2|", [("table_separator", "|---|:---:|")]),
    ("用`a`和``b`c``及`没", [("inline_code", "`a`"), ("inline_code", "``b`c``"), ("inline_code", "`")]),
    ("看[甲[乙]丙](d(e)f)与![图](g)和[h][i]", [("markdown_link", "[甲[乙]丙](d(e)f)"), ("markdown_link", "![图](g)"), ("markdown_link", "[h][i]")]),
    ("[甲 [乙](丙)]", []),
    (r"[a\]b](c\)d)", [("markdown_link", r"[a\]b](c\)d)")]),
    ("见HTTPS://a.cn/b,c，写a.b@c.de", [("url", "HTTPS://a.cn/b,c"), ("email", "a.b@c.de")]),
    ("<div>\n甲\n</DIV> 乙\n丙", [("html_block", "<div>\n甲\n</DIV> 乙")]),
    ("用<b class='>'>粗</b>和<br/>", [("inline_html", "<b class='>'>粗</b>"), ("inline_html", "<br/>")]),
    ("a < b 与<i>斜</i>", [("inline_html", "<i>斜</i>")]),
    ("甲  \n乙\\\n丙", [("hard_break", "  "), ("hard_break", "\\")]),
    (r"式\(a\)和\[b\n]", [("latex_math", r"\(a\)"), ("latex_math", r"\[")]),
    (r"\frac[x]{a{b}}{c}与\name", [("latex_math", r"\frac[x]{a{b}}{c}")]),
    (r"$x$和$$a" + "\n" + r"b$$及\$5", [("latex_math", "$x$"), ("latex_math", "$$a\nb$$")]),
    ("水H₂O与[Fe(CN)₆]³⁻，普通ABC", [("chemical_formula", "H₂O"), ("chemical_formula", "[Fe(CN)₆]³⁻")]),
    ("重5kg，热4℃，浓3mg·mL⁻¹，x1.5m，10chapter", [("measurement", "5kg"), ("temperature", "4℃"), ("scientific_unit", "3mg·mL⁻¹")]),
    ("∂x/∂y和a≤b与1±2", [("math_expression", "∂x/∂y"), ("math_expression", "a≤b"), ("math_expression", "1±2")]),
]


@pytest.mark.parametrize(("text", "want"), KINDS_BY_TEXT)
def test_scanners(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in spans.all_spans(text)] == want


@pytest.mark.parametrize("rule", registry.RULES, ids=lambda r: r.key)
def test_rule_examples(rule):
    assert format_text(rule.before, Request((rule.key,))) == rule.after
    assert format_text(rule.after, Request((rule.key,))) == rule.after


CASES = [
    ("defaults", "在`code`中用它,见https://a.cn/x,y后。", "在 `code` 中用它，见 https://a.cn/x,y后。"),
    ("defaults", "式$x$和\\(a,b\\)是", "式 $x$ 和 \\(a,b\\) 是"),
    ("defaults", "H₂O是水，2×3cm²大", "H₂O 是水， 2×3cm² 大"),
    ("defaults", "```\n甲,乙\n```\n丙,丁", "```\n甲,乙\n```\n丙，丁"),
    ("defaults", "甲,乙\r\n丙,丁", "甲，乙\r\n丙，丁"),
    ("defaults", "甲,乙\r丙", "甲，乙\r丙"),
    ("defaults", "𠀀abc和é中", "𠀀 abc 和 é 中"),
    ("defaults", "👩‍👩‍👧家abc", "👩‍👩‍👧家 abc"),
    ("none", "中`a`文", "中 `a` 文"),
    ("none", "中a文,好", "中a文,好"),
    (("spacing.cjk-latin", "nope"), "中a文", "中 a 文"),
    (("spacing.cjk-latin",), "中*t*<1", "中 *t* <1"),
    (("spacing.around-links",), "字  \n看https://a.cn吧", "字  \n看 https://a.cn吧"),
    (("spacing.numeric-punctuation",), "1 / 2 / 3与10 / 20 / 30", "1/2 / 3与10/20/30"),
    (("spacing.numeric-punctuation",), "5 / 1.2.3", "5 / 1.2.3"),
    (("naming.expand-abbreviations",), "ts ts", "TypeScript ts"),
    (("naming.proper-nouns",), "axios iOS ios WI-FI", "axios iOS iOS Wi-Fi"),
    (("cleanup.limit-blank-lines",), "甲\n\n\n```\n\n\n```\n\n\n", "甲\n\n```\n\n\n```\n\n"),
    (("cleanup.kangxi-radicals",), "".join(map(chr, range(0x2F00, 0x2F05))), "一丨丶丿乙"),
]


@pytest.mark.parametrize(("selection", "text", "want"), CASES)
def test_pipeline(selection, text, want):
    assert format_text(text, Request(selection)) == want


def test_replacements_are_ordered_and_respect_protection():
    pairs = (Replacement("甲", "乙"), Replacement("乙", "丙", active=False), Replacement("", "x"), Replacement("乙", "丁"))
    assert format_text("甲`甲`[甲](甲)", Request("none", pairs)) == "丁 `甲` [甲](甲)"


def test_conversion_is_longest_match_outside_protection():
    words = {"汉": "漢", "汉语": "漢語"}
    assert pipeline.convert("汉语`汉`汉", words) == "漢語`汉`漢"
    assert format_text("汉", Request("none", conversion="s2t")) == "汉"


def test_limits():
    assert format_text("a" * registry.MAX_TEXT_BYTES, Request("none"))
    with pytest.raises(registry.RequestError) as e:
        format_text("a" * (registry.MAX_TEXT_BYTES + 1), Request("none"))
    assert e.value.code == "input_too_large"
    Request(("x",) * registry.MAX_KEYS).check()
    for bad, code in ((Request(("x",) * (registry.MAX_KEYS + 1)), "too_many_rules"), (Request(replacements=(Replacement("a", "b"),) * 201), "too_many_replacements"), (Request(replacements=(Replacement("a" * 16385, ""),)), "replacement_too_large"), (Request(conversion="x"), "unknown_conversion")):
        with pytest.raises(registry.RequestError) as e:
            bad.check()
        assert e.value.code == code


def test_order_and_selections():
    phases = [registry.BY_KEY[k].phase for k in registry.ORDER]
    assert phases == sorted(phases) and len(registry.ORDER) == 21 and len(registry.DEFAULTS) == 9
    a = registry.Rule("a", 0, "", "", "", False, "", "", run_after=("b",))
    b = registry.Rule("b", 1, "", "", "", False, "", "", run_after=("a",))
    for broken in ([a, b], [a], [b, b]):
        with pytest.raises(ValueError):
            registry.execution_order(broken)
    assert registry.canonical(registry.DEFAULTS) == "defaults" and registry.canonical([]) == "none" and registry.canonical(registry.ORDER) == "all"
    assert registry.normalize_keys(["限制连续空行", "?", "cleanup.limit-blank-lines"]) == ["cleanup.limit-blank-lines"]
    assert registry.adjust("none", ["spacing.cjk-latin"], ["spacing.cjk-latin"]) == ["spacing.cjk-latin"]


POOL = ["中文，好", "Latin text", "30", "5kg", "👩‍👩‍👧", "é", "# 题", "`a,b`", "```\nx\n```", "[l](https://a.cn)", "<https://b.cn>", "x@y.zz", "|a|b|\n|---|---|", "$x$", "\\(y\\)", "\\frac{a}{b}", "H₂O", "Fe²⁺", "`open", "[open", "**粗**", "!!", "“引”", "github", "\ue000"]


@pytest.mark.parametrize("seed", range(8))
def test_properties(seed):
    rng = random.Random(seed)
    for selection in ("defaults", "none", ("spacing.cjk-latin", "spacing.cjk-number"), registry.PRESETS["pdf-cleaning"].selection):
        for newline in ("\n", "\r\n", "\r"):
            text = "".join(rng.choice(POOL) + rng.choice(["\n", " ", "\n\n"]) for _ in range(12)).replace("\n", newline)
            out = format_text(text, Request(selection))
            assert format_text(out, Request(selection)) == out
            assert out.count("👩‍👩‍👧") == text.count("👩‍👩‍👧") and out.count("[l](https://a.cn)") == text.count("[l](https://a.cn)")
            if newline != "\n" and newline in out:
                assert "\n" not in out.replace(newline, "")


def test_many_spans_take_linear_time():
    text = "用`a`，" * 20_000
    assert format_text(text, Request("all")).count("`a`") == 20_000


def test_native_rules_agree_with_python(spark):
    from pyspark.sql import functions as F

    from inkstone.operators.text import native_rule

    rng = random.Random(5)
    parts = ["中", "文", "a", "Z", "1", "２", " ", "  ", "，", ",", "!", "！！", "？", "(", ")", "“", "”", '"', "[1]", "【2】", "⼀", "ts", "github", "℃", "%", "5kg", " . ", "/", "·", "²", "é", "*b*", "≤", "Å", "Ａ", "：", "\n", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keys = [k for k in registry.ORDER if k not in ("cleanup.limit-blank-lines", "spacing.around-links", "spacing.number-unit")]
    got = df.select("t", *[native_rule(k, F.col("t")).alias(k.replace(".", "_")) for k in keys]).collect()
    for row in got:
        for k in keys:
            assert row[k.replace(".", "_")] == "\n".join(rules.apply_rule(k, line) for line in row.t.split("\n")), (k, row.t)


def test_tables_and_sql(spark):
    from pyspark.sql import functions as F

    from inkstone.operators import text as ops

    ops.register(spark)
    assert spark.sql("SELECT ink_format('用Spark算') AS x").first().x == "用 Spark 算"
    assert spark.sql("SELECT ink_spans('a`b`')[0].kind AS k").first().k == "inline_code"
    df = spark.createDataFrame([(1, "用Spark算", 2), (2, None, 3), (3, "", 4)], "id long, text string, _text int")
    assert [r.x for r in df.select("id", ops.format_column(F.col("text")).alias("x")).orderBy("id").collect()] == ["用 Spark 算", None, ""]
    assert ops.span_table(df, "text", "id").collect() == []
    assert ops.rules_table(spark).count() == 21 and ops.presets_table(spark).count() == 3


def test_stream_is_the_batch(spark, tmp_path):
    from inkstone.streaming.formatting import run_available

    spark.createDataFrame([(i, f"用Spark{i}算") for i in range(20)], "id long, text string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        run_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", "text", "defaults")
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(f"用 Spark{i} 算" for i in range(20))


def test_files_and_settings(spark, tmp_path):
    from inkstone.sources import files

    (tmp_path / "a.txt").write_bytes("甲\r\n乙".encode())
    assert files.read_texts(spark, f"{tmp_path}/a.txt").first().text == "甲\r\n乙"
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "s.json").write_text('{"enabled": ["限制连续空行"], "replacements": [{"from": "a", "to": "b"}]}')
    got = files.load_settings(spark, f"{tmp_path}/none.json", f"{tmp_path}/bad.json", f"{tmp_path}/s.json")
    assert got.request.selection == ("cleanup.limit-blank-lines",) and got.request.replacements[0].target == "b" and "bad.json" in got.notice
    assert files.load_settings(spark).request == Request()


def test_command_line(tmp_path, capsys):
    (tmp_path / "in").write_text("用Spark算,好", encoding="utf-8")
    assert cli.main(["--input", str(tmp_path / "in")]) == 0 and capsys.readouterr().out == "用 Spark 算，好\n"
    assert cli.main(["--input", str(tmp_path / "in"), "--rules", "none", "--enable", "spacing.cjk-latin,zzz", "--output", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out").read_text(encoding="utf-8") == "用 Spark 算,好" and "zzz" in capsys.readouterr().err
    assert cli.main(["--input", str(tmp_path / "absent")]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["--what"])
    assert e.value.code == 2


def test_edit_algebra():
    import itertools

    from inkstone.functions.edits import Edit, apply, arbitrate, conflict, edit

    text = "abcd"
    every = [edit(text, s, e, to, p) for s in range(5) for e in range(s, 5) for to, p in (("", 0), ("x", 1))]
    for a, b in itertools.product(every, every):
        shared = set(range(a.start, a.end)) & set(range(b.start, b.end))
        within = any(x.start == x.end and y.start < x.start < y.end for x, y in ((a, b), (b, a)))
        assert conflict(a, b) == conflict(b, a) == bool(shared or within or (a.start == a.end == b.start == b.end))
    kept = arbitrate([edit(text, 0, 2, "1"), edit(text, 1, 4, "2", 2), edit(text, 0, 1, "3"), edit(text, 4, 4, "!")])
    assert kept == [Edit(0, 1, "3", 0), Edit(1, 4, "2", 2), Edit(4, 4, "!", 0)]
    assert apply(text, kept) == "32!" and apply(text, []) == text
    assert apply("汉字", [edit("汉字", 1, 1, "-"), edit("汉字", 0, 1, "漢")]) == "漢-字"
    with pytest.raises(ValueError):
        apply(text, [edit(text, 0, 2, ""), edit(text, 1, 3, "")])
    for s, e in ((3, 2), (0, 5), (-1, 1)):
        with pytest.raises(ValueError):
            edit(text, s, e, "")


def test_scripts_of_graphemes():
    from inkstone.functions.chars import script_of

    assert [script_of(g) for g in ("汉", "汉́", "𠀀", "a", "é", "é", "9", "９", "。", "🎉", "́", "カ")] == ["han", "han", "han", "latin", "latin", "latin", "digit", "digit", "other", "other", "other", "other"]


def test_rules_change_nothing_without_what_they_need():
    """A rule's guard is no stricter than the rule."""
    from inkstone.functions import rules

    pool = "中文ab1２ ，。！?!.,:;()（）\"'“”‘’[3]【】µÅ℃℉%‰kg5⼀ts github<*x*>≈×"
    rng = __import__("random").Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))
        for key, steps in rules.REWRITES.items():
            if key not in ("spacing.number-unit", "spacing.around-links"):
                want = t
                for r in steps:
                    want = rules.rewrite(want, r)
                assert rules.apply_rule(key, t) == want, (key, t)
