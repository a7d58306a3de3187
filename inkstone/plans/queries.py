"""Queries of the engine and SQL that DuckDB gives the same rows with.

A seed is a SQL expression over a table that both systems understand.  What each oracle expects of a rule is written by
hand: none is generated from the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.registry import Replacement, Request
from inkstone.operators import text as ops
from inkstone.streaming import formatting

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NAMES = ["documents", "part", "orders", "supplier", "nation", "pages", "region"]


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seeded(table: str, key: str, seed: str):
    return lambda spark, sf_dir: ops.spread(_load(spark, sf_dir, table).select(key, F.expr(seed).alias("seed")))


def _query(name: str, table: str, key: str, seed: str, make: Callable, expected: str) -> None:
    """make: the formatted column of ``seed``; expected: the same in SQL, with {s} for the seed."""
    rows = _seeded(table, key, seed)
    QUERIES[name] = lambda spark, sf_dir: rows(spark, sf_dir).select(key, make(F.col("seed")).alias("text"))
    ORACLES[name] = f"SELECT {key}, {expected.replace('{s}', seed)} AS text FROM {table}"


def _rule(key: str, table: str, id_: str, seed: str, expected: str) -> None:
    """One rule alone, native and through the pipeline, on the same seeds."""
    name = "rule_" + key.replace(".", "_").replace("-", "_")
    _query(name, table, id_, seed, lambda c: ops.native_format(c, [key]), expected)
    _query(f"{name}_pipeline", table, id_, seed, lambda c: ops.format_column(c, Request((key,))), expected)


def sub(x: str, *pairs: tuple[str, str]) -> str:
    """Nested global regexp_replace calls."""
    for a, b in pairs:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


HAN = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"
REPEATS = [(f"{m}{{2,}}", t) for m, t in (("！", "！"), ("？", "？"), ("!", "!"), ("\\?", "?"), ("~", "~"), ("～", "～"), ("。", "。"), ("，", "，"), ("；", "；"), ("：", "："), ("、", "、"))] + [("[！？!?]{2,}", "？！")]
PART, ORDER = ("part", "p_partkey"), ("orders", "o_orderkey")

_rule("cleanup.reference-square", *PART, "concat('数据', p_size, '来自[', p_size, ', 7]和【', p_size, '】等')", sub("{s}", ("\\[[0-9]+(?:\\s*[,\\-–—]\\s*[0-9]+)*\\]", ""), ("【[0-9]+(?:\\s*[,，\\-–—]\\s*[0-9]+)*】", "")))
_rule("cleanup.collapse-horizontal-spaces", *PART, "concat('型号  ', p_brand, '   尺寸 ', p_size)", sub("{s}", (" {2,}", " ")))
_rule("cleanup.limit-blank-lines", *ORDER, "concat('单', o_orderkey, chr(10), chr(10), ' ', chr(10), chr(10), o_orderpriority, chr(10), chr(10), '完')", "concat('单', o_orderkey, chr(10), chr(10), o_orderpriority, chr(10), chr(10), '完')")
_rule("cleanup.kangxi-radicals", *PART, "concat('⼀⼁', p_brand, '⼈⽔', p_size)", "translate({s}, '⼀⼁⼈⽔', '一丨人水')")
_rule("cleanup.cjk-internal-space", *PART, "concat('复 制 的', p_brand, ' 中 文 字', p_size, ' 个')", sub("{s}", *[(f"({HAN}) ({HAN})", "\\1\\2")] * 2))
_rule("punctuation.no-repetition", *ORDER, "concat('好！！', o_orderkey, '？！?', o_orderstatus, '。。。', o_orderpriority, '~~')", sub("{s}", *REPEATS))
_rule("punctuation.fullwidth-cjk", *PART, "concat('你好,世界;共', p_size, '个(含', p_brand, ')吗?用\"好的\"吧')", "concat('你好，世界；共', p_size, '个（含', p_brand, '）吗？用「好的」吧')")
_rule("text.halfwidth-digits", *PART, "concat('只卖１０', p_size, '元２')", "translate({s}, '０１２', '012')")
_rule("text.halfwidth-ascii", *PART, "concat('ＡＢ！（', p_brand, '）ｘ　９')", "translate({s}, 'ＡＢ！（）ｘ', 'AB!()x')")
_rule("text.ascii-punct-in-latin", *PART, "concat('Hello，', p_brand, '（', p_size, '）kg：ok  z！」完')", "concat('Hello, ', p_brand, '(', p_size, ')kg: ok z!」完')")
_rule("text.unicode-equivalents", *PART, "concat('直径', p_size, 'Å和', p_size, 'µm')", "concat('直径', p_size, 'Å和', p_size, 'μm')")
_rule("naming.proper-nouns", *PART, "concat('使用 github 与 ', p_brand, '、JAVASCRIPT，macs 和 wifi')", "concat('使用 GitHub 与 ', p_brand, '、JavaScript，macs 和 Wi-Fi')")
_rule("naming.expand-abbreviations", *PART, "concat('用 ts 写 ', p_size, ' 页 H5，找 fed 吧')", "concat('用 TypeScript 写 ', p_size, ' 页 HTML5，找前端开发者 吧')")
_rule("punctuation.corner-quotes", *PART, "concat('他说“好', p_size, '”和\"是\"与‘对’')", "concat('他说「好', p_size, '」和「是」与『对』')")
_rule("spacing.cjk-latin", *PART, "concat('在', p_brand, '上用 ', p_type, '吧')", "concat('在 ', p_brand, '上用 ', p_type, ' 吧')")
_rule("spacing.cjk-number", *PART, "concat('花了', p_size, '元≈', p_partkey)", "concat('花了 ', p_size, ' 元 ≈', p_partkey)")
_rule("spacing.number-unit", *PART, "concat('宽带有', p_size, 'Gbps，重', p_size, 'kg，占', p_size, ' %，温', p_size, '℃')", "concat('宽带有', p_size, ' Gbps，重', p_size, ' kg，占', p_size, '%，温', p_size, '℃')")
_rule("spacing.numeric-punctuation", *PART, "concat('约', p_size, ' . 5，版本1 . 2 . ', p_size)", "concat('约', p_size, '.5，版本1 . 2 . ', p_size)")
_rule("spacing.temperature-cjk", *PART, "concat(p_size, '℃保存，', p_size, '℉以下')", "concat(p_size, '℃ 保存，', p_size, '℉ 以下')")
_rule("spacing.no-space-around-fw-punct", *PART, "concat('你好 ， ', p_brand, ' ！  再见')", sub("{s}", ("\\s*([，！])\\s*", "\\1")))
_query("rule_spacing_around_links", *ORDER, "concat('看https://a.cn/', o_orderkey, ' 吧，[单', o_orderkey, '](b)好')", lambda c: ops.format_column(c, Request(("spacing.around-links",))), "concat('看 https://a.cn/', o_orderkey, ' 吧， [单', o_orderkey, '](b) 好')")

# whole texts as they are
_query("no_repetition_documents", "documents", "doc_id", "text", lambda c: ops.native_format(c, ["punctuation.no-repetition"]), sub("{s}", *REPEATS))
_query("collapse_spaces_documents", "documents", "doc_id", "text", lambda c: ops.native_format(c, ["cleanup.collapse-horizontal-spaces"]), sub("{s}", (" {2,}", " ")))
_query("proper_nouns_documents", "documents", "doc_id", "concat('mit github, ', text, ' und JAVASCRIPT-macs wi-fi')", lambda c: ops.native_format(c, ["naming.proper-nouns"]), "concat('mit GitHub, ', text, ' und JavaScript-macs Wi-Fi')")

# the whole request: protection, spacing at its edges, presets, replacements
_SHOP = "concat('在', s_name, '的`a,b`里花了', s_suppkey, '元,见https://a.cn/', s_suppkey, ' 好！！')"
_query("format_defaults", "supplier", "s_suppkey", _SHOP, lambda c: ops.format_column(c, "defaults"), "concat('在 ', s_name, ' 的 `a,b` 里花了 ', s_suppkey, ' 元，见 https://a.cn/', s_suppkey, ' 好！')")
_query("format_all", "supplier", "s_suppkey", "concat('在', s_name, '的`a,b`里用github,重', s_suppkey, 'kg[3]')", lambda c: ops.format_column(c, "all"), "concat('在 ', s_name, ' 的 `a,b` 里用 GitHub,重 ', s_suppkey, ' kg')")
_query("format_none", "supplier", "s_suppkey", _SHOP, lambda c: ops.format_column(c, "none"), "concat('在', s_name, '的 `a,b` 里花了', s_suppkey, '元,见 https://a.cn/', s_suppkey, ' 好！！')")
_query("preset_copywriting", *ORDER, "concat('订单', o_orderkey, '已发货,请查收!')", lambda c: ops.format_column(c, "copywriting"), "concat('订单 ', o_orderkey, ' 已发货，请查收！')")
_query("preset_pdf_cleaning", *ORDER, "concat('订单', o_orderkey, '见[12]', chr(10), chr(10), chr(10), '状态  好')", lambda c: ops.format_column(c, "pdf-cleaning"), "concat('订单 ', o_orderkey, ' 见', chr(10), chr(10), '状态 好')")
_query("preset_technical_docs", *ORDER, "concat('订单', o_orderkey, '用github与 ts 写')", lambda c: ops.format_column(c, "technical-docs"), "concat('订单 ', o_orderkey, ' 用 GitHub 与 TypeScript 写')")
_PAIRS = (Replacement("订单", "单据"), Replacement("", "x"), Replacement("状态", "z", False), Replacement("单据", "票据"))
_query("replacements", *ORDER, "concat('订单', o_orderkey, '状态`订单`')", lambda c: ops.format_column(c, Request("none", _PAIRS)), "concat('票据', o_orderkey, '状态 `订单`')")
_query("replacements_native", *ORDER, "concat('订单', o_orderkey, '状态')", lambda c: ops.native_replace(c, list(_PAIRS)), "concat('票据', o_orderkey, '状态')")
_query("conversion_with_dictionary", *ORDER, "concat('汉语', o_orderkey, '`汉`汉')", lambda c: ops.format_column(c, Request("none", conversion="s2t"), {"汉": "漢", "汉语": "漢語"}), "concat('漢語', o_orderkey, ' `汉` 漢')")
_query("newline_styles", *ORDER, "concat('单', o_orderkey, chr(13), chr(10), '好,的')", lambda c: ops.format_column(c, "defaults"), "concat('单 ', o_orderkey, chr(13), chr(10), '好，的')")
_query("protected_structures", *ORDER, "concat('式$x^', o_orderkey, '$和', chr(92), '(a,b', chr(92), ')与H₂O,[a,b](c)字<b>d,e</b>甲')", lambda c: ops.format_column(c, "defaults"), "concat('式 $x^', o_orderkey, '$ 和 ', chr(92), '(a,b', chr(92), ') 与 H₂O , [a,b](c) 字 <b>d,e</b> 甲')")
_query("graphemes", "nation", "n_nationkey", "concat(n_name, 'é👩‍👩‍👧好')", lambda c: F.size(ops.graphemes_column(c)).cast("long"), "length(n_name) + 3")
_query("chemical_formulas", *PART, "concat('水H₂O与', p_brand, '和Fe²⁺')", lambda c: F.array_join(ops.formulas_column(c), ","), "'H₂O,Fe²⁺'")
_query("text_statistics", "documents", "doc_id", "text", lambda c: F.concat_ws(",", F.length(c), F.octet_length(c)), "concat(length({s}), ',', strlen({s}))")
_query("try_format", *ORDER, "concat('单', o_orderkey)", lambda c: F.coalesce(ops.try_format_column(c, Request("none", conversion="x"))["error"], F.lit("")), "'unknown_conversion'")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _seeded("orders", "o_orderkey", "concat('见https://a.cn/', o_orderkey, '，`x`，写信a@b.cn，重5kg，热4℃，1±2，H₂O')")(spark, sf_dir)
    return ops.span_table(seeds, "seed", "o_orderkey").groupBy("kind", "priority").agg(F.count("*").alias("n"), F.min("value").alias("least"))


QUERIES["spans_by_kind"] = _spans
ORACLES["spans_by_kind"] = """
SELECT kind, CAST(priority AS INT) AS priority, n, CASE WHEN kind = 'url' THEN u ELSE least END AS least
FROM (VALUES ('url', 2, ''), ('inline_code', 2, '`x`'), ('email', 2, 'a@b.cn'), ('measurement', 1, '5kg'), ('temperature', 1, '4℃'),
             ('math_expression', 1, '1±2'), ('chemical_formula', 1, 'H₂O')) AS k(kind, priority, least),
     (SELECT count(*) AS n, min(concat('https://a.cn/', o_orderkey)) AS u FROM orders)
"""
# kind of span, text, and the span in it
STRUCTURES = [
    ("front_matter", "concat('---', chr(10), 'title: ', n_name, chr(10), '---', chr(10), '正文')", "concat('---', chr(10), 'title: ', n_name, chr(10), '---')"),
    ("fenced_code", "concat('前', chr(10), '```py', chr(10), n_name, ',', chr(10), '```', chr(10), '后')", "concat('```py', chr(10), n_name, ',', chr(10), '```')"),
    ("html_comment", "concat('甲<!-- ', n_name, ' -->乙')", "concat('<!-- ', n_name, ' -->')"),
    ("reference_definition", "concat('见', chr(10), '[', n_name, ']: https://a.cn/x', chr(10), '后')", "concat('[', n_name, ']: https://a.cn/x')"),
    ("indented_code", "concat('前', chr(10), '    ', n_name, chr(10), '后')", "concat('    ', n_name)"),
    ("table_separator", "concat('|a|b|', chr(10), '|---|:---:|', chr(10), '|', n_name, '|c|')", "'|---|:---:|'"),
    ("html_block", "concat('<div>', n_name, '</div>', chr(10), '后')", "concat('<div>', n_name, '</div>')"),
    ("hard_break", "concat('行', n_name, '  ', chr(10), '次')", "'  '"),
    ("latex_math", "concat('见', chr(92), 'frac{', n_name, '}{2}吧')", "concat(chr(92), 'frac{', n_name, '}{2}')"),
    ("scientific_unit", "concat('约', n_nationkey, 'mg·L⁻¹吧')", "concat(n_nationkey, 'mg·L⁻¹')"),
]


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per span in a text for each kind of structure that the other queries lack."""
    texts = F.explode(F.array(*[F.struct(F.lit(kind).alias("seeded"), F.expr(seed).alias("seed")) for kind, seed, _ in STRUCTURES])).alias("s")
    rows = _load(spark, sf_dir, "nation").select("n_nationkey", texts).select("n_nationkey", "s.*")
    return ops.span_table(rows, "seed", "n_nationkey", "seeded").select("n_nationkey", "seeded", "kind", "value")


QUERIES["spans_of_structures"] = _structures
ORACLES["spans_of_structures"] = " UNION ALL ".join(f"SELECT n_nationkey, '{kind}' AS seeded, '{kind}' AS kind, {value} AS value FROM nation" for kind, _, value in STRUCTURES)
_query("math_suffix", "nation", "n_nationkey", "concat('面积2×', n_nationkey, 'cm²的和', n_nationkey, 'cm的')", lambda c: ops.format_column(c, Request(("spacing.number-unit",))), "concat('面积 2×', n_nationkey, 'cm² 的和', n_nationkey, ' cm的')")
_query("grapheme_scripts", "nation", "n_nationkey", "concat('汉é', n_nationkey, '２👩‍👩‍👧𠀀ñ。')", lambda c: F.array_join(F.transform(ops.scripts_column(c), lambda g: g["script"]), ","), "concat('han,latin,', repeat('digit,', length(CAST(n_nationkey AS VARCHAR)) + 1), 'other,han,latin,other')")
_EDITS = "array(named_struct('start', 0, 'end', 1, 'to', '<', 'priority', 0), named_struct('start', 0, 'end', 2, 'to', '[', 'priority', 1), named_struct('start', 2, 'end', 2, 'to', '+', 'priority', 0), named_struct('start', 3, 'end', 3, 'to', '!', 'priority', 0), named_struct('start', 3, 'end', 3, 'to', '?', 'priority', 0))"
_query("edits", "nation", "n_nationkey", "concat('abc', n_name)", lambda c: ops.edited_column(c, F.expr(_EDITS)), "concat('[+c!', n_name)")
_query("request_limits", "nation", "n_nationkey", "concat('单', n_nationkey)", lambda c: F.concat_ws(",", *[F.coalesce(ops.try_format_column(c, r)["error"], F.lit("ok")) for r in (Request(("x",) * 500), Request(("x",) * 501), Request("none", (Replacement("a", "b"),) * 201), Request("none", (Replacement("a", "b" * 16385),)))]), "'ok,too_many_rules,too_many_replacements,replacement_too_large'")
QUERIES["emails_in_documents"] = lambda spark, sf_dir: _load(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(ops.spans_column(F.col("text"), "addresses"), lambda s: s["kind"] == "email")).alias("emails"))
ORACLES["emails_in_documents"] = "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS INT) AS emails FROM documents"
QUERIES["token_kinds"] = lambda spark, sf_dir: _seeded("part", "p_partkey", "concat('中a', p_size, '，² ₂·☃')")(spark, sf_dir).select(F.explode(ops.tokens_column(F.col("seed"))).alias("t")).groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"))
ORACLES["token_kinds"] = """
SELECT kind, n FROM (VALUES ('cjk'), ('latin'), ('fullwidth_punctuation'), ('superscript'), ('whitespace'), ('subscript'), ('middot'), ('other')) AS k(kind), (SELECT count(*) AS n FROM part)
UNION ALL SELECT 'digit', CAST(sum(length(CAST(p_size AS VARCHAR))) AS BIGINT) FROM part
"""
QUERIES["rule_catalogue"] = lambda spark, sf_dir: ops.rules_table(spark).select("position", "key", "phase", "is_default", "kind", "risk", "disputed")
ORACLES["rule_catalogue"] = """
SELECT CAST(position AS INT) AS position, key, phase, is_default, kind, risk, disputed FROM (VALUES
(0, 'cleanup.reference-square', 'cleanup', false, 'cleanup', 'contextual', false),
(1, 'cleanup.collapse-horizontal-spaces', 'cleanup', false, 'cleanup', 'contextual', false),
(2, 'cleanup.limit-blank-lines', 'cleanup', false, 'cleanup', 'contextual', false),
(3, 'cleanup.kangxi-radicals', 'cleanup', false, 'cleanup', 'contextual', false),
(4, 'cleanup.cjk-internal-space', 'cleanup', false, 'cleanup', 'contextual', false),
(5, 'punctuation.no-repetition', 'punctuation', true, 'typography', 'contextual', false),
(6, 'punctuation.fullwidth-cjk', 'punctuation', true, 'typography', 'contextual', false),
(7, 'text.halfwidth-digits', 'punctuation', true, 'conversion', 'safe', false),
(8, 'text.halfwidth-ascii', 'punctuation', false, 'conversion', 'contextual', false),
(9, 'text.ascii-punct-in-latin', 'punctuation', true, 'typography', 'contextual', false),
(10, 'naming.proper-nouns', 'naming', false, 'typography', 'contextual', false),
(11, 'naming.expand-abbreviations', 'naming', false, 'typography', 'contextual', false),
(12, 'spacing.around-links', 'structure', false, 'typography', 'contextual', true),
(13, 'punctuation.corner-quotes', 'structure', false, 'typography', 'contextual', true),
(14, 'text.unicode-equivalents', 'structure', false, 'conversion', 'contextual', false),
(15, 'spacing.cjk-latin', 'boundary', true, 'typography', 'safe', false),
(16, 'spacing.cjk-number', 'boundary', true, 'typography', 'safe', false),
(17, 'spacing.number-unit', 'boundary', true, 'typography', 'contextual', false),
(18, 'spacing.numeric-punctuation', 'boundary', false, 'cleanup', 'contextual', false),
(19, 'spacing.temperature-cjk', 'boundary', true, 'typography', 'contextual', false),
(20, 'spacing.no-space-around-fw-punct', 'final', true, 'typography', 'safe', false)
) AS r(position, key, phase, is_default, kind, risk, disputed)"""
QUERIES["presets"] = lambda spark, sf_dir: ops.presets_table(spark).select("key", "mode", F.size("rules").alias("n_rules"), "conversion")
ORACLES["presets"] = "SELECT key, mode, CAST(n AS INT) AS n_rules, 'none' AS conversion FROM (VALUES ('copywriting', 'defaults', 9), ('pdf-cleaning', 'only', 12), ('technical-docs', 'only', 11)) AS p(key, mode, n)"
QUERIES["normalize_rule_keys"] = lambda spark, sf_dir: ops.normalize_keys_table(spark.createDataFrame([(0, "使用全角中文标点"), (1, "nope"), (2, "punctuation.fullwidth-cjk"), (3, "spacing.cjk-latin")], "i int, k string"), "k", "i")
ORACLES["normalize_rule_keys"] = "SELECT key, CAST(position AS INT) AS position FROM (VALUES ('punctuation.fullwidth-cjk', 0), ('spacing.cjk-latin', 3)) AS n(key, position)"
_COUNTED = ["cleanup.collapse-horizontal-spaces", "punctuation.no-repetition", "text.halfwidth-digits"]
QUERIES["rule_change_counts"] = lambda spark, sf_dir: ops.text_stats(_load(spark, sf_dir, "documents"), "text", *_COUNTED)
ORACLES["rule_change_counts"] = f"""
SELECT 'cleanup.collapse-horizontal-spaces' AS rule, count(*) FILTER (regexp_matches(text, '  ')) AS changed FROM documents
UNION ALL SELECT 'punctuation.no-repetition', count(*) FILTER ({sub("text", *REPEATS)} <> text) FROM documents
UNION ALL SELECT 'text.halfwidth-digits', count(*) FILTER (regexp_matches(text, '[０-９]')) FROM documents
"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through Structured Streaming, all files that are there, into a table."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkstone-")
    at = f"{base}/stream/{uuid.uuid4().hex}"
    # a stream reads folders: a table that is one file is read by its name within its folder
    source = f"{sf_dir}/documents.parquet*"
    formatting.run_available(spark, source, f"{at}/out", f"{at}/checkpoint", "text", ["punctuation.no-repetition"], native=True)
    return spark.read.parquet(f"{at}/out").select("doc_id", "text")


QUERIES["streaming_no_repetition"] = _stream
ORACLES["streaming_no_repetition"] = ORACLES["no_repetition_documents"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces between Han, Latin and numbers in sentences made from parts."""
    seeds = _seeded("part", "p_partkey", "concat('在', p_brand, '上花了', p_size, '元')")(spark, sf_dir)
    return seeds.select("p_partkey", ops.native_format(F.col("seed"), ["spacing.cjk-latin", "spacing.cjk-number"]).alias("text"))


QUERIES["spacing"] = entry
ORACLES["spacing"] = "SELECT p_partkey, concat('在 ', p_brand, ' 上花了 ', p_size, ' 元') AS text FROM part"
