"""Columns and tables of the engine: formatting, spans, tokens, and the catalogue."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import pipeline, registry, spans
from inkstone.functions.chars import kind_of, script_of
from inkstone.functions.edits import Edit, apply, arbitrate, edit
from inkstone.functions.registry import Replacement, Request, RequestError
from inkstone.functions.rules import native_rule

SPANS = "array<struct<start:int,end:int,kind:string,priority:int>>"
SCANNERS = {"all": spans.all_spans, "semantic": spans.semantic_spans, "structure": spans.structure_spans, "editable": spans.editable_spans, "addresses": spans.address_spans}


def native_format(col: Column, selection: str | list[str] = "defaults") -> Column:
    """The selected rules in order, without protection: one chain of built-in expressions that Catalyst compiles."""
    for key in registry.expand(selection):
        col = native_rule(key, col)
    return col


def native_replace(col: Column, replacements: list[Replacement]) -> Column:
    """Ordered literal replacements without protection."""
    for r in replacements:
        if r.active and r.source:
            col = F.replace(col, F.lit(r.source), F.lit(r.target))
    return col


def format_column(col: Column, request: Request | str = "defaults", dictionary: Mapping[str, str] | None = None) -> Column:
    """The whole protected pipeline on a string column, in Arrow batches; null stays null."""
    request = request if isinstance(request, Request) else registry.PRESETS.get(request) or Request(request)
    request.check()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else pipeline.format_text(t, request, dictionary) for t in texts], dtype=object)

    return run(col)


def try_format_column(col: Column, request: Request) -> Column:
    """struct<text, error>: as format_column, with the code of a request error in place of an exception."""

    @F.pandas_udf("struct<text:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                request.check()
                rows.append((None if t is None else pipeline.format_text(t, request), None))
            except RequestError as e:
                rows.append((None, e.code))
        return pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    return run(col)


def spans_column(col: Column, mode: str = "all") -> Column:
    """Spans of a text as an array of structs, by start; offsets are code points."""
    scan = SCANNERS[mode]

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [s._asdict() for s in scan(t)] for t in texts], dtype=object)

    return run(col)


def span_table(df: DataFrame, text_col: str, *keep: str, mode: str = "all") -> DataFrame:
    """A row per span with the columns ``keep`` and the span's text."""
    rows = df.select(*keep, F.col(text_col).alias("_text"), F.explode(spans_column(F.col(text_col), mode)).alias("_s"))
    return rows.select(*keep, "_s.*", F.substring(F.col("_text"), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("value"))


def tokens_column(col: Column) -> Column:
    """array<struct<ch, kind>> of the characters' classes."""

    @F.pandas_udf("array<struct<ch:string,kind:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"ch": c, "kind": kind_of(c)} for c in t] for t in texts], dtype=object)

    return run(col)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores where the scan has fewer splits than there are, as a table of one row group has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scripts_column(col: Column) -> Column:
    """array<struct<text, script>> of grapheme clusters: han, latin, digit or other."""

    @F.pandas_udf("array<struct<text:string,script:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"text": g, "script": script_of(g)} for g in regex.findall(r"\X", t)] for t in texts], dtype=object)

    return run(col)


def edited_column(col: Column, edits: Column) -> Column:
    """The text with an array<struct<start, end, to, priority>> applied after arbitration; a range outside it is an error."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        rows = [[Edit(e["start"], e["end"], e["to"], e["priority"]) for e in x] if x is not None else [] for x in lists]
        return pd.Series([None if t is None else apply(t, arbitrate([edit(t, *e) for e in x])) for t, x in zip(texts, rows, strict=True)], dtype=object)

    return run(col, edits)


def graphemes_column(col: Column) -> Column:
    """Extended grapheme clusters, by a built-in expression."""
    return F.regexp_extract_all(col, F.lit(r"(\X)"), F.lit(1))


def formulas_column(col: Column) -> Column:
    """Texts of chemical formulas."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [t[s:e] for s, e in spans.chemical_formulas(t)] for t in texts], dtype=object)

    return run(col)


def text_stats(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """For each rule, on how many rows its native form changes the text; one pass over the table."""
    col = F.col(text_col)
    sums = [F.sum((~native_rule(k, col).eqNullSafe(col)).cast("long")).alias(k) for k in keys]
    wide = df.agg(*sums)
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(f"`{k}`") for k in keys)))).alias("rule", "changed"))


def rules_table(spark: SparkSession) -> DataFrame:
    """The catalogue in order of execution."""
    rows = [(i, r.key, registry.PHASES[r.phase], r.name, r.kind, r.risk, r.disputed, r.default, (r.before, r.after), list(r.run_after), list(r.legacy)) for i, r in enumerate(map(registry.BY_KEY.get, registry.ORDER))]
    return spark.createDataFrame(rows, "position int, key string, phase string, name string, kind string, risk string, disputed boolean, is_default boolean, example struct<before:string,after:string>, run_after array<string>, legacy array<string>")


def presets_table(spark: SparkSession) -> DataFrame:
    rows = [(k, r.selection if isinstance(r.selection, str) else "only", r.rules(), r.conversion) for k, r in registry.PRESETS.items()]
    return spark.createDataFrame(rows, "key string, mode string, rules array<string>, conversion string")


def normalize_keys_table(df: DataFrame, key_col: str, position_col: str) -> DataFrame:
    """(position, key): stable keys for old names; unknown ones go, and of equal ones the first stays."""
    spark = df.sparkSession
    alias = spark.createDataFrame([(a, r.key) for r in registry.RULES for a in (r.key, *r.legacy)], "old string, stable string")  # the catalogue
    joined = df.join(F.broadcast(alias), df[key_col] == alias.old)
    return joined.groupBy(F.col("stable").alias("key")).agg(F.min(position_col).alias("position"))


def capabilities() -> dict[str, bool]:
    """What this build can do; conversion between scripts needs a dictionary of the caller's."""
    return {"conversion": False, "conversion_with_dictionary": True, "streaming": True}


def register(spark: SparkSession) -> None:
    """SQL functions: ink_format(text), ink_format_all(text), ink_spans(text)."""

    def simple(request: Request):
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else pipeline.format_text(t, request) for t in texts], dtype=object)

        return run

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [s._asdict() for s in spans.all_spans(t)] for t in texts], dtype=object)

    for name, r in (("ink_format", Request()), ("ink_format_all", Request("all")), *((f"ink_{regex.sub('-', '_', k)}", v) for k, v in registry.PRESETS.items())):
        spark.udf.register(name, simple(r))
    spark.udf.register("ink_spans", scan)
