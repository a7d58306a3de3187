"""Secret scans over an incremental blob ledger.

Every historical version of a path is content-addressed (SHA-256 of its text).  A ledger says which rule versions have
seen a blob and what they found, so only unseen pairs of blob and rule version are scanned, once however many paths or
versions hold the blob; findings are then joined back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"

# The patterns of the three kinds of secret, and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters at least; a shorter match holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")


def _assign(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]


def _plain(rx: re.Pattern) -> Callable[[str], list[tuple[int, int]]]:
    return lambda text: [m.span() for m in rx.finditer(text)]


#: Kind, version and scanner, in the order in which kinds are listed.
RULES: list[tuple[str, str, Callable[[str], list[tuple[int, int]]]]] = [("assign", "1", _assign), ("access", "1", _plain(ACCESS)), ("hex", "1", _plain(HEX))]


def _scan(rules):
    by_key = {f"{kind}@{version}": f for kind, version, f in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[{"rule": k, "start": s, "end": e} for k in todo for s, e in by_key[k](text)] for text, todo in zip(pdf.text, pdf.todo, strict=True)]
            yield pd.DataFrame({"blob": pdf.blob, "rules": pdf.todo, "findings": found})

    return scan


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rules=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows to append) for a table with one row per path or historical version.

    findings: (doc_id, blob, findings) for every row of ``versions``; findings is null where the blob has none.  Null
    texts count as empty; rows with a null id are scanned and returned too; repeated rows each come back; an empty table
    gives no rows.  Other columns are not read.  ``ledger`` holds the rows that earlier calls returned.
    """
    spark, rules = versions.sparkSession, RULES if rules is None else rules
    tune(spark)
    keys = [f"{kind}@{version}" for kind, version, _ in rules]
    seen = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    rows = versions.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    least = F.lit(-(2**63)).cast("long")
    carriers = rows.groupBy("blob").agg(F.min(F.coalesce("doc_id", least)).alias("carrier"))  # one version of each blob
    done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    todo = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("done", F.array().cast("array<string>")))
    unseen = carriers.join(done, "blob", "left").select(F.col("blob").alias("b"), "carrier", todo.alias("todo")).where(F.size("todo") > 0)
    texts = rows.withColumn("carrier", F.coalesce("doc_id", least)).join(unseen, "carrier").where("blob = b").select("blob", "todo", "text")
    new = materialize(texts.mapInPandas(_scan(rules), LEDGER).dropDuplicates(["blob"]), "ledger", free=True)
    known = seen.join(carriers, "blob", "left_semi").unionByName(new).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(keys))
    found = known.distinct().groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("findings"))
    return rows.select("doc_id", "blob").join(found, "blob", "left"), new


def scan_in_batches(versions: DataFrame, batches: int, id_col: str = "doc_id", **names) -> tuple[DataFrame, DataFrame]:
    """scan_history() of one range of ids after another, each against the ledger of those before; and the whole ledger.

    Rows with a null id are in the last batch.
    """
    cuts = versions.select(F.col(id_col).cast("long").alias("i")).approxQuantile("i", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    low, found, ledger = None, None, None
    at = F.col(id_col).cast("long")
    for high in [*sorted({int(c) for c in cuts}), None]:
        part = versions if low is None else versions.where((at > low) | at.isNull())
        part = part if high is None else part.where(at <= high)
        got, new = scan_history(part, ledger, id_col=id_col, **names)
        found = got if found is None else found.unionByName(got)
        ledger = new if ledger is None else ledger.unionByName(new)
        low = high
    return found, ledger


def count_of(findings: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(findings, lambda f: f["rule"].startswith(f"{kind}@"))), F.lit(0)).cast("long")


def spans_of(findings: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    ranked = F.transform(findings, lambda f: F.struct(f["start"].alias("start"), order[F.substring_index(f["rule"], "@", 1)].alias("rank"), f["end"].alias("end"), F.substring_index(f["rule"], "@", 1).alias("kind")))
    text = F.transform(F.array_sort(ranked), lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return F.coalesce(F.array_join(text, ","), F.lit(""))
