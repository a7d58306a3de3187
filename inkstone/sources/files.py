"""Whole texts in and out, and settings."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.registry import Replacement, Request, normalize_keys


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of UTF-8 files, each one row with its line ends as they are."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.decode("content", "UTF-8").alias("text"))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def write_texts(df: DataFrame, text_col: str, path: str) -> None:
    """A text file part per partition; a line feed ends each text."""
    df.select(text_col).write.text(path)


@dataclass
class Settings:
    """What of a settings document matters to data: rules, replacements and conversion."""

    request: Request
    notice: str = ""


def load_settings(spark: SparkSession, *paths: str) -> Settings:
    """The first JSON document that can be read, with old rule names brought up to date; else defaults, with a notice."""
    notice = ""
    for path in paths:
        try:
            body = json.loads(spark.read.text(path, wholetext=True).first()[0])
            pairs = tuple(Replacement(p["from"], p["to"], p.get("active", True)) for p in body.get("replacements", []))
            keys = body.get("enabled")
            return Settings(Request("defaults" if keys is None else tuple(normalize_keys(keys)), pairs, body.get("conversion", "none")), notice)
        except Exception as e:  # a broken document falls back to the next one
            notice = f"{path} can't be read: {type(e).__name__}"
    return Settings(Request(), notice or "no settings")
