"""File sources and sinks."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a crawl reads.
SKIPPED = (".git", "node_modules", "venv", "dist")
EXTENSIONS = (".txt", ".md", ".json", ".csv", ".log", ".xml", ".yaml", ".yml", ".html", ".sql", ".pdf")
OFFICE = EXTENSIONS + (".docx", ".pptx", ".xlsx")
LARGEST = 50 << 20


def lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """One row per line of any length; blank lines are kept unless told otherwise."""
    df = spark.read.text(path).select(F.col("value").alias("text"))
    return df if blank else df.where(F.btrim("text") != "")


def body(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """Request bodies: a JSON document is one row (``json`` true), other text a row per line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.try_parse_json("value").isNotNull().alias("json"))
    parts = F.when(F.col("json"), F.array("text")).otherwise(F.split(F.regexp_replace("text", "\n\\z", ""), "\n"))
    out = whole.select("json", F.posexplode(parts).alias("line", "text"))
    return out if blank else out.where(F.btrim("text") != "")


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """One row per top-level value: the elements of an array, or the value itself, as JSON text."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    text = F.to_json("v")
    each = F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.array(text))
    return whole.select(F.posexplode(each).alias("ord", "value"))


def ragged_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row text, cells): rows may have any number of cells, and quoted cells may hold line ends, so a file is read from its start by one
    task; rows without a cell that is not blank, and malformed ones, are left out."""

    def run(frames):
        for frame in frames:
            for text in frame["value"]:
                lines = io.StringIO(text, newline="").readlines()
                rows, cut, done = [], [], 0
                reader = csv.reader(lines, strict=True)
                while done < len(lines):
                    try:
                        own = next(reader, None)
                    except csv.Error:
                        own = []
                    if own is None:
                        break
                    if any(c.strip() for c in own):
                        rows.append("".join(lines[done : reader.line_num]).rstrip("\r\n"))
                        cut.append(own)
                    done = reader.line_num
                yield pd.DataFrame({"row": pd.Series(rows, dtype=object), "cells": pd.Series(cut, dtype=object)})

    return spark.read.text(path, wholetext=True).mapInPandas(run, "row string, cells array<string>")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(rows: pd.Series) -> pd.Series:
    def one(r):
        try:
            return next(csv.reader(io.StringIO(r), strict=True), [])
        except csv.Error:
            return None

    return rows.map(one, na_action="ignore")


def cells(df: DataFrame, row: str = "row") -> DataFrame:
    """Adds the cells of CSV rows; malformed rows and those without any text go."""
    return df.withColumn("cells", _cut(row)).where(F.exists("cells", lambda c: F.btrim(c) != ""))


def crawl(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, content) of the files under a folder that a scan covers.

    Names and sizes are tested before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where((F.col("length") <= LARGEST) & wanted(F.col("path"), extensions)).select("path", "length", "content")


def wanted(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    end = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return end.isin(*extensions) & ~path.rlike("/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines log; lines that are no entries are left out."""
    from ..operators.report import LOG

    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("action IS NOT NULL")


def terms(spark: SparkSession, path: str, entity: str, known: DataFrame | None = None) -> DataFrame:
    """Dictionary terms from a JSON array of texts, those already known left out."""
    new = json_values(spark, path).select(F.lit(entity).alias("entity"), F.btrim("value").alias("term")).where("term <> ''").distinct()
    return new if known is None else new.join(known.select("entity", "term"), ["entity", "term"], "left_anti")


# -------------------------------------------------------------------- sinks


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_text(df: DataFrame, path: str, column: str = "text", mode: str = "append") -> None:
    df.select(column).write.mode(mode).text(path)


def write_log(df: DataFrame, path: str, at: str = "timestamp") -> None:
    """Appends to a log by day, so that expiry drops whole folders."""
    df.withColumn("day", F.to_date(F.to_timestamp(at))).write.mode("append").partitionBy("day").json(path)


def expired_days(spark: SparkSession, path: str, cutoff: str) -> list[str]:
    """Folders of a log by day that are older than the cutoff (a date)."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [p.getPath().getName() for p in fs.listStatus(base)]
    return sorted(f"{path}/{n}" for n in names if n.startswith("day=") and n[4:] < cutoff)


def delete(spark: SparkSession, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for f in folders:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
