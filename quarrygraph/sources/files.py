"""Source files as tables: Java, SQL, mapper XML, JSP and tag files, decoded by content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph.functions.kernels import ENCODINGS, decode


def read_sources(spark: SparkSession, root: str, patterns: str = "*.java", excludes: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """(path, text, encoding, lossy) of files below root whose name fits the glob; paths are relative to root.

    excludes are globs on relative paths (``**`` reaches over folders). Clean UTF-8 is decoded without Python; the rest
    is tried as Shift_JIS and EUC-JP, then read as UTF-8 with replacement characters. A forced encoding wins.
    """
    if encoding and encoding.lower() not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", patterns).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*(?=/)", ""), "^.*?" + _quoted(base) + "/", "")
    raw = raw.select(path.alias("path"), "content")
    for glob in excludes or []:
        raw = raw.where(~F.col("path").rlike(_glob(glob)))
    return decoded(raw, encoding).orderBy("path")


def decoded(raw: DataFrame, encoding: str | None = None) -> DataFrame:
    """path and content (and other columns) with text, encoding and lossy instead of content; batch or stream."""
    keep = [f for f in raw.schema.fields if f.name != "content"]
    plain = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [decode(bytes(c), encoding) for c in pdf["content"]]
            yield pdf.drop(columns="content").assign(text=[g[0] for g in got], encoding=[g[1] for g in got], lossy=[g[2] for g in got])

    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("lossy", T.BooleanType())])
    if encoding:
        return raw.mapInPandas(run, schema)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    clean = raw.where(valid).select(*(f.name for f in keep), plain.alias("text"), F.lit("utf-8").alias("encoding"), F.lit(False).alias("lossy"))
    return clean.unionByName(raw.where(~valid).mapInPandas(run, schema))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def _glob(glob: str) -> str:
    out = glob.replace("**/", "\0").replace("**", "\1").replace("*", "\2").replace("?", "\3")
    return "^" + _quoted(out).replace("\0", "(?:.*/)?").replace("\1", ".*").replace("\2", "[^/]*").replace("\3", "[^/]") + "$"


def read_project(spark: SparkSession, root: str, excludes: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """Java and SQL files and those XML files that hold a mapper."""
    java, sql = (read_sources(spark, root, p, excludes, encoding) for p in ("*.java", "*.{sql,SQL}"))
    xml = read_sources(spark, root, "*.xml", excludes, encoding).where(F.col("text").contains("<mapper"))
    return java.unionByName(sql).unionByName(xml)


def read_rules_sources(spark: SparkSession, root: str) -> DataFrame:
    """Java, JSP and tag files."""
    return read_sources(spark, root, "*.{java,jsp,tag}")


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) with lines from 1."""
    return files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_no"), "line")
