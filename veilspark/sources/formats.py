"""What a file is, and its text: classification by name, sniffing by content, decoding with refusals as columns rather than exceptions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 50 << 20
# File endings by format.
ENDINGS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xml": "xml", "csv": "csv", "tsv": "csv", "txt": "text", "log": "text", "md": "text", "text": "text", "eml": "text", "html": "text"}


def classify(path: Column) -> Column:
    """The format that a name's ending says; null where it has none, ``unknown`` for one that is not read."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    return F.when(ending != "", F.coalesce(F.element_at(table, ending), F.lit("unknown")))


def refusal(content: Column) -> Column:
    """Why bytes are not read, else null."""
    head = F.hex(F.substring(content, 1, 8))
    sample = F.hex(F.substring(content, 1, 8192))
    nuls = F.size(F.filter(F.regexp_extract_all(sample, F.lit("(..)"), F.lit(1)), lambda b: b == "00"))
    return (
        F.when(F.length(content) == 0, "empty_file")
        .when(F.length(content) > LARGEST, "too_large")
        .when(head.startswith("89504E47") | head.startswith("FFD8FF"), "image_file")
        .when(nuls * 8 > F.least(F.length(content), F.lit(8192)), "binary_file")
        .when(~F.call_function("is_valid_utf8", content), "not_utf8")
    )


def decoded(content: Column) -> Column:
    """UTF-8 text without its byte order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def sniff_text(text: str) -> str:
    """json, jsonl, xml, csv or text, by content."""
    body = text.strip()
    if body[:1] in "{[" and body:
        try:
            json.loads(body)
            return "json"
        except ValueError:
            lines = [x for x in body.split("\n") if x.strip()]
            try:
                return "jsonl" if len(lines) > 1 and all(isinstance(json.loads(x), (dict, list)) for x in lines) else "text"
            except ValueError:
                return "text"
    if body.startswith("<") and body.endswith(">"):
        return "xml"
    lines = [x for x in body.splitlines() if x.strip()][:20]
    for mark in ",;\t|":
        widths = {x.count(mark) for x in lines}
        if len(lines) >= 3 and len(widths) == 1 and widths != {0}:
            return "csv"
    return "text"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, refused, text) of files; a refused file has no text."""
    files = spark.read.format("binaryFile").load(path)
    why = refusal(F.col("content"))
    rows = files.select("path", why.alias("refused"), F.when(why.isNull(), decoded(F.col("content"))).alias("text"))

    known = rows.withColumn("format", classify(F.col("path")))

    @F.arrow_udf("string")
    def sniffed(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else sniff_text(t) for t in text.to_pylist()], pa.string())

    # a Python column runs for all of its rows, so only those go there whose ending says nothing
    unknown = known.where("format is null").withColumn("format", sniffed("text"))
    both = known.where("format is not null").unionByName(unknown)
    return both.select("path", "format", F.when(F.col("format") == "unknown", "unknown_format").otherwise(F.col("refused")).alias("refused"), "text")
