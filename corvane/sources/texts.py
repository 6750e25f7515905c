"""Text tables: CSV with comments, sectioned dictionaries, Markdown tables, reports in JSON."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import exprs as X


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of each file by number from one, without their ends or a byte order mark."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("v"))
    parts = whole.select("path", F.posexplode(F.split(F.regexp_replace("v", r"\r?\n$", ""), r"\r?\n")).alias("line", "value"))
    return parts.select("path", (F.col("line") + 1).alias("line"), "value")


def saved_bases(numbered: DataFrame) -> DataFrame:
    """(path, file, id, row): the saved base rows of files of lines (path, line, value): a file's name, an id and the row,
    quoted or not. The first line is a header; lines of fewer fields or without an id are left out; of one file and id the
    last counts."""
    field = lambda i: F.regexp_extract("value", r"^([^,]*),([^,]*),(.*)$", i)
    raw = field(3)
    quoted = (F.length(raw) > 1) & F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"'))
    row = F.when(quoted, F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
    found = numbered.where((F.col("line") > 1) & F.regexp_like("value", F.lit(r"^[^,]*,[^,]*,")))
    found = found.select("path", "line", field(1).alias("file"), X.parse_id(field(2)).alias("id"), row.alias("row")).where("id is not null")
    return found.groupBy("path", "file", "id").agg(F.max_by("row", "line").alias("row"))


def commented_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, line, columns..., meta): records of CSV files whose `# key: value` lines are metadata.

    Columns are found by the header's names in any case of A-Z, others are ignored, missing ones are null. Fields may
    hold quoted breaks; `line` is where a record begins. A file without a header of any of `columns` has no rows.
    """
    schema = "path string, line int, " + ", ".join(f"`{c}` string" for c in columns) + ", meta map<string,string>"

    def records(text: str):
        meta, body, number = {}, [], []
        held = ""
        for i, raw in enumerate(text.lstrip("﻿").splitlines(keepends=True), 1):
            if not held and raw.startswith("#"):
                key, _, value = raw[1:].partition(":")
                meta[key.strip()] = value.strip()
                continue
            if not held:
                number.append(i)
            held += raw
            if held.count('"') % 2 == 0:
                body.append(next(csv.reader(io.StringIO(held, newline="")), []))
                held = ""
        if held:
            body.append(next(csv.reader(io.StringIO(held, newline="")), []))
        rows = [(n, r) for n, r in zip(number, body) if any(f.strip() for f in r)]
        if not rows:
            return
        header = {name.strip().lower(): i for i, name in reversed(list(enumerate(rows[0][1])))}
        at = [header.get(c.lower()) for c in columns]
        if any(i is not None for i in at):
            for n, r in rows[1:]:
                yield (n, *[r[i] if i is not None and i < len(r) else None for i in at], meta)

    def read(batches):
        for batch in batches:
            for p, text in zip(batch["path"], batch["value"]):
                yield pd.DataFrame([(p, *r) for r in records(text)], columns=["path", "line", *columns, "meta"])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInPandas(read, schema)


def dictionary(found: DataFrame) -> DataFrame:
    """(path, heading, ord, key, name): entries `:hex:name` of lines (path, line, value) under the last heading above.

    Headings are lines that are neither entries nor comments, which begin with a semicolon or slash, nor empty. A key
    that a section repeats keeps its first place and takes its last name.
    """
    entry = r"^:([0-9A-Fa-f]+):(.*)$"
    is_entry = F.regexp_like("value", F.lit(entry))
    is_heading = ~is_entry & ~F.regexp_like("value", F.lit(r"^\s*(;|/|$)"))
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    headed = found.withColumn("heading", F.last(F.when(is_heading, F.trim("value")), ignorenulls=True).over(w)).where(is_entry & F.col("heading").isNotNull())
    parsed = headed.select("path", "heading", "line", F.lower(F.regexp_extract("value", entry, 1)).alias("key"), F.trim(F.regexp_extract("value", entry, 2)).alias("name"))
    last = parsed.groupBy("path", "heading", "key").agg(F.min("line").alias("ord"), F.max(F.struct("line", "name")).alias("m"))
    return last.select("path", "heading", "ord", "key", F.col("m.name").alias("name"))


def markdown_rows(found: DataFrame, least: int) -> DataFrame:
    """(path, line, cells): rows of pipe tables of `least` cells or more, without headers' rules; of rows with equal
    first cells the first stands."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = found.where(F.trim("value").startswith("|")).withColumn("cells", cells).where((F.size("cells") >= least) & ~F.forall("cells", lambda c: F.regexp_like(c, F.lit("^:?-+:?$"))))
    return rows.groupBy("path", F.col("cells")[0].alias("label")).agg(F.min(F.struct("line", "cells")).alias("r")).select("path", "r.line", "r.cells")


def latest_reports(spark: SparkSession, folders: list[str], name: str, schema: str) -> DataFrame:
    """(set, report, bad): the JSON report `name` of each set's folder under `folders`; later folders win.

    The schema is given, never inferred: reports leave out what is empty. A text that is no JSON has `bad` and no report.
    """
    each = [spark.read.text(f"{f}/*/{name}", wholetext=True).select(F.lit(i).alias("ord"), F.col("_metadata.file_path").alias("path"), "value") for i, f in enumerate(folders)]
    found = each[0]
    for other in each[1:]:
        found = found.unionByName(other)
    of = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    last = found.groupBy(of.alias("set")).agg(F.max(F.struct("ord", "value")).alias("r"))
    parsed = F.from_json("r.value", schema)
    good = F.expr("try_parse_json(r.value)").isNotNull()
    return last.select("set", F.when(good, parsed).alias("report"), (~good).alias("bad"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(id, fname, gain, line): replacement rows, the last of an id standing; gains within 0 and 100, 100 by default;
    paths that leave their folder are refused."""
    rows = commented_csv(spark, path, ["id", "fname", "gain"])
    safe = ~F.regexp_like(F.coalesce("fname", F.lit("")), F.lit(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:"))
    gain = F.least(F.greatest(F.coalesce(F.expr("try_cast(gain as double)"), F.lit(100.0)), F.lit(0.0)), F.lit(100.0))
    rows = rows.select(X.parse_id(F.col("id")).alias("id"), "fname", gain.alias("gain"), "line").where(F.col("id").isNotNull() & safe)
    last = rows.groupBy("id").agg(F.max(F.struct("line", "fname", "gain")).alias("r"))
    return last.select("id", "r.fname", "r.gain", "r.line")


def json_map(rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """`rows` without `text`, with key and value: the entries of a JSON object whose keys begin with `prefix` and whose
    values are texts: relative paths, without a leading ./, that lead nowhere else. A text that is no object has none."""
    entry = F.explode(F.map_entries(F.from_json(text, "map<string,string>"))).alias("e")
    found = rows.select(*[c for c in rows.columns if c != text], entry)
    value = F.regexp_replace("e.value", r"^(?:\./)+", "")
    found = found.select(*[c for c in rows.columns if c != text], F.col("e.key").alias("key"), value.alias("value"))
    return found.where(F.startswith("key", F.lit(prefix)) & F.col("value").isNotNull() & ~F.contains("value", F.lit("://")) & ~F.contains("value", F.lit("..")))
