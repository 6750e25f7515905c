"""Line dedup by site-relative frequency: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, few, stored

#: Share of a host's pages above which a line is boilerplate.
MAX_RATIO = 0.1
#: Pages that must show a line in production: a host of a few pages has no boilerplate to tell.
MIN_PAGES = 4
#: Blanks around a line don't tell lines apart.
BLANKS = " \t\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _host(host: str) -> Column:
    """A key of the host; null is a host of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(host).cast("string")), F.lit("n")).alias("__host")


def _keys(text: str) -> Column:
    """64-bit keys of the different lines of a text that are not blank."""
    bare = F.transform(F.split(F.col(text), "\n"), _bare)
    return F.transform(F.filter(F.array_distinct(bare), lambda x: x != ""), lambda x: F.xxhash64(x))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = 1, distinct_pages: bool = False) -> DataFrame:
    """(__host, __line): the 64-bit key of each boilerplate line under its host's key.

    The pages that contain the line, divided by the host's pages, must exceed `max_ratio`. A page is a row with a text.
    Two guards can be set: fewer than `min_pages` pages make no line boilerplate, and with `distinct_pages` a page is a
    different text of the host, so a group of exact copies counts as one page and cannot make its own lines
    boilerplate. All counts are partial sums, also those of a host that has a third of all pages.
    """
    pages = docs.where(F.col(text).isNotNull()).select(_host(host), F.xxhash64(text).alias("__page"), F.col(text).alias("__text"))
    count = F.count_distinct("__page") if distinct_pages else F.count("*")
    total = pages.groupBy("__host").agg(count.alias("pages"))
    lines = pages.select("__host", "__page", F.explode(_keys("__text")).alias("__line"))
    shown = lines.groupBy("__host", "__line").agg(count.alias("shown")).where(F.col("shown") >= min_pages)
    return shown.join(total, "__host").where(F.col("shown") / F.col("pages") > max_ratio).select("__host", "__line")


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = 1, distinct_pages: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` with boilerplate lines cut from `text`, and two columns more: n_lines and n_dropped.

    Every row stays, in its own form: other lines keep their blanks and order. Blank lines are never boilerplate. A
    null text stays null with zero lines; an empty text is one blank line; a text of boilerplate alone becomes empty.
    A null host is a host like any other. Repeated rows are treated alike. An empty table gives an empty table.
    Columns that `docs` has under the names n_lines and n_dropped are replaced. Lines are compared by 64-bit keys
    within a host.

    While the boilerplate lines of all hosts are few enough to be broadcast, which is counted first, the texts are not
    shuffled. Beyond that each different page's lines are joined with them by host and line, and the lists of lines to
    drop go back to the texts by host and page: no host meets in one task.
    """
    found = stored(boilerplate(docs, host, text, max_ratio, min_pages, distinct_pages), "boilerplate")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(F.struct(*[F.col(c) for c in names]).alias("doc"), F.col(text).alias("__text"), _host(host))
    if found.count() <= broadcast_rows:
        out = docs.join(F.broadcast(found.groupBy("__host").agg(F.collect_set("__line").alias("__drop"))), "__host", "left")
    else:
        pages = docs.withColumn("__page", F.xxhash64("__text"))
        lines = pages.select("__host", "__page", F.explode(_keys("__text")).alias("__line")).distinct()
        lists = lines.join(found, ["__host", "__line"]).groupBy("__host", "__page").agg(F.collect_set("__line").alias("__drop"))
        out = pages.join(lists, ["__host", "__page"], "left")
    lines = F.split("__text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("__drop", F.xxhash64(_bare(x))) | (_bare(x) == ""))
    out = out.withColumn("__kept", F.when(F.col("__drop").isNull(), lines).otherwise(kept))
    return out.select(
        *[(F.array_join("__kept", "\n") if c == text else F.col("doc")[c]).alias(c) for c in names],
        F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).alias("n_dropped"),
    )
