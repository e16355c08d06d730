"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import SPACE_CLASS, fresh, quoted, stored

MAX_RATIO = 0.05
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, null where there is none."""
    return F.lower(F.parse_url(url, F.lit("HOST")))


def _mark(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(
    pages: DataFrame, host: str, text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, marks): the MD5 marks of the lines on more than ``max_ratio`` of a host's pages.

    Pages of one text are one page: copies make no line boilerplate, all null texts are one page too.
    A line counts once per page and at least on ``min_pages`` pages. Lines without a word are no
    boilerplate, rows without a host belong to no site. A host gets at most (its mean number of
    lines per page) / ``max_ratio`` marks, whatever its size. Counting combines before the shuffle,
    so a host with a third of all pages is spread over its lines. A line is on no more pages than rows,
    so rows are counted first and the digests of texts only for the lines that this leaves.
    """
    named = pages.where(quoted(host).isNotNull()).select(quoted(host).alias("host"), quoted(text).alias("text"))
    page = F.coalesce(_mark(F.col("text")), F.lit(b""))
    totals = stored(named.groupBy("host").agg(F.count_distinct(page).alias("n_host")), "boilerplate-pages")
    often = (F.col("n_pages") >= min_pages) & (F.col("n_pages") > max_ratio * F.col("n_host"))
    words = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    rows = (
        named.select("host", F.explode(words).alias("line"))
        .groupBy("host", _mark(F.col("line")).alias("mark"))
        .agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    likely = stored(rows.join(totals, "host").where(often).select("host", "mark"), "boilerplate-likely")
    counts = (
        named.select("host", page.alias("page"), F.explode(words).alias("line"))
        .select("host", "page", _mark(F.col("line")).alias("mark"))
        .join(likely, ["host", "mark"], "left_semi")
        .groupBy("host", "mark")
        .agg(F.count_distinct("page").alias("n_pages"))
    )
    return (
        counts.join(totals, "host")
        .where(often)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str,
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    report: bool = False,
) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``; all rows and columns stay.

    The list of marks is written first, so Spark broadcasts it when it is small and otherwise
    joins by host and splits hot hosts. ``report`` adds ``n_lines`` and ``n_dropped`` (both 0 for
    a null text, which stays null). An empty text is one empty line. A text that is all
    boilerplate becomes empty. Repeated texts are one page, and each row of them is cut alike.
    """
    marks = stored(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    site, found = fresh(pages, "_site"), fresh(pages, "_marks")
    marks = marks.select(F.col("host").alias(site), F.col("marks").alias(found))
    joined = pages.join(marks, quoted(host) == F.col(site), "left")
    kept = F.filter(F.split(quoted(text), "\n"), lambda x: ~F.array_contains(F.col(found), _mark(x)))
    cleaned = F.when(F.col(found).isNull(), quoted(text)).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text else quoted(c) for c in pages.columns]
    if report:
        count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
        n_lines = F.when(quoted(text).isNull(), F.lit(0).cast("long")).otherwise(count(F.split(quoted(text), "\n")))
        n_kept = F.when(F.col(found).isNull() | quoted(text).isNull(), n_lines).otherwise(count(kept))
        columns += [n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")]
    return joined.select(*columns)
