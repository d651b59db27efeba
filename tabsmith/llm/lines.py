"""Site-relative line dedup: a line is boilerplate if a large share of its host's pages contain it.

Pages per line and host are counted from digests, combined before the shuffle. The lines over the ratio are few
per host (at most a host's lines per page, divided by the ratio), so pages only ever meet their host's list.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import put_back, require, saved, set_aside
from tabsmith.operators.lookup import spread_lookup

RATIO = 0.05
#: A line on fewer pages of its host is never boilerplate, however small the host.
LEAST_PAGES = 3
#: Up to this many (host, line) pairs go to every task; beyond, pages are joined to their host's list.
BROADCAST_LINES = 50_000
HOT_ROWS = 256
ADDED = ("n_lines", "n_dropped", "_drops", "_host", "_kept")
SPACE = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(SPACE))))


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) != ""


def boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True
) -> DataFrame:
    """_host, line (digest), pages, host_pages: the lines on more than ``ratio`` of their host's pages.

    Lines are compared without the white space around them and count once a page; empty ones never count. A null
    host is a host of its own. Repeated rows are pages of their own; without ``copies`` equal texts of a host are one
    page, on both sides of the ratio.
    """
    require(docs, host, "text")
    pages = docs.select(_host(F.col(host)).alias("_host"), "text")
    if not copies:
        pages = saved(pages.groupBy("_host", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text")).drop("digest"))
    lines = F.filter(F.split("text", "\n", -1), _has_words)
    keys = F.array_distinct(F.transform(lines, _key))
    counts = pages.select("_host", F.explode(keys).alias("line")).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counts = saved(counts.filter(F.col("pages") >= least_pages))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("host_pages"))
    met = spread_lookup(counts, totals, ["_host"], ["line"], "inner", HOT_ROWS)
    return met.filter(F.col("pages") > F.col("host_pages") * ratio)


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines cut from ``text``; adds ``n_lines`` and ``n_dropped``.

    Lines keep their order and the rest of a text stays as it is; ``n_chars`` follows where there is such a
    column. Null texts stay null (no lines), empty ones have one empty line. A text of nothing but boilerplate
    becomes empty; its row stays. Columns called like the added ones give way to them.
    """
    require(docs, host, "text")
    docs, moved = set_aside(docs, *ADDED)
    return _dropped(docs, host, ratio, least_pages).drop(*moved.values())


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The same without the added columns: those of ``docs`` stay as they are, but for ``text`` and ``n_chars``.

    Equal texts of a host count as one page, so that copies of a document don't make its lines boilerplate: they are
    left whole to near dedup.
    """
    require(docs, host, "text")
    own, moved = set_aside(docs, *ADDED)
    return put_back(_dropped(own, host, ratio, least_pages, copies=False), docs.columns, moved)


def _dropped(docs: DataFrame, host: str, ratio: float, least_pages: int, copies: bool = True) -> DataFrame:
    over = saved(boilerplate(docs, host, ratio, least_pages, copies))
    lists = over.groupBy("_host").agg(F.collect_set("line").alias("_drops"))
    keyed = docs.withColumn("_host", _host(F.col(host)))
    if over.count() <= BROADCAST_LINES:
        met = keyed.join(F.broadcast(lists), "_host", "left")
    else:
        met = spread_lookup(keyed, lists, ["_host"], ["text"], "left", HOT_ROWS)
    lines = F.split("text", "\n", -1)
    met = met.withColumns({"n_lines": F.size(lines), "_kept": F.when(F.col("_drops").isNotNull(), F.filter(
        lines, lambda x: ~_has_words(x) | ~F.array_contains("_drops", _key(x))))})
    met = met.withColumn("n_dropped", F.when(F.col("_kept").isNotNull(), F.col("n_lines") - F.size("_kept")).otherwise(0))
    met = met.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    met = met.withColumn("text", F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        met = met.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return met.select(*docs.columns, "n_lines", "n_dropped")


def _host(host: Column) -> Column:
    """A key that is never null and tells a null host from any other."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))
