"""Line deduplication by site-relative frequency.

A line is boilerplate of its site if more than ``max_ratio`` of the site's
pages contain it. A line of one page alone says nothing, so ``min_pages`` is 2:
the ratio decides. Pages are counted in
one aggregation of ``(site, 128-bit line hash)`` with map-side combine; text
does not move for it. A site has fewer than (mean lines per page) / max_ratio
boilerplate lines, so they fit into one array per site, which joins the pages.

Hot sites: a site with more than 1/1000 of all pages (so at most 1000 sites, a
bounded broadcast) is split over as many salts as it has thousandths, and only
its array is repeated. The page text moves at most once and never is exploded
and regrouped. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.staging import free_name, stage

HOT_SHARE = 1000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """128-bit identity of a line without its outer white space."""
    bare = F.trim(F.regexp_replace(line, r"[\t\r\x0B\f]+", " "))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def boilerplate_lines(
    docs: DataFrame, site_col: str, text_col: str, max_ratio: float, min_pages: int
) -> DataFrame:
    """(site, pages, lines): each site's page count and boilerplate line keys."""
    pages = docs.select(
        F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.col(text_col).alias("body")
    )
    keys = F.array_distinct(
        F.transform(F.filter(_lines(F.col("body")), lambda x: F.trim(x) != ""), _key)
    )
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counted = (
        pages.select("site", F.explode(keys).alias("line"))
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    bad = (
        counted.join(totals, "site")
        .filter(F.col("n") > F.col("pages") * F.lit(max_ratio))
        .groupBy("site")
        .agg(F.collect_list("line").alias("lines"))
    )
    return totals.join(bad, "site", "left")


def line_dedup(
    docs: DataFrame,
    site_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    max_ratio: float = 0.1,
    min_pages: int = 2,
    lines_col: str = "dedup_lines",
    dropped_col: str = "dedup_dropped",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` cleaned, and beside them
    ``lines_col`` (lines before) and ``dropped_col`` (lines dropped).

    Lines end at ``\\n``; they are compared without outer white space, and blank
    lines are never boilerplate. Rows with a null site form one site. A null
    text stays null. Columns of ``docs`` with the names of the two counts are
    replaced. Repeated rows count as pages of their own; an empty table gives
    no rows.
    """
    key_col, salt_col, salts_col, bad_col, kept_col = (free_name(docs.columns, c) for c in ("site_key", "salt", "salts", "bad_lines", "kept_lines"))
    sites = stage(boilerplate_lines(docs, site_col, text_col, max_ratio, min_pages), "site-lines")
    total = sites.agg(F.sum("pages")).first()[0] or 0
    salts = F.ceil(F.col("pages") * F.lit(HOT_SHARE) / F.lit(max(1, total))).cast("int")
    hot = sites.filter(F.col("pages") * HOT_SHARE > total).select(F.col("site").alias(key_col), salts.alias(salts_col))
    per_site = sites.filter("lines is not null").select(
        F.col("site").alias(key_col),
        F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)).alias(salt_col),
        F.col("lines").alias(bad_col),
    )
    names = [c for c in docs.columns if c.lower() not in (lines_col.lower(), dropped_col.lower())]
    text = F.col(f"`{text_col}`")
    keyed = (
        docs.select(*[F.col(f"`{c}`") for c in names])
        .withColumn(key_col, F.coalesce(F.col(f"`{site_col}`"), F.lit("")))
        .join(F.broadcast(hot), key_col, "left")
        .withColumn(
            salt_col,
            F.coalesce(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.col(salts_col)).cast("int"), F.lit(0)),
        )
    )
    joined = keyed.join(per_site, [key_col, salt_col], "left")
    lines = _lines(text)
    kept = F.when(
        F.col(bad_col).isNull(), lines
    ).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(bad_col), _key(x))))
    cleaned = joined.withColumn(kept_col, kept)
    return cleaned.select(
        *[
            F.when(text.isNotNull(), F.array_join(kept_col, "\n")).alias(c) if c == text_col else F.col(f"`{c}`")
            for c in names
        ],
        F.size(lines).alias(lines_col),
        (F.size(lines) - F.size(kept_col)).alias(dropped_col),
    )
