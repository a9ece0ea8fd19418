"""Listing pages: first sight of a link, where a walk over pages stops, caps.

Rows of a listing are (source_id, page_no, pos, source_url, …). Counts per page are small, so the stop page of each
source is worked out on them and joined back; only the cap ranks rows, within a source and up to the cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(df: DataFrame, scope: list[str], key: list[str], order: list[str]) -> DataFrame:
    """The first row by `order` of each key within each scope. The choice is a minimum, so that maps combine it before the shuffle."""
    rest = [c for c in df.columns if c not in (*scope, *key)]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    out = df.groupBy(*scope, *key).agg(first)
    return out.select(*[F.col(f"_first.{c}") if c in rest else F.col(c) for c in df.columns])


def cap_per(df: DataFrame, key: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The first n rows of each key; `order` must tell rows apart, or which of equal ones stay is open."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def listing_prefix(cards: DataFrame, pages: DataFrame, mode: str = "link", cap: int = 100, size: int = 15) -> DataFrame:
    """The rows that a walk over a source's pages keeps.

    pages has a row a fetched page with what tells of its end: link: has_next; pages: ok, total_pages; offset: ok, count
    (and page_no is the offset, in steps of size). A page is walked if all before it were and went on: page numbers without a gap (link and
    pages), ok, with cards, and with a link not seen on an earlier page. The walk goes on after a page with has_next
    (link), below its total_pages (pages), or while the next offset lies below the first page's count (offset). Of several
    rows of a page the least counts: one that is not ok, or tells of fewer pages.
    """
    known = {"link": "has_next", "pages": "total_pages", "offset": "count"}[mode]
    pages = first_seen(pages, ["source_id"], ["page_no"], [c for c in ("ok", known) if c in pages.columns])
    new = first_seen(cards, ["source_id"], ["source_url"], ["page_no", "pos"])
    added = new.groupBy("source_id", "page_no").agg(F.count("*").alias("added"))
    by_source = W.partitionBy("source_id").orderBy("page_no")
    walk = pages.join(added, ["source_id", "page_no"], "left").withColumn("added", F.coalesce("added", F.lit(0)))
    n = F.row_number().over(by_source)
    if mode == "link":  # a page without a further link is the last one walked
        good, last = F.col("page_no") == n, ~F.coalesce("has_next", F.lit(False))
    elif mode == "pages":
        good, last = (F.col("page_no") == n) & F.coalesce("ok", F.lit(False)), (F.col("page_no") > 1) & (F.col("page_no") >= F.coalesce("total_pages", F.lit(0)))
    else:
        total = F.first("count").over(by_source)
        good = (F.col("page_no") == (n - 1) * size) & ((F.col("page_no") == 0) | (F.col("page_no") < total)) & F.coalesce("ok", F.lit(False))
        last = F.lit(False)
    walk = walk.withColumn("_good", good & (F.col("added") > 0)).withColumn("_last", last)
    ended = F.max(F.col("_last").cast("int")).over(by_source.rowsBetween(W.unboundedPreceding, -1))
    bad = F.max((~F.col("_good")).cast("int")).over(by_source.rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = walk.withColumn("_stop", F.greatest(F.coalesce(ended, F.lit(0)), bad)).where("_stop = 0").select("source_id", "page_no")
    return cap_per(new.join(kept, ["source_id", "page_no"], "left_semi"), ["source_id"], ["page_no", "pos", "source_url"], cap)


def listing_errors(sources: DataFrame, kept: DataFrame) -> DataFrame:
    """Sources of which no row is kept: each is one error."""
    return sources.join(kept.select("source_id").distinct(), "source_id", "left_anti")
