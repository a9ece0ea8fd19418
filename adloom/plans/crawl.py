"""The workloads: a crawl of fetched pages to new ads, and message links to new ads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions import urls
from adloom.operators import ingest, listing
from adloom.operators.adapters import ads_of, parse_pages, read_facts, static_forms
from adloom.sources.html import text_with_breaks
from adloom.sources.payload import dealls_api_ads, kalibrr_api_ads, sections
from adloom.sources.tables import staged
from adloom.streaming.updates import links_by_id, message_links, wanted_messages

_FIELDS = ("source_url", "title", "company", "salary", "description")


def _single_rows(single: DataFrame) -> DataFrame:
    """Rows of sources without a walk: the first 100 links of a glints listing, all of the others."""
    capped = F.coalesce((F.col("adapter") == "glints") & (F.col("kind") == "listing"), F.lit(False))
    seen = listing.first_seen(single.where(capped), ["source_id"], ["source_url"], ["page_no", "pos"])
    return single.where(~capped).unionByName(listing.cap_per(seen, ["source_id"], ["page_no", "pos", "source_url"], 100))


def crawl(sources: DataFrame, pages: DataFrame, api_pages: DataFrame, details: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """new, skipped, errors and summary of a run.

    pages: (source_id, page_no, requested_url, final_url, body) of crawled sources; api_pages: (source_id, page_no, body) of
    search APIs (page_no is the offset for kalibrr); details: fetched detail pages (requested_url, final_url, body).
    """
    plan = ingest.crawl_plan(sources)
    active = F.broadcast(plan.where("action = 'crawl'").select(F.col("id").alias("source_id"), "adapter"))
    parsed = staged(parse_pages(pages.join(active, "source_id")))
    cards = parsed.where(F.col("error").isNull()).select("source_id", "adapter", "kind", "page_no", "pos", *_FIELDS)
    ends = parsed.groupBy("source_id", "adapter", "page_no").agg(F.max(F.col("next_url").isNotNull()).alias("has_next"), F.max("kind").alias("kind"))
    single = cards.where((F.col("kind") == "detail") | F.col("adapter").isin("static", "glints", "threads"))
    seek = (F.col("adapter") == "jobstreet") & (F.col("kind") == "listing")
    rows = [_single_rows(single).drop("adapter", "kind"),
            listing.listing_prefix(cards.where(seek).drop("adapter", "kind"), ends.where(seek), "link")]
    api = api_pages.join(active, "source_id")
    exploded = lambda df: df.select("source_id", "page_no", F.posexplode("ads").alias("pos", "ad"))
    d, k = dealls_api_ads(api.where("adapter = 'dealls'")), kalibrr_api_ads(api.where("adapter = 'kalibrr'"))
    first = (F.col("adapter") == "dealls") & (F.col("kind") == "listing")
    d_cards = cards.where(first).select("source_id", "page_no", "pos", *_FIELDS).unionByName(exploded(d).select("source_id", "page_no", "pos", "ad.*", F.lit("").alias("description")))
    d_pages = ends.where(first).select("source_id", "page_no", F.lit(True).alias("ok"), F.lit(None).cast("int").alias("total_pages")).unionByName(d.select("source_id", "page_no", "ok", "total_pages"))
    rows.append(listing.listing_prefix(d_cards, d_pages, "pages"))
    flat = exploded(k).select("source_id", "page_no", "pos", "ad.*")
    text = sections(F.col("_1"), F.col("_2"), ("Deskripsi Pekerjaan", "Kualifikasi Minimum"))
    k_cards = flat.withColumns({"_1": text_with_breaks(F.col("description_html")), "_2": text_with_breaks(F.col("qualifications_html"))}).withColumn("description", text)
    rows.append(listing.listing_prefix(k_cards.select("source_id", "page_no", "pos", *_FIELDS), k.select("source_id", "page_no", "ok", "count"), "offset"))
    stubs = rows[0]
    for r in rows[1:]:
        stubs = stubs.unionByName(r.select(*stubs.columns))
    stubs = staged(stubs)  # read for ads and for errors
    enriched = ingest.enrich(stubs, staged(parse_pages(details)).where((F.col("kind") == "detail") & F.col("error").isNull()))
    new, skipped = ingest.insert_if_new(existing, enriched)
    failed = listing.listing_errors(plan.where("action = 'crawl'").withColumnRenamed("id", "source_id"), stubs).select("source_id")
    errors = failed.unionByName(plan.where("action = 'error'").select(F.col("id").alias("source_id")))
    told = lambda df, what: df.select(F.lit("run").alias("run"), "source_id", F.lit(what).alias("outcome"))
    every = told(plan.select(F.col("id").alias("source_id")), "source")
    summary = ingest.crawl_summary(every.unionByName(told(new, "new")).unionByName(told(skipped, "skipped")).unionByName(told(errors, "error")))
    return {"new": new, "skipped": skipped, "errors": errors, "summary": summary}


def ingest_messages(updates: DataFrame, chat_id: int, pages: DataFrame | Callable[[DataFrame], DataFrame], existing: DataFrame | Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """links, picked, new and results of chat updates.

    pages are those fetched for the links (requested_url, final_url, body), or a function of the distinct links (url) that
    gives them; existing has the stored addresses, or is a function of the found ads that gives those they may meet.
    """
    links = staged(links_by_id(message_links(wanted_messages(updates, chat_id))))
    urls_ = links.select("url").distinct()
    asked = pages(urls_) if callable(pages) else pages.join(urls_.withColumnRenamed("url", "requested_url"), "requested_url", "left_semi")
    parts = read_facts(asked, also="static")  # a page may be asked for its board's ads and for its static form
    found = ads_of(parts).where(F.col("error").isNull()).select("requested_url", "pos", *_FIELDS)
    picked = staged(ingest.pick_requested(found, static_forms(parts)))
    ordered = staged(links.join(picked.withColumnRenamed("requested_url", "url"), "url"))
    new, _ = ingest.insert_if_new(existing(ordered) if callable(existing) else existing, ordered, ("update_id", "pos"))
    ok = links.join(picked.select(F.col("requested_url").alias("url"), F.lit(True).alias("_ok")), "url", "left")
    stored = new.select("update_id", "pos", F.lit(True).alias("_new"))
    results = ok.join(stored, ["update_id", "pos"], "left").select("update_id", "url", F.coalesce("_ok", F.lit(False)).alias("ok"), F.coalesce("_new", F.lit(False)).alias("inserted"))
    return {"links": links, "picked": picked, "new": new, "results": results}


def page_frontier_new(pages: DataFrame, stored: DataFrame, order: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pages whose canonical address is not stored yet, the first of each: (source_url, page_id, url)."""
    canonical = pages.select(urls.canonical_url(F.col("url")).alias("source_url"), "page_id", "url")
    return ingest.new_ads(stored.select(urls.canonical_url(F.col("url")).alias("source_url")), canonical, order)
