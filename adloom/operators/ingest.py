"""From scraped rows to stored ads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.operators.listing import first_seen
from adloom.sources.tables import staged


def insert_if_new(existing: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("source_id", "page_no", "pos")) -> tuple[DataFrame, DataFrame]:
    """(new, skipped): incoming rows whose source_url is not stored, the first of each by `order`, and all others. Stored rows never change.

    The first row of an address is a minimum, which maps combine; rows then part by their own numbers, so that an address
    with many rows keeps no task busy alone.
    """
    rows = staged(incoming.withColumn("_row", F.monotonically_increasing_id()))
    first = rows.groupBy("source_url").agg(F.min(F.struct(*order, "_row")).alias("_first")).join(existing.select("source_url"), "source_url", "left_anti")
    fresh = staged(first.select(F.col("_first._row").alias("_row")))
    return tuple(rows.join(fresh, "_row", how).select(*incoming.columns) for how in ("left_semi", "left_anti"))


def new_ads(existing: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("source_id", "page_no", "pos")) -> DataFrame:
    """Only the new rows: duplicates combine before the shuffle, then one anti-join on the same key."""
    return first_seen(incoming, [], ["source_url"], list(order)).join(existing.select("source_url"), "source_url", "left_anti").select(*incoming.columns)


def enrich(stubs: DataFrame, details: DataFrame, fields: tuple[str, ...] = ("source_url", "title", "company", "salary", "description")) -> DataFrame:
    """A stub whose page was parsed becomes that detail row as a whole; the others stay. details has requested_url and the fields, title null where parsing failed."""
    found = first_seen(details.where(F.col("title").isNotNull()), [], ["requested_url"], ["source_url", "title"]).select("requested_url", F.struct(*fields).alias("_detail"))
    joined = stubs.join(found, stubs["source_url"] == found["requested_url"], "left")
    rest = [c for c in stubs.columns if c not in fields]
    return joined.select(*rest, F.coalesce("_detail", F.struct(*[stubs[f] for f in fields])).alias("_ad")).select(*rest, *[f"_ad.{f}" for f in fields]).select(*stubs.columns)


def pick_requested(candidates: DataFrame, static_ads: DataFrame) -> DataFrame:
    """One ad a requested_url: the one with that address, else the first by pos; of several at one place the least by their fields, so
    that no run picks another. If that has another address and no description, the static parse of the page stands in for it,
    under the requested address."""
    fields = ["title", "company", "salary", "description"]
    w = W.partitionBy("requested_url").orderBy((F.col("source_url") == F.col("requested_url")).desc(), "pos", "source_url", *fields)
    picked = candidates.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    static = static_ads.select("requested_url", F.struct(F.col("requested_url").alias("source_url"), *fields).alias("_static"))
    joined = picked.join(static, "requested_url", "left")
    own = F.struct("source_url", *fields)
    weak = (F.col("source_url") != F.col("requested_url")) & (F.coalesce("description", F.lit("")) == "")
    return joined.select("requested_url", F.when(weak, F.coalesce("_static", own)).otherwise(own).alias("_ad")).select("requested_url", "_ad.*")


def fill_empty_fields(ads: DataFrame, answers: DataFrame) -> DataFrame:
    """Blank title, company and salary from an extractor's answer (source_url, title, company, salary; null rows are errors and change nothing)."""
    names = ["title", "company", "salary"]
    said = first_seen(answers, [], ["source_url"], names).select("source_url", *[F.col(n).alias(f"_{n}") for n in names])
    fill = lambda n: F.when((F.trim(F.coalesce(n, F.lit(""))) == "") & F.col(f"_{n}").isNotNull(), F.trim(F.col(f"_{n}"))).otherwise(F.col(n))
    return ads.join(said, "source_url", "left").withColumns({n: fill(n) for n in names}).select(*ads.columns)


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """base with the last change of each key in its stead; rows of base come before all changes."""
    both = base.withColumn("_later", F.lit(0)).unionByName(changes.withColumn("_later", F.lit(1)))
    rest = [c for c in base.columns if c not in key]
    out = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_later", *order)).alias("_last"))
    return out.select(*[F.col(f"_last.{c}") if c in rest else F.col(c) for c in base.columns])


def assign_ids(new: DataFrame, start: int, order: list[str]) -> DataFrame:
    """new with ids start + 1, start + 2, … in `order` (which must tell rows apart).

    Rows are sorted within range partitions by all of `order` and staged; a row's place is that in its partition after the
    rows of the partitions before, which come from their counts.
    """
    placed = staged(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(*new.columns, (F.lit(start + 1) + F.col("_before") + place).cast("long").alias("id"))


def crawl_plan(sources: DataFrame, adapters: tuple[str, ...] = ("static", "jobstreet", "glints", "dealls", "kalibrr", "threads")) -> DataFrame:
    """Enabled sources with an action: skip (markers of link-only sources), error (an adapter that is not known), crawl."""
    action = F.when(F.col("adapter").isin("telegram", "threads"), "skip").when(~F.col("adapter").isin(*adapters), "error").otherwise("crawl")
    return sources.where("enabled").withColumn("action", action)


def crawl_summary(results: DataFrame) -> DataFrame:
    """Per run and source, and per run in all (source_id null): sources, new_ads, skipped, errors. results has a row a source with
    outcome source or error, and a row an ad with outcome new or skipped."""
    count = lambda what: F.count_if(F.col("outcome") == what).alias
    kinds = F.when(F.grouping("source_id") == 1, "run").otherwise("source").alias("level")
    return results.rollup("run", "source_id").agg(F.countDistinct("source_id").alias("sources"), count("new")("new_ads"), count("skipped")("skipped"), count("error")("errors"),
                                                  kinds, F.grouping("run").alias("_all")).where("_all = 0").drop("_all")
