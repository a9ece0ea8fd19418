"""Lists, counts, bulk changes and checks over stored ads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.sources.schemas import STATUSES


def filter_status(ads: DataFrame, status: str | None) -> DataFrame:
    """Rows of a status: none given is `new`, `all` is every one, an unknown one gives no rows."""
    status = (status or "").strip() or "new"
    return ads if status == "all" else ads.where(F.col("status") == status)


def link_status(status: Column) -> Column:
    """The status in a link to a list page: an unknown or empty one is `new`."""
    return F.when(status.isin(*STATUSES, "all"), status).otherwise("new")


def page_link(status: Column, page: Column) -> Column:
    return F.concat(F.lit("/?status="), link_status(status), F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise(""))


def with_source_name(ads: DataFrame, sources: DataFrame, key: str = "source_id", out: str = "source_name") -> DataFrame:
    """ads with the name of their source, '' where it is missing."""
    names = sources.select(F.col("id").alias("_sid"), F.col("name").alias("_name"))
    return ads.join(names, ads[key] == names["_sid"], "left").withColumn(out, F.coalesce("_name", F.lit(""))).drop("_sid", "_name")


def list_ads(ads: DataFrame, sources: DataFrame, status: str | None = "new", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest ads; a limit of 0 or less gives none."""
    page = filter_status(ads, status).orderBy(F.desc("scraped_at"), F.desc("id")).offset(max(0, offset)).limit(max(0, limit))
    return with_source_name(page, sources)


def list_ads_after(ads: DataFrame, status: str | None, last: tuple | None, limit: int = 50) -> DataFrame:
    """The page after the ad (scraped_at, id): deep pages as cheap as the first."""
    rows = filter_status(ads, status)
    if last is not None:
        at, number = F.lit(last[0]), F.lit(last[1])
        rows = rows.where((F.col("scraped_at") < at) | ((F.col("scraped_at") == at) & (F.col("id") < number)))
    return rows.orderBy(F.desc("scraped_at"), F.desc("id")).limit(max(0, limit))


def status_counts(ads: DataFrame) -> DataFrame:
    """Ads of each status, and of `all`."""
    return ads.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("_g")).select(F.when(F.col("_g") == 1, "all").otherwise(F.col("status")).alias("status"), "n")


def page_info(ads: DataFrame, status: str | None, page: int, size: int = 50) -> DataFrame:
    """total, pages (of `size`) and the page shown: within 1 and the last, 1 of 0 where there is none."""
    out = filter_status(ads, status).agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return out.withColumn("page", F.greatest(F.lit(1).cast("long"), F.least(F.lit(page).cast("long"), "pages")))


def apply_status(ads: DataFrame, changes: DataFrame, order: tuple[str, ...], allowed: tuple[str, ...] = ("applied", "rejected", "ignored")) -> DataFrame:
    """ads with new statuses by id, the last by `order` of each; ids that are not there and statuses that are not allowed change nothing."""
    last = changes.where(F.col("status").isin(*allowed)).groupBy("id").agg(F.max_by("status", F.struct(*order, "status")).alias("_status"))
    return ads.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status")).select(*ads.columns)


def unknown_ids(ads: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes whose ad is not there: errors in the single form."""
    return changes.join(ads.select("id"), "id", "left_anti")


def delete_ads(ads: DataFrame, letters: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ads, letters) without those ids and their letters."""
    gone = ids.select("id").distinct()
    return ads.join(gone, "id", "left_anti"), letters.join(gone.withColumnRenamed("id", "job_ad_id"), "job_ad_id", "left_anti").select(*letters.columns)


def letters_of(ads: DataFrame, letters: DataFrame) -> DataFrame:
    """Letters of the given ads, newest first within an ad."""
    return letters.join(ads.select(F.col("id").alias("job_ad_id")).distinct(), "job_ad_id", "left_semi").select(*letters.columns).orderBy("job_ad_id", F.desc("created_at"), F.desc("id"))


def latest_letter(letters: DataFrame) -> DataFrame:
    """The newest letter of each ad; maps combine before the shuffle."""
    rest = [c for c in letters.columns if c != "job_ad_id"]
    out = letters.groupBy("job_ad_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_last"))
    return out.select(*["job_ad_id" if c == "job_ad_id" else f"_last.{c}" for c in letters.columns])


def letter_ranks(letters: DataFrame) -> DataFrame:
    """Letters with their place in their ad, the newest first."""
    return letters.withColumn("rank", F.row_number().over(W.partitionBy("job_ad_id").orderBy(F.desc("created_at"), F.desc("id"))))


def violations(ads: DataFrame, key: str = "id") -> DataFrame:
    """A row for each rule that a row breaks: status, source_url, title."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    broken = F.array_compact(F.array(F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
                                     F.when(blank("source_url"), "source_url"), F.when(blank("title"), "title")))
    return ads.select(key, F.explode(broken).alias("rule"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows of child that name a parent that is not there."""
    ids = parent.select(F.col(parent_key).alias("_pid"))
    return child.where(F.col(child_key).isNotNull()).join(ids, F.col(child_key) == F.col("_pid"), "left_anti")


def prompt_rows(ads: DataFrame, profile: DataFrame) -> DataFrame:
    """Every ad with the profile map, which is one row."""
    return ads.crossJoin(F.broadcast(profile))
