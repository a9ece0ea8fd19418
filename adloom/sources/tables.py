"""Readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import urls
from adloom.sources.schemas import JOB_ADS, PAGES, UPDATE


def good_pages(df: DataFrame) -> DataFrame:
    """Pages with a 2xx status; final_url falls back to the requested one."""
    return df.where(F.col("http_status").between(200, 299)).withColumn("final_url", F.coalesce("final_url", "requested_url"))


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Fetched pages."""
    return good_pages(spark.read.schema(PAGES).format(form).load(path))


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of a board's search API: path, body, payload (a variant), ok (false where the body is no JSON)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return raw.withColumn("payload", F.try_parse_json("body")).withColumn("ok", F.col("payload").isNotNull())


def list_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (sources.where("enabled") if enabled_only else sources).orderBy("id")


def write_ads(ads: DataFrame, path: str, now: Column | None = None, run: str | None = None) -> None:
    """Appends the ads of a run; an empty status is `new`, a missing scrape time is now; files lie by run and scrape date.

    A run that is written again, under its name, replaces what it wrote; without a name each call is a run of its own.
    """
    out = ads.withColumn("status", F.when(F.trim(F.coalesce("status", F.lit(""))) == "", "new").otherwise(F.col("status")))
    out = out.withColumn("scraped_at", F.coalesce("scraped_at", F.current_timestamp() if now is None else now))
    names = [x.split()[0] for x in JOB_ADS.split(", ")]
    out = out.select(*names, F.to_date("scraped_at").alias("scraped_on"))
    out.write.mode("overwrite").partitionBy("scraped_on").parquet(f"{path}/run={uuid.uuid4().hex if run is None else run}")


def read_ads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_ADS).parquet(path)


def update_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files as a stream: line, update (a struct), and why it can't be used: `no json`, `no update id`, else null. Blank lines are none."""
    lines = spark.readStream.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("update", F.from_json("line", UPDATE))
    return parsed.withColumn("reason", F.when(F.try_parse_json("line").isNull(), "no json").when(F.col("update.update_id").isNull(), "no update id"))


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Chat updates as a stream of JSON files; the checkpoint of the query that reads it holds the progress. Lines that are none are told by dead_letters."""
    return update_lines(spark, path).where("reason is null").select("update.*")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """(line, reason) of what read_updates leaves out, as a stream."""
    return update_lines(spark, path).where("reason is not null").select("line", "reason")


def updates_after(updates: DataFrame, last: int) -> DataFrame:
    """The batch form: updates not seen before."""
    return updates.where(F.col("update_id") > last)


def profile_map(profile: DataFrame) -> DataFrame:
    """One row with the profile as a map; of a repeated key the greatest value counts."""
    return profile.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("value").alias("value")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("profile"))


def list_profile(profile: DataFrame) -> DataFrame:
    return profile.orderBy("key")


def frontier(sources: DataFrame, max_pages: int) -> DataFrame:
    """The page addresses to fetch for each source: its own, then those of the board's search API (adapters dealls: page 2 on, kalibrr: offset 0 on)."""
    dealls = F.transform(F.sequence(F.lit(2), F.lit(max_pages)), lambda p: F.struct(p.alias("page_no"), urls.dealls_api_url(urls.dealls_search(F.col("url")), p).alias("page_url"))) if max_pages >= 2 else F.array()
    kalibrr = F.transform(F.sequence(F.lit(1), F.lit(max_pages)), lambda p: F.struct(p.alias("page_no"), urls.kalibrr_api_url(urls.kalibrr_search(F.col("url")), (p - 1) * 15).alias("page_url")))
    own = F.array(F.struct(F.lit(1).alias("page_no"), F.col("url").alias("page_url")))
    pages = F.when(F.col("adapter") == "dealls", F.concat(own, dealls)).when(F.col("adapter") == "kalibrr", kalibrr).otherwise(own)
    return sources.select(F.col("id").alias("source_id"), F.explode(pages).alias("p")).select("source_id", "p.page_no", "p.page_url")


def new_folder(spark: SparkSession) -> str:
    """A new folder's path below the one that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context; in local mode, where neither is set, below one of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = found.get() if found.isDefined() else None
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="adloom-")
    return f"{top}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: read often, computed once."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, number: Column) -> dict[int, DataFrame]:
    """df staged in parts by a small number; the numbers that occur with their parts, all rows under -1 if there are none."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.withColumn("_part", number.cast("int")).write.partitionBy("_part").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith("_part="))
    read = lambda where: spark.read.schema(df.schema).parquet(where)
    return {k: read(f"{path}/_part={k}") for k in found} or {-1: read(path)}
