"""Tables at rest, in hash parts of their key: a change reads and writes only the parts that its keys fall in.

A part is a folder `part=K`. What a changed part holds is worked out and staged first, then put in its place; a change that
stops on the way may have put some parts and not others, and is done again as a whole, which gives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators import ingest, review
from adloom.sources.tables import new_folder

PARTS = 64


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create(df: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """df as a table in parts by its column `key`; what stood there goes."""
    df.withColumn("part", part_of(key, parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(f"{ddl}, part int").parquet(path).drop("part")


def change(spark: SparkSession, path: str, ddl: str, key: str, keys: DataFrame, by: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """The table with `by` done to the parts that the rows of keys (with a column `key`) fall in; gives their numbers."""
    touched = sorted(r[0] for r in keys.select(part_of(key, parts).alias("p")).distinct().collect())  # PARTS at most
    if not touched:
        return []
    old = spark.read.schema(f"{ddl}, part int").parquet(path).where(F.col("part").isin(touched)).drop("part")
    stage = new_folder(spark)
    by(old).withColumn("part", part_of(key, parts)).repartition("part").write.partitionBy("part").parquet(stage)
    new = spark.read.schema(f"{ddl}, part int").parquet(stage)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    left = {r[0] for r in new.select("part").distinct().collect()}
    for p in set(touched) - left:  # nothing is left of these
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def set_status(spark: SparkSession, path: str, ddl: str, changes: DataFrame, order: tuple[str, ...], parts: int = PARTS) -> list[int]:
    """review.apply_status on stored ads (key id)."""
    return change(spark, path, ddl, "id", changes, lambda ads: review.apply_status(ads, changes, order), parts)


def delete(spark: SparkSession, ads: tuple[str, str], letters: tuple[str, str], ids: DataFrame, parts: int = PARTS) -> tuple[list[int], list[int]]:
    """review.delete_ads on stored ads (key id) and letters (key job_ad_id), each given as (path, ddl); letters go first, so that none is left without its ad."""
    of = ids.select("id").distinct()
    to = of.withColumnRenamed("id", "job_ad_id")
    gone = change(ids.sparkSession, *letters, "job_ad_id", to, lambda x: x.join(to, "job_ad_id", "left_anti").select(*x.columns), parts)
    return change(spark, *ads, "id", of, lambda x: x.join(of, "id", "left_anti").select(*x.columns), parts), gone


def upsert(spark: SparkSession, path: str, ddl: str, key: str, changes: DataFrame, order: list[str], parts: int = PARTS) -> list[int]:
    """ingest.upsert on a stored table."""
    return change(spark, path, ddl, key, changes, lambda base: ingest.upsert(base, changes, [key], order), parts)
