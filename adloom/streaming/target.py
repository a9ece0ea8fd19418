"""A stream's target: the rows that micro-batches have added, in few folders, and commits that make a batch count.

`{target}/rows/span={level}-{first}-{last}/bucket=k` holds what the batches first to last added, in hash ranges of the address.
A batch writes a folder of level 0; `FAN` neighbours of a level are joined to one of the next, so that a batch finds at most
FAN folders a level, and each row is written once a level. Folders are told by their names and are whole once they have a
success mark; one that lies within a longer whole one is passed over, so a stop between writing and deleting does no harm.

`{target}/commits/batch=N` is written last. What a reader sees ends with the last commit; a batch that is run again replaces
what it wrote. Tables beside the rows lie in `{target}/{name}/batch=N`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash ranges of addresses; folders of a level that are joined.
BUCKETS, FAN = 32, 8
Folder = tuple[int, int, int]


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def has_files(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of whole folders (with a success mark) below path."""
    fs, p = _hadoop(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [n for n in found if has_files(spark, f"{path}/{n}/_SUCCESS")]


def folders(spark: SparkSession, target: str, before: int | None = None) -> list[Folder]:
    """Live folders (level, first, last), those of batches from `before` on left out."""
    every = [_folder(n) for n in _names(spark, f"{target}/rows")]
    if before is not None:
        every = [f for f in every if f[2] < before]
    inside = lambda a, b: a[0] < b[0] and b[1] <= a[1] and a[2] <= b[2]
    return sorted(f for f in every if not any(inside(f, g) for g in every))


def _path(target: str, f: Folder) -> str:
    return f"{target}/rows/span={f[0]}-{f[1]}-{f[2]}"


def _folder(name: str) -> Folder:
    return tuple(map(int, name.removeprefix("span=").split("-")))


def _read(spark: SparkSession, target: str, ddl: str, of: list[Folder]) -> DataFrame:
    """Rows of some folders, with their bucket."""
    return spark.read.schema(f"{ddl}, span string, bucket int").option("basePath", f"{target}/rows").parquet(*[_path(target, f) for f in of]).drop("span")


def bucket(url: str = "source_url"):
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def fold(spark: SparkSession, target: str, ddl: str, before: int) -> None:
    """Join folders of batches before `before` until no level has FAN of them; what is joined goes."""
    while True:
        live = folders(spark, target, before)
        full = next((some[:FAN] for level in sorted({f[0] for f in live}) if len(some := [f for f in live if f[0] == level]) >= FAN), None)
        if full is None:
            break
        new = (full[0][0] + 1, min(f[1] for f in full), max(f[2] for f in full))
        _read(spark, target, ddl, full).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_path(target, new))
        for f in full:
            remove(spark, _path(target, f))
    live = set(folders(spark, target, before))
    for n in _names(spark, f"{target}/rows"):  # what a stop has left inside a longer folder
        f = _folder(n)
        if f[2] < before and f not in live:
            remove(spark, _path(target, f))


def read_rows(spark: SparkSession, target: str, ddl: str, before: int | None = None) -> DataFrame:
    """Rows of the target, of the batches before `before` if that is given."""
    live = folders(spark, target, before)
    if not live:
        return spark.createDataFrame([], ddl)
    return _read(spark, target, ddl, live).drop("bucket")


def stored(rows: DataFrame, target: str, number: int) -> DataFrame:
    """(source_url) of the batches before `number` in the hash ranges that rows fall in; nothing else of the target is read."""
    spark, live = rows.sparkSession, folders(rows.sparkSession, target, number)
    if not live:
        return spark.createDataFrame([], "source_url string")
    ranges = [r[0] for r in rows.select(bucket().alias("b")).distinct().collect()]  # BUCKETS at most
    return _read(spark, target, "source_url string", live).where(F.col("bucket").isin(ranges)).select("source_url")


def add(rows: DataFrame, target: str, number: int) -> DataFrame:
    """rows, written as those of batch `number` and read back."""
    own = (0, number, number)
    rows.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_path(target, own))
    return _read(rows.sparkSession, target, ddl_of(rows), [own]).drop("bucket")


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def put(df: DataFrame, target: str, name: str, number: int) -> None:
    """df as batch `number` of the table `name` beside the rows."""
    df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")


def commit(df: DataFrame, target: str, number: int) -> None:
    """The one row of df makes batch `number` count."""
    put(df.coalesce(1), target, "commits", number)


def committed(spark: SparkSession, target: str, before: int | None = None) -> list[int]:
    """Numbers of the batches that count, in order."""
    found = sorted(int(n.split("=")[1]) for n in _names(spark, f"{target}/commits"))
    return found if before is None else [n for n in found if n < before]


def read_table(spark: SparkSession, target: str, name: str, ddl: str) -> DataFrame:
    """A table beside the rows, as far as batches count."""
    done = committed(spark, target)
    if not done:
        return spark.createDataFrame([], ddl)
    whole = spark.read.schema(f"{ddl}, batch long").parquet(f"{target}/{name}").where(F.col("batch") <= done[-1])
    return whole.drop("batch")
