"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts in an Arrow batch.
TEXT_ROWS = 2000
#: ASCII white space, the separators of `[^\x20\x09-\x0D]+` words.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or in local mode, where that is unset, an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="adloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def batch_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches hold `rows` rows within this block, unless the session has a number of its own: ten thousand whole texts are much for a task's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = rows is not None and spark.conf.get(name) == "10000"
    if own:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(name)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, with no lineage, safe against lost executors. rows: see batch_rows."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    with batch_rows(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or that with underscores in front until no column of df (in any case) has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def ranked(df: DataFrame, key: str, order: list[str], name: str = "rank") -> DataFrame:
    """df (staged) with each row's place, from 0, among the rows of its key (never null) in `order`; which of equal rows comes first is open.

    Rows are sorted in range partitions by key and order and numbered within a partition's run of a key; a run that goes on
    in the next partition adds its length there. What the driver holds is a row a partition, so a key may have any number of rows.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b[key]
            starts = np.append(0, np.flatnonzero(pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)) + 1)
            place = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
            if k[0].as_py() == last:
                place[:starts[1] if len(starts) > 1 else len(k)] += before
            last, before = k[len(k) - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(np.full(len(k), part, np.int32))], [*b.schema.names, name, "_part"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` long, _part int"
    placed = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(number, schema))
    ends = placed.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(name, F.struct(key, name)).alias("n")).orderBy("_part").collect()  # a row a partition
    carried, last, run = [], None, 0
    for r in ends:
        goes_on = last is not None and r["first"] == last
        if goes_on:
            carried.append((r["_part"], r["first"], run))
        run = r["n"] + 1 + (run if goes_on and r["first"] == r["last"] else 0)
        last = r["last"]
    if not carried:
        return placed.drop("_part")
    kind = dict(df.dtypes)[key]
    more = F.broadcast(df.sparkSession.createDataFrame(carried, f"_part int, `{key}` {kind}, _run long"))
    return placed.join(more, ["_part", key], "left").withColumn(name, F.col(name) + F.coalesce("_run", F.lit(0))).select(*df.columns, name)


def joined_by(many: DataFrame, one: DataFrame, key: str, n: str, hot: int = 1000) -> DataFrame:
    """many joined with the one row of `one` that has its key; column n of `one` says how many rows of many have it.

    Keys with more than one in `hot` of all rows, fewer than `hot` by their number, are broadcast; no key of the shuffle join has more.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    rows = one.where(F.col(n) * hot > total)
    few = F.broadcast(rows)
    common = many.join(few, key)
    return common.unionByName(many.join(F.broadcast(rows.select(key)), key, "left_anti").join(one.where(F.col(n) * hot <= total), key))
