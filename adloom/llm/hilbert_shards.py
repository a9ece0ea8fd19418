"""Sharding by Hilbert curve: rows are ordered along a curve through several metadata dimensions and cut to runs.

Every dimension is a number (strings by their bytes after the prefix that all values share) and is quantised at quantiles
of all rows. Rows are sorted by the index of their cell on the curve, then by text hash and id, over range partitions;
copies of a text all take the least cell that one of them has, so that only groups at a cut part. A row's rank is its place in its partition plus the rows of the partitions before. Shard s of n gets the ranks from
ceil(s * rows / n) on, so that counts differ by one at most, and each shard's files span few values of every dimension.

Cases: null text has size 1 and CRC 0; null dimensions lie in the first cell; rows equal in every key are dealt in either
order, which no output shows but their ids; null and repeated ids keep their rows, also in written shards; fewer rows than
shards leave shards empty; an empty table gives an empty result; other columns are carried by `write_shards` only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.llm.common import free_name, joined_by, table, written

BITS, SHARDS = 5, 8


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers (rows, dimensions), by untwisting each bit level from the top."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            turned = (x[i] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    twist = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        twist = np.where((x[n - 1] & level) != 0, twist ^ (level - 1), twist)
        level >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ twist) >> bit) & 1)
    return index


def cells(values: pd.Series, cuts: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each value between sorted cuts. Fewer cells than the curve has are spread over all of it, so that a dimension of few values counts as much as others."""
    return np.searchsorted(cuts, values.fillna(-np.inf).to_numpy(), side="right") * ((1 << bits) - 1) // len(cuts)


def _shared_prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _numbers(df: DataFrame, dimensions: dict[str, Column]) -> dict[str, Column]:
    """Dimensions as doubles in the order of their values: strings by six bytes after the prefix of their least and greatest value."""
    kinds = dict(df.select(*[c.alias(k) for k, c in dimensions.items()]).dtypes)
    text = [k for k in dimensions if kinds[k] == "string"]
    ends = df.agg(*[f(dimensions[k]).alias(f"{n}_{k}") for k in text for n, f in (("a", F.min), ("z", F.max))]).first() if text else {}
    out = {}
    for k, c in dimensions.items():
        if k in text:
            skip = _shared_prefix(ends[f"a_{k}"] or "", ends[f"z_{k}"] or "")
            c = F.conv(F.rpad(F.hex(F.substring(F.encode(F.substring(c, skip + 1, 6), "UTF-8"), 1, 6)), 12, "0"), 16, 10)
        out[k] = c.cast("double")
    return out


def shard(docs: DataFrame, dimensions: dict[str, Column], shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) of every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    numbers = _numbers(docs, dimensions)
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("_hash"), *[c.alias(f"_d{k}") for k, c in enumerate(numbers.values())])
    rows = written(rows)
    cuts = rows.agg(*[F.percentile_approx(f"_d{k}", at, 10_000) for k in range(len(numbers))]).first()

    @F.pandas_udf("bigint")
    def curve(*parts: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([cells(p, np.unique(c or [0.0]), bits) for p, c in zip(parts, cuts, strict=True)], axis=1), bits))

    keyed = rows.select("doc_id", "size", "text_crc32", "_hash", curve(*[F.col(f"_d{k}") for k in range(len(numbers))]).alias("curve"))
    # copies of a text take the least place on the curve that one of them has, so that they are neighbours
    keyed = written(keyed)
    groups = written(keyed.groupBy("_hash").agg(F.min("curve").alias("_curve"), F.count("*").alias("_n")))
    keyed = joined_by(keyed, groups, "_hash", "_n").select("doc_id", "size", "text_crc32", "_hash", F.col("_curve").alias("curve"))
    order = ["curve", "_hash", "doc_id"]
    sorted_ = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "curve", F.monotonically_increasing_id().alias("_at")))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    ranked = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + place)
    exact = F.expr(f"(_rank * {shards}) div _all")
    first = F.expr(f"(((_rank * {shards}) div _all) * _all + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "curve", exact.cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"))


def write_shards(docs: DataFrame, dimensions: dict[str, Column], path: str, shards: int = SHARDS, text_col: str = "text") -> None:
    """docs as Parquet under path, a folder a shard, rows of a shard in the order of their slots.

    Every row is written, whatever its id: rows get numbers of their own when they are staged, and meet their places by those.
    """
    row, taken = free_name(docs, "_row"), {c: free_name(docs, c) for c in ("shard", "slot")}
    staged = written(docs.withColumn(row, F.monotonically_increasing_id()))
    places = shard(staged, dimensions, shards, id_col=row, text_col=text_col).select(F.col("doc_id").alias(row), *[F.col(c).alias(t) for c, t in taken.items()])
    out = staged.join(places, row).drop(row)
    out.repartitionByRange(taken["shard"], taken["slot"]).sortWithinPartitions(taken["shard"], taken["slot"]).write.partitionBy(taken["shard"]).parquet(path)


def query(spark, sf_dir) -> DataFrame:
    """op3: place of every document in eight shards by language, source and size; counts are at most one apart."""
    docs = table(spark, sf_dir, "documents")
    dims = {"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars")}
    return shard(docs, dims).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
