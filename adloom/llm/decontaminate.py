"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the word windows of every document.

Words are compared after lower-casing A to Z. An item's windows are all its runs of `size` words, or all its words if it
has fewer. Item words get numbers; a window of numbers has a 64-bit rolling hash; the hashes lie sorted in one array per
window length. A batch of documents is turned to numbers at once, windows of known words are hashed and looked up, and
each match is verified word by word.

The set holds about `BLOCK_WORDS` item words. A larger benchmark is split by item into blocks of that size. One block after
another is collected, broadcast, scanned, its hits written as a table, and its broadcast destroyed, so that driver and
executors hold one block at a time; the hits of all blocks meet on a row number.

Cases: null texts and items have no words; of items equal in id and text one is read; a null item_id counts for hit words but is not listed; repeated items count
once by item_id; a null doc_id keeps its row; an empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import free_name, let, table, written

SIZE, BLOCK_WORDS = 10, 2_000_000
#: Bytes that separate words, as spaces: all ASCII but digits and lower-case letters.
_CLEAN = bytes(c if c > 0x7F or chr(c).isdigit() or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_CLEAN).split()


class Windows:
    """The hash set of one block of items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[k:k + size]), set()).update([name] if name is not None else [])
        self.by_length = {}
        for length in sorted({len(w) for w in found}):
            grams = [w for w in found if len(w) == length]
            ids = np.array(grams, np.int64).reshape(-1, length)
            hashes = self.hashed(ids)
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = (hashes[order], ids[order], [sorted(found[grams[k]]) for k in order])

    @staticmethod
    def hashed(ids: np.ndarray) -> np.ndarray:
        h = np.zeros(len(ids), np.uint64)
        for k in range(ids.shape[1]):
            h = h * np.uint64(_BASE) + ids[:, k].astype(np.uint64)
            h ^= h >> np.uint64(29)
        return h

    def scan(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """For texts' words laid end to end: where each text starts, which words are hit, and (text, item) of each match."""
        sizes = np.array([len(w) for w in texts], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes + 1)])  # one empty place after each text keeps windows inside it
        flat = np.zeros(start[-1], np.int64)
        for at, w in zip(start.tolist(), texts, strict=False):
            flat[at:at + len(w)] = np.fromiter(map(self.number.get, w, repeat(0)), np.int64, len(w))
        unknown = np.concatenate([[0], np.cumsum(flat == 0)])
        edge, names = np.zeros(len(flat) + 1, np.int64), []
        for length, (hashes, ids, items) in self.by_length.items():
            if len(flat) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:len(unknown) - length])
            windows = flat[at[:, None] + np.arange(length)]
            h = self.hashed(windows)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for step in range(int((high - low).max(initial=0))):  # more than one only where hashes collide
                open_ = np.flatnonzero(low + step < high)
                same = open_[(ids[low[open_] + step] == windows[open_]).all(axis=1)]
                np.add.at(edge, at[same], 1)
                np.add.at(edge, at[same] + length, -1)
                text = np.searchsorted(start, at[same], side="right") - 1
                names += [(t, x) for t, k in set(zip(text.tolist(), (low[same] + step).tolist(), strict=True)) for x in items[k]]
        return start, np.cumsum(edge)[:-1] > 0, names


def _items(bench: DataFrame) -> DataFrame:
    """Distinct (i, t) of item ids and texts."""
    return bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).distinct()


def _n_blocks(items: DataFrame, most: int) -> int:
    return -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // (6 * most)) or 1


def _block(items: DataFrame, k: int, n: int, size: int) -> Windows:
    """The windows of the k-th of n blocks, of about BLOCK_WORDS item words: a bounded collect."""
    rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
    return Windows([(r["i"], bytes(r["t"]) if r["t"] is not None else None) for r in rows], size)


_HITS = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def _scan(df: DataFrame, at: int, shared, hit_only: bool = False) -> DataFrame:
    """df (with plain column names) and _HITS of its at-th column, the text, which with hit_only goes, as do rows without a hit."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    names = [n for k, n in enumerate(df.columns) if not (hit_only and k == at)]
    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes if n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 500):
                b = whole.slice(cut, 500)
                texts = [words_of(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
                start, hit, found = shared.value.scan(texts)
                spans, items = [[] for _ in texts], [set() for _ in texts]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                for a, z in edges.reshape(-1, 2).tolist():
                    t = int(np.searchsorted(start, a, side="right")) - 1
                    spans[t].append({"start": a - int(start[t]), "stop": z - int(start[t])})
                for t, x in found:
                    items[t].add(x)
                out = pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([len(w) for w in texts], pa.int64()), pa.array(spans, kind),
                                                  pa.array([sorted(i) for i in items], pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])
                yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hit_only else out

    return df.mapInArrow(run, f"{fields}, {_HITS}")


def _passes(keyed: DataFrame, items: DataFrame, n: int, size: int) -> DataFrame:
    """(_row, spans, items) of the rows of keyed (_row, text) that any block hits; a pass a block."""
    parts = []
    for k in range(n):
        shared = keyed.sparkSession.sparkContext.broadcast(_block(items, k, n, size))
        parts.append(written(_scan(keyed, 1, shared, hit_only=True).select("_row", "spans", "items")))
        shared.destroy()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return hits.select("_row", joined("spans").alias("spans"), "items")


def mark(docs: DataFrame, bench: DataFrame, size: int = SIZE, text_col: str = "text", out: str = "hits", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with one more struct column `out`: n_words, spans of hit words [start, stop), items with occurring windows (sorted)."""
    out = free_name(docs, out)
    at = docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]
    df, items = docs.toDF(*names), _items(bench)
    n = _n_blocks(items, block_words)
    if n == 1:
        df = _scan(df, at, docs.sparkSession.sparkContext.broadcast(_block(items, 0, 1, size)))
    else:
        df = written(df.withColumn("_row", F.monotonically_increasing_id()))
        hits = _passes(df.select("_row", names[at]), items, n, size)
        words = F.array_remove(F.split(F.coalesce(names[at], F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        df = df.join(hits, "_row", "left").select(*names, F.size(words).cast("long").alias("n_words"), none("spans", "array<struct<start:int,stop:int>>"), none("items", "array<string>"))
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], F.struct("n_words", "spans", "items").alias(out))


def joined(spans: Column | str) -> Column:
    """Sorted spans, with those that meet made one."""
    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(last["stop"] >= s["start"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,stop:int>>"), step)


def without_spans(text: Column, spans: Column) -> Column:
    """The text less the words of joined spans and what stands between them."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def cut(p: Column) -> Column:
        gone = lambda k: F.exists(spans, lambda s: (s["start"] <= k) & (k < s["stop"]))
        hit = let(F.transform(p["gaps"], lambda g, k: gone(k)), lambda h: F.array_join(F.transform(p["gaps"], lambda g, k: F.concat(
            F.when(F.get(h, k) & (k > 0) & F.coalesce(F.get(h, k - 1), F.lit(False)), "").otherwise(g),
            F.when(F.get(h, k), "").otherwise(F.coalesce(F.get(p["words"], k), F.lit(""))))), ""))
        return hit

    return let(F.struct(F.split(text, word, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words")), cut)


def remove(docs: DataFrame, bench: DataFrame, how: str = "documents", size: int = SIZE) -> DataFrame:
    """docs without contamination: how is `documents` (those with a hit go) or `spans` (hit words go, n_chars follows if there)."""
    out = free_name(docs, "hits")
    marked = mark(docs, bench, size)
    if how == "documents":
        return marked.where(F.size(F.col(out)["spans"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.when(F.size(F.col(out)["spans"]) > 0, without_spans(F.col("text"), F.col(out)["spans"])).otherwise(F.col("text"))
    df = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size(F.col(out)["spans"]) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir) -> DataFrame:
    """op5: hit words and items of every document."""
    h = F.col("hits")
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]).cast("long"))
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", h["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
                         F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), i AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[k:k + 9], ' ') AS gram
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, least(len(words), 1)) + 1)) AS k FROM i)
), dw AS (
    SELECT doc_id, k, size, array_to_string(words[k:k + size - 1], ' ') AS gram
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM w, (SELECT DISTINCT size FROM iw) WHERE len(words) >= size)
), m AS (
    SELECT doc_id, k, size, item_id FROM dw JOIN iw USING (size, gram)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
