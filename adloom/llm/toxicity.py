"""Toxicity by compression distance: what a toxic dictionary compresses better than an ordinary one.

Two zstandard dictionaries are learned from labelled documents: the ordinary one holds the words that most ordinary documents
use, the toxic one the words of toxic documents that start with a telling piece (`telling`). A text is cut into windows, each
compressed with both; its margin is the ordinary length less the toxic one. The document's three greatest margins and its
number of windows are weighed by a logistic curve fitted to the labelled documents, which turns lengths into thresholds.

A window is a run of up to `LONGEST` letters between its bounds. Before it is compressed, each byte is written as `WIDE` bytes
of a fixed code: zstandard tells lengths in whole bytes and a match costs it about four, so that in plain bytes a match of a
short word would hardly show. A window is one run as those repeat, so that each distinct one is compressed once in a while;
windows of two or three words, in plain bytes and with trained dictionaries, told documents worse (see the README).

Learning takes at most `max_rows` labelled documents, those with the smallest hashes; their words are counted in Spark, and
the driver gets at most `MAX_WORDS` toxic and `ORDINARY` ordinary words, and four numbers a document for the curve.

Cases: a null text is an empty one, which has no window and the score that the curve gives to none; a null doc_id is not held
out and takes no part in learning; labels that are null or not 0 or 1 are ignored, a doc_id with several counts as toxic if
one says so, one with several texts with the least; with labels of one class or none every score is their smoothed share;
repeated rows are each scored; other columns are carried by `score`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import TEXT_ROWS, free_name, table, written

MAX_ROWS, THRESHOLD = 20_000, 0.5
LONGEST, WIDE, LEVEL = 24, 4, 16
#: Words of the dictionaries; letters of a piece; documents, test value (G²) and odds that make a piece telling.
ORDINARY, MAX_WORDS, PIECE, LEAST, TELLING, ODDS = 3000, 2000, (3, 14), 3, 24.0, 20.0
#: Margins below this are this; distinct windows that a task remembers; characters of texts that are looked at together.
FLOOR, REMEMBERED, TOGETHER = -8, 400_000, 2_000_000


@dataclass
class Model:
    """Contents of the dictionaries, and the curve over (three margins, log of windows); without contents only its bias counts."""

    ordinary: list[str]
    toxic: list[str]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(((x - self.mean) / self.scale) @ self.weights[:4] + self.weights[4])))


def code() -> np.ndarray:
    """WIDE bytes for each byte: a mix of its value, the same everywhere."""
    h = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h.view(np.uint8).reshape(256, 8)[:, :WIDE].copy()


class Margins:
    """Margins of texts, in a task."""

    def __init__(self, model: Model) -> None:
        import regex

        self.windows_of = regex.compile(rf"\p{{L}}{{1,{LONGEST}}}").findall
        self.code, self.known = code(), {}
        self.ordinary, self.toxic = (self._compressor(w) for w in (model.ordinary, model.toxic))

    def _wide(self, window: str) -> bytes:
        return self.code[np.frombuffer(f" {window} ".encode(), np.uint8)].tobytes()

    def _segments(self, windows: list[str]):
        """The wide forms of windows as pieces of one buffer; neighbours share the bound between them."""
        import zstandard

        raw = [w.encode() for w in windows]
        size = np.fromiter(map(len, raw), np.uint64, len(raw))
        start = np.cumsum(size + np.uint64(1)) - size - np.uint64(1)
        data = self.code[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)].tobytes()
        return zstandard.BufferWithSegments(data, (np.stack([start, size + np.uint64(2)], axis=1) * np.uint64(WIDE)).tobytes())

    def _compressor(self, words: list[str]):
        import zstandard

        content = zstandard.ZstdCompressionDict(b"".join(map(self._wide, words)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shape = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=64, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        content.precompute_compress(compression_params=shape)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=shape)

    def learn(self, windows: set[str]) -> None:
        """Compress windows that are not remembered, all in one call: a call has a cost of its own."""
        new = list(windows - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(windows)
        if new:
            wide = self._segments(new)
            a, b = (c.multi_compress_to_buffer(wide, threads=1) for c in (self.ordinary, self.toxic))
            self.known.update(zip(new, (len(a[k]) - len(b[k]) for k in range(len(new))), strict=True))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """(texts, 4): the three greatest margins and the log of the number of windows."""
        out, at = np.full((len(texts), 4), float(FLOOR)), 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < TOGETHER):
                size, stop = size + len(texts[stop] or ""), stop + 1
            found = [self.windows_of((t or "").lower()) for t in texts[at:stop]]
            self.learn(set().union(*found))
            for row, windows in zip(out[at:stop], found, strict=True):
                margins = np.fromiter(map(self.known.__getitem__, windows), np.int64, len(windows))
                top = np.sort(np.partition(margins, -3)[-3:] if len(margins) > 3 else margins)[::-1]
                row[:len(top)] = np.maximum(top, FLOOR)
                row[3] = np.log(max(1, len(windows)))
            at = stop
        return out


def features(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """docs with a column `out`, an array of the four numbers of Margins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margins = Margins(shared.value) if shared.value.toxic else None
        for texts in parts:
            rows = margins(texts.where(texts.notna(), None).tolist()) if margins else np.zeros((len(texts), 4))
            yield pd.Series(list(rows), dtype=object)

    return docs.withColumn(out, run.asNondeterministic()(F.col(f"`{text_col}`")))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, use: Column | None) -> DataFrame:
    """(key, toxic, text) of the labelled documents that serve to learn, a row a doc_id."""
    chosen = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if use is None else use))
              .groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(max_rows))
    found = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    return written(found.groupBy("key", "toxic").agg(F.min("text").alias("text")), TEXT_ROWS)


def _signed(a: Column, b: Column, n: int, m: int) -> tuple[Column, Column]:
    """(G², odds) of a of n toxic and b of m ordinary documents."""
    share = (a + b) / (n + m)
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g = 2 * (cell(a, share * n) + cell(b, share * m) + cell(n - a, (1 - share) * n) + cell(m - b, (1 - share) * m))
    return g, (a + 0.5) / (b + 0.5) * (m / n)


def dictionaries(sample: DataFrame) -> Model:
    """The words of both dictionaries, the most frequent last, where matches cost least; from rows of labelled()."""
    n, m = (sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first())
    if not n or not m:
        return Model([], [])
    least, most = PIECE
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{LONGEST}}}"), F.lit(0)))
    pieces = lambda w: F.transform(F.sequence(F.lit(least), F.least(F.length(w), F.lit(most))), lambda k: F.substring(w, F.lit(1), k))
    rows = written(sample.select("toxic", words.alias("words")))
    counted = lambda df: df.groupBy("x").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    of_words = written(counted(rows.select("toxic", F.explode("words").alias("x"))))
    long = F.filter("words", lambda w: F.length(w) >= least)
    of_pieces = counted(rows.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(long, pieces)))).alias("x")))
    g, odds = _signed(F.col("a"), F.col("b"), n, m)
    telling = of_pieces.where((F.col("a") >= LEAST) & (g > TELLING) & (odds >= ODDS)).select(F.col("x").alias("piece"), g.alias("g")).orderBy(F.desc("g"), "piece").limit(MAX_WORDS)
    started = of_words.where((F.col("a") > 0) & (F.length("x") >= least)).select("x", "a", F.explode(pieces(F.col("x"))).alias("piece"))
    toxic = started.join(F.broadcast(telling), "piece").groupBy("x").agg(F.max("a").alias("a")).orderBy(F.desc("a"), "x").limit(MAX_WORDS)
    ordinary = of_words.where("b > 0").orderBy(F.desc("b"), "x").limit(ORDINARY)
    told = lambda df: [r["x"] for r in df.select("x").collect()][::-1]
    return Model(told(ordinary), told(toxic))


def fit(model: Model, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Model:
    """The curve of the model by Newton steps."""
    if not len(y) or y.min() == y.max() or not model.toxic:
        bias = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return Model([], [], weights=np.array([0.0, 0.0, 0.0, 0.0, bias]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(5)
    for _ in range(40):
        p = 1 / (1 + np.exp(-(z @ w)))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(5), z.T @ (y - p) - ridge * w)
    return Model(model.ordinary, model.toxic, mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, use: Column | None = None) -> Model:
    """Dictionaries and curve learned from labels.toxic; `use` is a condition on labels."""
    sample = labelled(docs, labels, max_rows, use)
    model = dictionaries(sample)
    rows = features(sample, model, "text", "x").select("key", "toxic", "x").toPandas().sort_values("key")
    return fit(model, np.array(rows["x"].tolist(), float).reshape(-1, 4), rows["toxic"].to_numpy(float))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with one more column `out`: the probability of being toxic."""
    x, out = free_name(docs, "_margins"), free_name(docs, out)
    z = F.lit(float(model.weights[4]))
    for k in range(4):
        z = z + (F.col(x)[k] - float(model.mean[k])) / float(model.scale[k]) * float(model.weights[k])
    return features(docs, model, text_col, x).withColumn(out, 1 / (1 + F.exp(-z))).drop(x)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """The documents that score below the threshold; columns as in docs."""
    out = free_name(docs, "toxicity")
    return score(docs, train(docs, labels, **training)).where(F.col(out) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir) -> DataFrame:
    """op13: score and prediction of every document; a fifth is held out from learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = score(docs.select("doc_id", "text"), train(docs, labels, use=fold != 0))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
