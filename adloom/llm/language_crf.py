"""Language identification by a linear-chain conditional random field over the words of code-switched text.

Each word has hashed affix and byte n-gram features, and lexicon features: the share of each language among the word's
occurrences in the training documents, and whether it has none. A weight per feature and language and a weight per pair
of neighbouring languages are learned together by gradient steps on the log likelihood of code-switched training
sequences, with the marginals that forward-backward gives. The same forward-backward labels the words of a text; a
document's language is that with the largest share of its words.

Training takes about `max_docs` documents of each language (chosen by hash, at a rate set from the counts of all
documents) and at most `max_langs` languages, and `WINDOWS` runs of `RUN` words of each. Sequences are strung together from runs of several languages. The
lexicon counts all words of those documents in Spark and holds the `lexicon` most frequent; while the weights are
learned each word counts as unknown half of the time, so that the other features learn to do without it.

Cases: null text and text without a letter are `und` with score 0; a null doc_id is neither learned from nor held out;
null lang is not learned, nor is one beyond the `max_langs` with the most rows; a repeated doc_id is learned from once; repeated rows each get a row; with nothing to learn all are `und`; an empty table gives an empty
result; other columns are carried by `predict` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import TEXT_ROWS, free_name, table, written

MAX_DOCS, WINDOWS, RUN, LENGTH, LEXICON, MAX_LANGS = 400, 4, 40, 60, 20_000, 200
BUCKETS = 1 << 16
KEEP = 300_000
UNKNOWN = "und"
_CLEAN = bytes(c if c > 0x7F or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters: lower-cased UTF-8, cut at all ASCII but letters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_CLEAN).split()


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h.astype(np.uint64) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every hashed feature: the first and last 1 to 3 bytes of a word, and its 3-byte grams with its ends marked."""
    n = len(words)
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    stop = np.cumsum(size)
    start = stop - size
    who, what = [], []
    gram = flat[:-2] | flat[1:-1] << np.uint64(8) | flat[2:] << np.uint64(16)
    owner = np.repeat(np.arange(n), size)
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    who.append(owner[inside])
    what.append(_mix(gram[inside], 2))
    for k in (1, 2, 3):
        long = np.flatnonzero(size - 2 >= k)
        for kind, at in ((2 + k, start[long] + 1), (5 + k, stop[long] - 1 - k)):
            h = np.zeros(len(long), np.uint64)
            for j in range(k):
                h = h << np.uint64(8) | flat[at + j]
            who.append(long)
            what.append(_mix(h, kind))
    return np.concatenate(who), np.concatenate(what)


@dataclass
class Lexicon:
    """Languages' shares of words: share is (words, langs); a word without an entry has only the last feature."""

    words: dict[bytes, int] = field(default_factory=dict)
    share: np.ndarray | None = None

    def features(self, words: list[bytes], n: int) -> np.ndarray:
        """(words, n + 1): shares of n languages less their mean, then 1 for words that are not there."""
        out = np.zeros((len(words), n + 1))
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[:, n] = at < 0
        if self.share is not None:
            out[at >= 0, :n] = self.share[at[at >= 0]] - 1 / n
        return out


def lexicon_of(counts: dict[bytes, dict[str, int]], langs: list[str]) -> Lexicon:
    """From occurrences of words in each language; each language's counts are taken relative to all of its own."""
    if not counts:
        return Lexicon()
    told = np.array([[c.get(k, 0) for k in langs] for c in counts.values()], float)
    relative = told / np.maximum(1, told.sum(axis=0))
    return Lexicon({w: k for k, w in enumerate(counts)}, relative / np.maximum(1e-300, relative.sum(axis=1, keepdims=True)))


@dataclass
class Field:
    """langs; weight: (BUCKETS, langs) of hashed features; step: (langs, langs) from one word's language to the next one's; entry: (langs + 1, langs) of lexicon features."""

    langs: list[str]
    weight: np.ndarray
    step: np.ndarray
    entry: np.ndarray
    lexicon: Lexicon
    known: dict[bytes, int] = field(default_factory=dict)
    told: np.ndarray | None = None

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores (words, langs): sums of feature weights."""
        who, what = features(words)
        hashed = np.stack([np.bincount(who, self.weight[what, k], len(words)) for k in range(len(self.langs))], axis=1)
        return hashed + self.lexicon.features(words, len(self.langs)) @ self.entry

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """Rows of `told` for words; new words are scored together, and all are forgotten when there are too many."""
        if len(self.known) > KEEP:
            self.known, self.told = {}, None
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            scores = self.emissions(new)
            self.told = scores if self.told is None else np.concatenate([self.told, scores])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def messages(emission: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission factors, forward and backward messages (words, langs; each scaled) of sequences laid end to end.

    All sequences take their k-th word at once, in the order of length, so that those still open are the first ones.
    """
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    open_ = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # how many are longer than k
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    a = np.exp(step - step.max())
    forward, backward = np.empty_like(e), np.empty_like(e)
    for k, n in enumerate(open_):
        at = start[:n] + k
        now = e[at] if k == 0 else e[at] * (forward[at - 1] @ a)
        forward[at] = now / now.sum(axis=1, keepdims=True)
    backward[(np.cumsum(sizes) - 1)[sizes > 0]] = 1
    for k in range(len(open_) - 2, -1, -1):
        at = start[:open_[k + 1]] + k
        now = (e[at + 1] * backward[at + 1]) @ a.T
        backward[at] = now / now.sum(axis=1, keepdims=True)
    return e, forward, backward


def forward_backward(emission: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marginals (words, langs) of sequences laid end to end."""
    _, forward, backward = messages(emission, step, sizes)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def fit(runs: list[tuple[str, list[bytes]]], counts: dict[bytes, dict[str, int]] | None = None, rounds: int = 12, batch: int = 200, rate: float = 0.05, ridge: float = 1e-4, seed: int = 7) -> Field:
    """A field from (language, words) runs, and the occurrences of words by language for its lexicon."""
    runs = [(lang, w) for lang, w in runs if w]
    langs = sorted({lang for lang, _ in runs})
    crf = Field(langs, np.zeros((BUCKETS, len(langs))), np.zeros((len(langs), len(langs))), np.zeros((len(langs) + 1, len(langs))), lexicon_of(counts or {}, langs))
    if len(langs) < 2:
        return crf
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    coded = [(langs.index(lang), np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w])) for lang, w in runs]
    by_lang = [[w for k, w in coded if k == n] for n in range(len(langs))]
    who, what = features(list(vocabulary))
    entries, unknown = crf.lexicon.features(list(vocabulary), len(langs)), np.append(np.zeros(len(langs)), 1.0)
    learned = (crf.weight, crf.step, crf.entry)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in learned]
    t = 0
    for _ in range(rounds):
        for _ in range(max(1, len(coded) // batch)):
            words, tags, sizes = [], [], []
            for _ in range(batch):
                n = 0
                while n < LENGTH:
                    k = int(rng.integers(len(langs)))
                    w = by_lang[k][int(rng.integers(len(by_lang[k])))]
                    cut = int(rng.integers(3, RUN + 1))
                    w = w[:cut]
                    words.append(w)
                    tags.append(np.full(len(w), k))
                    n += len(w)
                sizes.append(n)
            w, y, sizes = np.concatenate(words), np.concatenate(tags), np.array(sizes)
            told = np.stack([np.bincount(who, crf.weight[what, k], len(vocabulary)) for k in range(len(langs))], axis=1)
            entry = np.where(rng.random((len(vocabulary), 1)) < 0.5, entries, unknown)
            told += entry @ crf.entry
            emission = told[w]
            e, forward, backward = messages(emission, crf.step, sizes)
            p = forward * backward
            p /= p.sum(axis=1, keepdims=True)
            off = p - np.eye(len(langs))[y]
            by_word = np.stack([np.bincount(w, off[:, k], len(vocabulary)) for k in range(len(langs))], axis=1)
            g_weight = np.stack([np.bincount(what, by_word[who, k], BUCKETS) for k in range(len(langs))], axis=1) / len(w) + ridge * crf.weight
            inner = np.ones(len(w), bool)
            inner[np.cumsum(sizes) - 1] = False
            at = np.flatnonzero(inner)
            pair = np.exp(crf.step)[None] * forward[at][:, :, None] * (e[at + 1] * backward[at + 1])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros_like(crf.step)
            np.add.at(seen, (y[at], y[at + 1]), 1)
            g_step = (pair.sum(axis=0) - seen) / len(w) + ridge * crf.step
            g_entry = entry.T @ by_word / len(w) + ridge * crf.entry
            t += 1
            for value, g, (m, v) in zip(learned, (g_weight, g_step, g_entry), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return crf


def train(docs: DataFrame, use: Column | None = None, max_docs: int = MAX_DOCS, lexicon: int = LEXICON, max_langs: int = MAX_LANGS, **shape) -> Field:
    """A field learned from text and lang of the documents that `use` admits: at most max_langs languages, those with the most rows, and about max_docs documents of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if use is None else use))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not counts:
        return fit([])
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, max_docs / n))])
    chosen = usable.where(F.col("lang").isin(*counts)).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (rate[F.col("lang")] * (1 << 30)))
    words = F.array_remove(F.split(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+"), "")
    told = chosen.select("doc_id", F.struct("lang", words.alias("w")).alias("r")).where(F.size("r.w") > 0)
    once = written(told.groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.lang", "r.w"), TEXT_ROWS)  # a row a doc_id, however often it is repeated
    last = F.greatest(F.size("w") - RUN, F.lit(0)) + 1
    runs = F.array(*[F.slice("w", F.pmod(F.xxhash64("doc_id", F.lit(k)), last).cast("int") + 1, RUN) for k in range(WINDOWS)])
    rows = once.select("doc_id", "lang", F.explode(runs).alias("run")).toPandas()
    rows = rows.sort_values(["doc_id", "lang"], kind="stable")
    seen = once.select("lang", F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("lang") == k).alias(f"n{i}") for i, k in enumerate(counts)])
    often = seen.orderBy(F.desc("n"), "word").limit(lexicon).collect()
    by_word = {r["word"].encode(): {k: r[f"n{i}"] for i, k in enumerate(counts)} for r in often}
    return fit([(lang, [x.encode() for x in run]) for lang, run in zip(rows["lang"], rows["run"], strict=True)], by_word, **shape)


def label(texts: list[str | None], crf: Field) -> list[tuple[str, float]]:
    """Language and its share of words of each text."""
    words = [words_of(t) for t in texts]
    open_ = [bool(w) and bool(crf.langs) and (any(x[0] < 0x80 for x in w) or any(map(str.isalpha, t))) for t, w in zip(texts, words, strict=True)]
    sizes = np.array([len(w) for w, o in zip(words, open_, strict=True) if o], np.int64)
    flat = [x for w, o in zip(words, open_, strict=True) if o for x in w]
    out = [(UNKNOWN, 0.0)] * len(texts)
    if flat:
        at = crf.numbered(flat)
        p = forward_backward(crf.told[at], crf.step, sizes)
        share = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        best = share.argmax(axis=1)
        for k, b, s in zip(np.flatnonzero(open_).tolist(), best.tolist(), share.max(axis=1).tolist(), strict=True):
            out[k] = (crf.langs[b], min(1.0, s))
    return out


def predict(docs: DataFrame, crf: Field, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with one more struct column `out`: lang and score."""
    shared = docs.sparkSession.sparkContext.broadcast((crf.langs, crf.weight.astype(np.float32), crf.step, crf.entry, crf.lexicon))

    @F.pandas_udf("lang string, score double")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Field(*shared.value)
        for texts in parts:
            rows = [x for at in range(0, len(texts), 1000) for x in label(texts.iloc[at:at + 1000].tolist(), own)]
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], told(F.col(f"`{text_col}`")).alias(free_name(docs, out)))


def query(spark, sf_dir) -> DataFrame:
    """op9: language and score of every document; a third is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    told = predict(docs.select("doc_id", "text"), train(docs, fold != 1))
    return told.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.col("language")["lang"].alias("lang_pred"), F.col("language")["score"].alias("score"))
