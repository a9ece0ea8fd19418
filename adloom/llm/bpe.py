"""BPE encoding and decoding with a public word-end vocabulary, by batched numpy merge rounds.

Texts go through Arrow in batches. Each batch is cut to pre-tokens; those not met before by the task are merged together:
their symbols lie in one flat array, each round looks all neighbouring pairs up by binary search in the sorted pair keys,
takes each word's lowest rank, and merges all of its places at once. A result whose token is part of an earlier-ranked
merge is merged at its leftmost place only, so that the order is that of one merge at a time. A task keeps what it learned
of up to `KEEP` distinct pre-tokens.

Cases: null text is the empty text (no tokens, empty decoded text); the strings of special tokens in a text become their
ids; repeated rows and null ids each keep their row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import table

KEEP, SLICE = 250_000, 500
NONE = np.int64(1 << 40)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else 256 onwards in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Vocabulary:
    """Arrays of a tokenizer file; made once on the driver and sent to the tasks (bounded: a few MB)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(self.tokens)
        left, right, made = (np.array([ids[x] for x in col], np.int64) for col in zip(*[(a, b, a + b) for a, b in pairs], strict=True))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        earliest = np.full(self.size, NONE)
        for side in (left, right):
            np.minimum.at(earliest, side, np.arange(len(pairs)))
        self.alone = earliest[made] < np.arange(len(pairs))  # merges to be done one place at a time


def merge(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all words laid end to end, and how many each has."""
    sizes = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym = v.first[flat]
    ends = np.cumsum(sizes) - 1
    sym[ends] = v.last[flat[ends]]
    word = np.repeat(np.arange(len(words)), sizes)
    done_sym, done_word = [], []
    while len(sym):
        key = sym[:-1] * v.size + sym[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.append(np.where((v.keys[at] == key) & (word[:-1] == word[1:]), v.ranks[at], NONE), NONE)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        low = np.repeat(lowest, np.diff(np.append(starts, len(sym))))
        over = low == NONE
        done_sym.append(sym[over])
        done_word.append(word[over])
        hit = (rank == low) & ~over
        places = np.flatnonzero(hit)
        if len(places):
            # places that overlap (a pair of equal symbols): every other one from the left
            run = np.append(True, (np.diff(places) != 1))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            take = (np.arange(len(places)) - begin) % 2 == 0
            first_of_word = np.append(True, word[places][1:] != word[places][:-1])
            take &= ~v.alone[rank[places]] | first_of_word
            places = places[take]
            sym[places] = v.made[rank[places]]
            over[places + 1] = True
        sym, word = sym[~over], word[~over]
    sym, word = np.concatenate([np.zeros(0, np.int64), *done_sym]), np.concatenate([np.zeros(0, np.int64), *done_word])
    return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


#: Unicode white space.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Latin letters; texts with no other letter or number outside ASCII need no Unicode tables.
_LATIN = "a-zªµºß-öø-ÿĀ-ɏ"
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_ODD = re.compile(rf"[^\x00-\x7f{_LATIN}×÷«»¿¡°§©®·\xa0‐-‧‰-⁞€]")
_PLAIN = re.compile(rf"{_CONTRACTED}|[{_LATIN}]+|[0-9]|[^{_SPACE}0-9{_LATIN}]+")


def normalized(text: str) -> str:
    """Composed and lower case, each character by itself (a final sigma is no special case)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Encoder:
    """Texts to ids within a task."""

    def __init__(self, v: Vocabulary) -> None:
        import regex

        self.v = v
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")")
        self.full = regex.compile(rf"{_CONTRACTED}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.reset()

    def reset(self) -> None:
        """Forget all pre-tokens but the special ones. `known` numbers them; the ids of number k are flat[start[k]:][:count[k]]."""
        special = [*self.v.special.items()]
        self.known = {"\0" + t: k for k, (t, _) in enumerate(special)}
        self.flat = np.array([i for _, i in special], np.int64)
        self.start, self.count = np.arange(len(special)), np.ones(len(special), np.int64)

    def words(self, text: str) -> list[str]:
        """Pre-tokens; a special token is its string after a NUL."""
        parts = self.split.split(text) if "<|" in text else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\0" + part)
            elif part:
                part = normalized(part)
                out += (self.full if _ODD.search(part) else _PLAIN).findall(part)
        return out

    def learn(self, words: list[str]) -> None:
        ids, counts = merge([w.encode("utf-8", "surrogatepass") for w in words], self.v)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        words = [self.words(t or "") for t in texts]
        if len(self.known) > KEEP:
            self.reset()
        every = [w for own in words for w in own]
        at = list(map(self.known.get, every))
        if None in at:
            self.learn(list(dict.fromkeys(w for w, k in zip(every, at, strict=True) if k is None)))
            at = list(map(self.known.__getitem__, every))
        at = np.array(at, np.int64)
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.append(0, ends)[np.cumsum([len(w) for w in words])]
        for a, z in zip([0, *stops.tolist()], stops.tolist(), strict=False):
            yield ids[a:z]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens as the vocabulary shows them, one space between."""
        return " ".join(map(self.v.tokens.__getitem__, ids.tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_tokens, token ids and decoded text of every whole text; with digest the last two as SHA-256 instead. Other columns of docs do not come along."""
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):  # piece by piece: ids and decoded texts are larger than the texts
                part = whole.slice(at, SLICE)
                ids = list(encoder.encode(part["_text"].to_pylist()))
                shown = [encoder.decode(i) for i in ids]
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                if digest:
                    a = pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string())
                    b = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown], pa.string())
                else:
                    a = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), np.concatenate(ids))
                    b = pa.array(shown, pa.string())
                yield pa.RecordBatch.from_arrays([part["_id"], pa.array(counts), a, b], ["_id", "n_tokens", "a", "b"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        run, f"_id {kind}, n_tokens bigint, a {'string' if digest else 'array<bigint>'}, b string")
    return out.select(F.col("_id").alias(id_col), "n_tokens", F.col("a").alias("ids_sha256" if digest else "ids"), F.col("b").alias("decoded_sha256" if digest else "decoded"))


def query(spark, sf_dir) -> DataFrame:
    """op4: digests of ids and of the decoded text."""
    return encode(table(spark, sf_dir, "documents"), digest=True)
