"""Statistics of whole texts as Spark expressions; every value is computed in the JVM, one row at a time, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.llm.common import ASCII_SPACE, let

WINDOW = 8

#: Ratios a learner may use, in this order.
FEATURES = (
    "n_words", "mean_word_chars", "symbols_per_word", "pipes_per_word", "bangs_per_word", "stops_per_word",
    "upper_share", "distinct_share", "repeat_share", "dup_line_share", "words_per_line", "digits_per_word",
)


def words_of(text: Column) -> Column:
    """`[^\\x20\\x09-\\x0D]+` words in order; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that occur at least twice.

    Windows are compared by a 64-bit hash. Only a text with an equal pair is sorted by (hash, start): equal
    neighbours are repeats, and each repeat adds the words up to the next one's start, `size` at most.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        starts = let(pairs, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, i: F.when(same(s, i, i + 1) | ((i > 0) & same(s, i, i - 1)), x["i"])),
            lambda x: x.isNotNull())))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(size)), F.lit(size))),
            F.lit(0), lambda a, x: a + x))

    def look(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))

    return F.when(F.size(words) > size, look(words)).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of counts of one text. Null counts as the empty text.

    n_words, word_chars (code points in words), n_symbols (`#*$%&|<>`), n_lines and n_dup_lines (newline-split lines
    with a word; those equal to an earlier one), n_repeat_words, and counts that only the learned rules read.
    """
    text = F.coalesce(text, F.lit(""))
    gone = lambda t, chars: (F.octet_length(t) - F.octet_length(F.regexp_replace(t, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(F.struct(let(words_of(text), counts).alias("w"), by_lines.alias("l")), lambda s: F.struct(
        *[s["w"][c].alias(c) for c in ("n_words", "word_chars", "n_distinct", "n_repeat_words")],
        *[s["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")],
        gone(text, r"[#*$%&|<>]+").alias("n_symbols"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("|"), F.lit("")))).cast("long").alias("n_pipes"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        gone(text, r"[.,;:?]+").alias("n_stops"),
        gone(text, r"[A-Z]+").alias("n_upper"),
        gone(text, r"[0-9]+").alias("n_digits"),
    ))


def features(s: Column) -> list[Column]:
    """The ratios named in FEATURES, from a statistics() struct; texts without words get zeros."""
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
    n = s["n_words"]
    values = (
        n.cast("double"), per(s["word_chars"], n), per(s["n_symbols"], n), per(s["n_pipes"], n), per(s["n_bangs"], n),
        per(s["n_stops"], n), per(s["n_upper"], s["word_chars"]), per(s["n_distinct"], n), per(s["n_repeat_words"], n),
        per(s["n_dup_lines"], s["n_lines"]), per(n, s["n_lines"]), per(s["n_digits"], n),
    )
    return [v.alias(name) for v, name in zip(values, FEATURES, strict=True)]
