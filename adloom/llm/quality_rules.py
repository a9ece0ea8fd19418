"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark conditional expression.

Everything runs as DataFrame code. Learning takes a bounded sample of labelled rows (`max_rows`), bins the text
statistics at class quantiles, and then grows one conjunction after another from grouped counts of bins:

* grow: on two thirds of the sample, the condition with the best FOIL gain joins the conjunction until it covers no
  good row or has `max_conditions`;
* prune: on the other third, trailing conditions go while (bad - good) / (bad + good) does not get worse;
* accept: the rule stays if at least `min_bad` bad rows and `min_precision` of all rows it covers are bad. Covered rows
  leave the sample and the next rule is grown on the rest.

Cases: null text is the empty text; null doc_id rows are judged like others; repeated rows each get a row; labels that
are null or not 0/1 are ignored, a doc_id with several labels counts with the lowest; with no usable labels the list is
empty and only the base rule acts; an empty table gives an empty result; other columns are carried by `judge` only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import free_name, let, written
from adloom.llm.textstats import FEATURES, features, statistics

MAX_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, features: Column) -> Column:
        value = features[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, use: Column | None = None) -> DataFrame:
    """Statistics and label (bad = 1) of the max_rows labelled documents with the smallest hashes, a row a doc_id; `use` tells which labels may serve.

    Of rows that repeat a doc_id the one with the least statistics counts; maps combine them, so that a repeated id stays one row.
    """
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if use is None else use))
              .groupBy(F.col("doc_id").alias("_key")).agg((1 - F.min("quality")).alias("_bad"))
              .orderBy(F.xxhash64("_key"), "_key").limit(max_rows))
    found = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text")).join(F.broadcast(chosen), "_key")
    told = let(statistics(F.col("_text")), lambda s: F.struct(*features(s)))
    once = found.select("_key", "_bad", told.alias("_f")).groupBy("_key").agg(F.min("_bad").alias("_bad"), F.min("_f").alias("_f"))
    return written(once.select("_key", "_bad", "_f.*"))


def _thresholds(sample: DataFrame) -> list[list[float]]:
    """Per feature, the sorted distinct quantiles of either class and the middles between them."""
    at = [i / 20 for i in range(1, 20)] + [0.01, 0.99]
    rows = sample.groupBy("_bad").agg(*[F.percentile_approx(f, at, 1000).alias(f) for f in FEATURES]).collect()  # two rows
    cuts = [sorted({x for r in rows for x in (r[f] or [])}) for f in FEATURES]
    return [sorted({*c, *((a + b) / 2 for a, b in zip(c, c[1:], strict=False))}) for c in cuts]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_rules: int = 8, max_conditions: int = 3,
          min_precision: float = 0.95, min_bad: int = 5) -> list[Rule]:
    """The ordered rules; a document that any of them covers is rejected."""
    sample = labelled_sample(docs, labels, max_rows)
    cuts = _thresholds(sample)
    below = lambda f, c: F.size(F.filter(F.array(*map(F.lit, c)), lambda t: t < F.col(f))) if c else F.lit(0)
    bins = F.array(*[below(f, c) for f, c in zip(FEATURES, cuts, strict=True)])
    left = written(sample.select("_bad", (F.pmod(F.xxhash64("_key"), F.lit(3)) == 0).alias("_prune"), bins.alias("_bins")).coalesce(1))

    def test(part: list[tuple[int, bool, int]]) -> Column:
        """A conjunction over bins: value > cut b-1 is bin >= b."""
        out = F.lit(True)
        for f, above, b in part:
            out = out & ((F.col("_bins")[f] >= b) if above else (F.col("_bins")[f] < b))
        return out

    rules: list[Rule] = []
    while len(rules) < max_rules:
        part: list[tuple[int, bool, int]] = []
        while len(part) < max_conditions:
            counted = (left.where(test(part) & ~F.col("_prune")).select("_bad", F.posexplode("_bins").alias("f", "b"))
                       .groupBy("f", "b").agg(F.sum("_bad").alias("bad"), F.count("*").alias("n")).collect())  # features x bins
            bad = sum(r["bad"] for r in counted if r["f"] == 0)
            total = sum(r["n"] for r in counted if r["f"] == 0)
            if bad == 0 or bad == total:
                break
            gains = {}
            for f, cut in enumerate(cuts):
                rows = [(r["b"], r["bad"], r["n"]) for r in counted if r["f"] == f]
                for b in range(1, len(cut) + 1):
                    for above in (True, False):
                        p = sum(y for x, y, _ in rows if (x >= b) == above)
                        n = sum(z for x, _, z in rows if (x >= b) == above)
                        if p and n < total:
                            gains[f, above, b] = p * (log2(p / n) - log2(bad / total))
            if not gains or max(gains.values()) <= 0:
                break
            f, above, _ = max(gains, key=gains.get)
            level = [b for g, a, b in gains if (g, a) == (f, above) and gains[g, a, b] >= 0.99 * max(gains.values())]
            part.append((f, above, sorted(level)[len(level) // 2]))  # equally good cuts: the one with room on both sides
        if not part:
            break
        tallies = left.agg(*[F.sum(F.when(test(part[:k]) & (F.col("_prune") if held else F.lit(True)), what)).alias(f"{name}{k}{held}")
                             for k in range(1, len(part) + 1) for held in (0, 1) for name, what in (("p", F.col("_bad")), ("n", F.lit(1)))]).first()
        count = lambda name, k, held: tallies[f"{name}{k}{held}"] or 0
        worth = lambda k: (2 * count("p", k, 1) - count("n", k, 1)) / max(1, count("n", k, 1))
        keep = max(range(1, len(part) + 1), key=lambda k: (worth(k), -k))
        p, n = count("p", keep, 0), count("n", keep, 0)
        if p < min_bad or p < min_precision * n:
            break
        part = part[:keep]
        rules.append(tuple(Condition(FEATURES[f], above, cuts[f][b - 1]) for f, above, b in part))
        left = left.where(~test(part))
    return rules


def decision(rules: list[Rule], features: Column) -> Column:
    """The ordered conditional over a struct of features: the text of the first rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = rule[0].column(features)
        for c in rule[1:]:
            fits = fits & c.column(features)
        out = F.when(fits, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def verdict(text: Column, rules: list[Rule]) -> Column:
    """A struct of one text: stats, base_failed, rule (the first that fits, else null), kept."""
    def told(s: Column) -> Column:
        base = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
        return let(F.struct(s.alias("stats"), base.alias("base_failed"), let(F.struct(*features(s)), lambda f: decision(rules, f)).alias("rule")),
                   lambda q: F.struct(q["stats"].alias("stats"), q["base_failed"].alias("base_failed"), q["rule"].alias("rule"), (~q["base_failed"] & q["rule"].isNull()).alias("kept")))

    return let(statistics(text), told)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "quality") -> DataFrame:
    """docs with one more struct column `out` (underscores in front if the name is taken): see verdict."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], verdict(F.col(f"`{text_col}`"), rules).alias(free_name(docs, out)))


def keep_good(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """The documents that neither the base rule nor a learned rule rejects; columns as in docs."""
    out = free_name(docs, "quality")
    judged = judge(docs, learn(docs, labels, **learning))
    return judged.where(F.col(out)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir) -> DataFrame:
    """op1: one row per document with the base counts and the verdict."""
    from adloom.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    q = judge(docs.select("doc_id", "text"), learn(docs, labels))
    s = F.col("quality")["stats"]
    return q.select("doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    F.col("quality")["base_failed"].alias("base_failed"), F.col("quality")["kept"].alias("kept"), F.col("quality")["rule"].alias("rule"))
