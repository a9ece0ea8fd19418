"""License scan: hundreds of ordered signature rules over whole texts, as one Spark projection without a shuffle.

A text is lower-cased (A to Z) and cut to words; words are joined by single spaces. Texts without any gate word skip the
rules. For the others, rules whose keyword the text lacks are filtered out before any pattern runs. Each remaining rule
gives its places as word intervals. One pass over the intervals in the order (start, longest first, highest priority)
drops those that lie within an earlier one of at least their priority; base phrases are not part of that contest.

Cases: null text is the empty text; a null doc_id keeps its row; repeated rows each get a row; equal intervals of one
priority keep the first label by name; an empty table gives an empty result; other columns are carried by `scan` only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import free_name, let, table
from adloom.llm.license_rules import BASE, Signature, signatures

#: A signature's keyword or pattern can't occur in a text that holds none of these.
GATE = ("licen", "copyright", "rights", "public domain", "publicdomain", "cc by", "cc0", "creative", "gnu", "gpl", "permi", "warrant",
        "software", "prohibited", "opensource", "mozilla org", "eclipse org", "mariadb com", "wtfpl", "boost org", "openssl", "php net",
        "w3 org", "curl se", "unicode", "sil org", "eupl", "cecill", "oracle com", "vimhelp", "phk", "mulan", "opendatacommons", "openrail",
        "commercial", "proprietary", "redistribution", "advertising", "what the fuck", "endorse", "libpng", "database", "huggingface", "written")


def _spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def reduced(text: Column) -> Column:
    """Words with one space between; still in their own case."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), F.lit(" "))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(padded: Column, pattern: Column) -> Column:
    """Word intervals [start, stop) of a pattern in text with a space at each end: the text between matches, and the matches, are counted along."""
    def walk(gaps: Column, found: Column) -> Column:
        step = lambda a, m: F.struct(
            (a["i"] + 1).alias("i"),
            (a["at"] + _spaces(F.get(gaps, a["i"])) + _spaces(m)).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + _spaces(F.get(gaps, a["i"])) - 1).cast("long").alias("start"),
                (a["at"] + _spaces(F.get(gaps, a["i"])) + _spaces(m)).cast("long").alias("stop")))).alias("out"))
        empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
        return F.aggregate(found, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])

    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    return let(bounded, lambda p: let(F.regexp_extract_all(padded, p, F.lit(0)), lambda m: F.when(
        F.size(m) == 0, F.array().cast("array<struct<start:bigint,stop:bigint>>")).otherwise(
            let(F.split(padded, p, -1), lambda g: walk(g, m)))))


_DETECTION = "array<struct<start:bigint,stop:bigint,priority:int,label:string,weight:double>>"


def detections(padded: Column, rules: list[Signature]) -> Column:
    """All places of all rules that pass their keyword, unsorted."""
    listed = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"),
                                F.lit(r.pattern).alias("pattern"), F.lit(r.weight).alias("weight")) for r in rules])
    passed = F.filter(listed, lambda r: F.contains(padded, r["keyword"]))
    return F.flatten(F.transform(passed, lambda r: F.transform(places(padded, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), p["stop"].alias("stop"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"))))).cast(_DETECTION)


def survivors(found: Column) -> Column:
    """Detections without those that lie within another of at least their priority. `reach[p]`: how far those of priority p or more go."""
    ordered = F.transform(F.sort_array(F.array_distinct(F.transform(found, lambda d: F.struct(
        d["start"].alias("a"), (-d["stop"]).alias("b"), (-d["priority"]).alias("c"), d["label"].alias("d"), d["weight"].alias("e"))))),
        lambda x: F.struct(x["a"].alias("start"), (-x["b"]).alias("stop"), (-x["c"]).alias("priority"), x["d"].alias("label"), x["e"].alias("weight")))
    first = F.struct(F.array(*[F.lit(-1).cast("long")] * 4).alias("reach"), F.array().cast(_DETECTION).alias("out"))
    step = lambda a, d: F.struct(
        F.transform(a["reach"], lambda r, i: F.when(i < d["priority"], F.greatest(r, d["stop"])).otherwise(r)).alias("reach"),
        F.when(F.get(a["reach"], d["priority"] - 1) >= d["stop"], a["out"]).otherwise(F.concat(a["out"], F.array(d))).alias("out"))
    return F.aggregate(ordered, first, step, lambda a: a["out"])


def scan(docs: DataFrame, rules: list[Signature] | None = None, text_col: str = "text", out: str = "licenses") -> DataFrame:
    """docs with one more struct column `out`: n_words, base (places with label), found (surviving detections of all rules)."""
    rules = signatures() if rules is None else rules
    keep = [F.col(f"`{c}`") for c in docs.columns]
    text, gate, low = free_name(docs, "_words"), free_name(docs, "_gated"), free_name(docs, "_padded")
    df = docs.select(*keep, reduced(F.col(f"`{text_col}`")).alias(text))
    lower = F.lower(F.col(text))  # holds whatever the A-Z form holds, so it may gate
    df = df.select("*", reduce(lambda a, b: a | b, [lower.contains(g) for g in GATE]).alias(gate))
    df = df.select("*", F.when(F.col(gate), F.concat(F.lit(" "), ascii_lower(F.col(text)), F.lit(" "))).alias(low))
    n_words = F.when(F.col(text) == "", 0).otherwise(_spaces(F.col(text)) + 1).cast("long")
    none = F.array().cast(_DETECTION)
    base = F.when(F.col(gate), detections(F.col(low), rules[:len(BASE)])).otherwise(none)
    found = F.when(F.col(gate), survivors(detections(F.col(low), rules))).otherwise(none)
    return df.select(*keep, F.struct(n_words.alias("n_words"), base.alias("base"), found.alias("found")).alias(free_name(docs, out)))


def query(spark, sf_dir) -> DataFrame:
    """op2: one row per document; score is 1 less the product of (1 - weight) over distinct labels found."""
    x = F.col("licenses")
    names = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    label = lambda a: F.transform(a, lambda d: d["label"])
    every = F.array_distinct(F.transform(F.concat(x["base"], x["found"]), lambda d: F.struct(d["label"].alias("label"), d["weight"].alias("weight"))))
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", x["n_words"].alias("n_words"), F.size(x["base"]).cast("long").alias("n_base"),
        F.array_min(F.transform(x["base"], lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(x["base"], lambda d: d["start"])).alias("last_word"),
        names(label(x["base"])).alias("base_labels"), names(F.concat(label(x["base"]), label(x["found"]))).alias("labels"),
        (1 - F.aggregate(every, F.lit(1.0), lambda a, d: a * (1 - d["weight"]))).alias("score"),
        x["found"].alias("spans"))
