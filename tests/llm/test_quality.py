import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from adloom.llm import quality_rules as rules
from adloom.llm import quality_trees as trees
from adloom.llm.textstats import FEATURES

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_base_counts(make, edge, docs):
    for df in (make(edge), docs):
        want = Counter((r.doc_id, *base(r.text)) for r in df.select("doc_id", "text").collect())
        s = F.col("quality")["stats"]
        got = rules.judge(df, []).select("doc_id", *[s[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("quality")["base_failed"])
        assert Counter(map(tuple, got.collect())) == want


def test_rules_are_learned(spark, docs, labels):
    found = rules.learn(docs, labels)
    assert found and all(c.feature in FEATURES for r in found for c in r)
    judged = {r.doc_id: r.quality for r in rules.judge(docs.select("doc_id", "text"), found).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    open_ = [(known[d], q.kept) for d, q in judged.items() if d in known and not q.base_failed]
    assert np.mean([k == bool(y) for y, k in open_]) > 0.95
    assert not any(q.kept for q in judged.values() if q.base_failed) and all(q.kept == (q.rule is None) for q in judged.values() if not q.base_failed)
    # the first rule that fits is named, by its own thresholds
    for d, q in judged.items():
        if q.rule is not None:
            assert q.rule in [" and ".join(map(str, r)) for r in found], d
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, q in judged.items() if q.kept}


def slow_features(text):
    t = text or ""
    n, chars, symbols, dup, repeat, _ = base(t)
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    per = lambda a, b: a / b if b > 0 else 0.0
    among = lambda chars: sum(c in chars for c in t)
    upper, digits = sum("A" <= c <= "Z" for c in t), sum("0" <= c <= "9" for c in t)
    return dict(zip(FEATURES, (float(n), per(chars, n), per(symbols, n), per(among("|"), n), per(among("!"), n), per(among(".,;:?"), n), per(upper, chars),
                               per(len(set(w)), n), per(repeat, n), per(dup, len(lines)), per(n, len(lines)), per(digits, n)), strict=True))


def test_verdicts_against_brute_force(docs, make, edge, labels):
    found = rules.learn(docs, labels)
    for df in (docs, make(edge)):
        for r in rules.judge(df, found).select("text", "quality").collect():
            f = slow_features(r.text)
            fits = [q for q in found if all((f[c.feature] > c.threshold) == c.above for c in q)]
            assert r.quality.rule == (" and ".join(map(str, fits[0])) if fits else None)
            assert r.quality.kept == (not base(r.text)[-1] and not fits)


def test_rules_on_held_out_labels(spark):
    more = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{more}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = rules.learn(docs, labels.where(fold != 0))
    judged = rules.judge(docs.join(labels.where(fold == 0), "doc_id").where("length(text) > 200"), found).select("quality", "_quality.kept").collect()
    good, bad = ([r.kept for r in judged if r[0] == y] for y in (1, 0))
    assert len(bad) > 5 and np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_sample_has_one_row_an_id(spark, make, labels):
    many = make([(k % 3 + 1, f"text {k} " * 30) for k in range(300)])
    known = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 5), (None, 1)], "doc_id long, quality int")
    assert sorted((r._key, r._bad) for r in rules.labelled_sample(many, known, 100).collect()) == [(1, 1), (2, 0)]


def test_rules_edges(spark, make, edge, labels):
    assert rules.learn(make([]), labels) == [] == rules.learn(make(edge), labels.limit(0))
    odd = make([(1, "x " * 30, 5)], "quality int")
    out = rules.judge(odd, [])
    assert out.columns == [*odd.columns, "_quality"] and out.first()["_quality"].kept is False
    assert rules.judge(make([]), []).count() == 0


def test_classifier(spark):
    more = SF.replace("0.001", "0.01")  # enough held-out labels
    docs, labels = (spark.read.parquet(f"{more}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in trees.query(spark, more).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(known[d], r.predicted) for d, r in got.items() if r.held_out and d in known]
    assert held and np.mean([a == b for a, b in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_trees_against_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = trees.fit(x, y, trees=20)
    p = t.probability(x)
    assert np.mean((p > 0.5) == y) > 0.95

    def one(row):
        total = t.start
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > cut[k])
            total += leaf[k - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p, [one(r) for r in x])


def test_classifier_edges(make, edge, labels):
    empty = trees.train(make([]), labels)
    scored = trees.score(make(edge), empty)
    assert scored.count() == len(edge) and {r.quality_score for r in scored.collect()} == {0.5}
    same = trees.fit(np.zeros((5, 12)), np.ones(5))
    assert 0.5 < same.probability(np.zeros((1, 12)))[0] < 1 and len(same.probability(np.zeros((0, 12)))) == 0
    assert trees.score(make([(1, "a", 0.5)], "quality_score double"), empty).columns[-1] == "_quality_score"


def test_null_ids_are_not_held_out(make, edge, spark, monkeypatch):
    tables = {"documents": make(edge), "labels": spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")}
    monkeypatch.setattr(trees, "table", lambda s, d, n: tables[n])
    got = trees.query(spark, SF).collect()
    assert len(got) == len(edge) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
