import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import bpe, decontaminate, language_crf, license_scan
from adloom.llm.license_rules import BASE, signatures

from .conftest import SF

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOW))


def test_signatures():
    every = signatures()
    assert len(every) > 200 and all(r.keyword and 0 < r.weight <= 1 and 1 <= r.priority <= 4 for r in every)
    for r in every:
        re.compile(r.pattern)


def test_license_base_places(spark, make, edge, docs, monkeypatch):
    rows = [(100, "cc by nc cc by nc CC-BY-NC"), (101, "Under the MIT License"), (102, "undER the mıt license Apache License, Version 2.0"), (103, "x under the mit license " * 300)]
    df = make([*edge, *rows]).unionByName(docs)
    monkeypatch.setattr(license_scan, "table", lambda *a: df)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.query(spark, SF).collect())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        w = item_words(r.text)
        hits = [(i, label) for label, p in BASE for i in range(len(w) - len(p.split()) + 1) if w[i:i + len(p.split())] == p.split()]
        want[r.doc_id, len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))] += 1
    assert got == want


def test_license_labels_and_suppression(make):
    text = "Code: SPDX-License-Identifier: GPL-3.0-or-later. This work is licensed under the GNU General Public License, version 3. See the Mozilla Public License 2.0; https://creativecommons.org/licenses/by-sa/4.0/ "
    x = license_scan.scan(make([text])).first().licenses
    assert [(d.label, d.priority) for d in x.found] == [("gpl-3.0", 4), ("gpl-3.0", 3), ("mpl-2.0", 2), ("cc-by-sa-4.0", 3)]
    assert license_scan.scan(make([(1, "a", 2)], "licenses int")).columns[-1] == "_licenses" and license_scan.scan(make([])).count() == 0


def test_license_suppression_and_score_against_brute_force(spark, make, monkeypatch):
    """What stays is just what no earlier detection, by start, length and priority, of at least its priority contains; labels and score follow from it."""
    rng = random.Random(8)
    rules = signatures()
    texts = [" ".join(rng.choice(("", "x", "see the", "and")) + " " + matching(r.pattern, rng) for r in rng.sample(rules, rng.randint(1, 5))) for _ in range(120)]
    df = make(texts).coalesce(2)
    monkeypatch.setattr(license_scan, "table", lambda *a: df)
    got = {r.doc_id: r for r in license_scan.query(spark, SF).collect()}
    for k, text in enumerate(texts):
        flat = " " + " ".join(item_words(text)) + " "
        every = set()
        for r in rules:
            for m in re.finditer(rf"(?<= )(?:{r.pattern})(?= )", flat):
                start = flat.count(" ", 0, m.start()) - 1
                every.add((start, start + m.group().count(" ") + 1, r.priority, r.label, r.weight))
        order = sorted(every, key=lambda d: (d[0], -d[1], -d[2], d[3], d[4]))
        kept = [d for i, d in enumerate(order) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in order[:i])]
        assert sorted((d.start, d.stop, d.priority, d.label, d.weight) for d in got[k].spans) == sorted(kept), text
        base = {label for label, p in BASE if f" {p} " in flat}
        assert got[k].labels == ",".join(sorted(base | {d[3] for d in kept}))
        rest = np.prod([1 - w for _, w in {(d[3], d[4]) for d in kept} | {(label, 0.9) for label in base}])
        assert abs(got[k].score - (1 - rest)) < 1e-9


def matching(pattern, rng):
    """A random text that a pattern matches."""
    def one(op, arg):
        name = str(op)
        if name == "LITERAL":
            return chr(arg)
        if name == "ANY":
            return "x"
        if name == "IN":
            return one(*rng.choice(arg))
        if name == "SUBPATTERN":
            return every(arg[3])
        if name == "BRANCH":
            return every(rng.choice(arg[1]))
        assert name == "MAX_REPEAT", name
        return "".join(every(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))

    def every(ops):
        return "".join(one(*x) for x in ops)

    return every(re._parser.parse(pattern))


def test_license_keywords_drop_nothing(make, monkeypatch):
    rng = random.Random(3)
    texts = ["License: CC BY 4.0", "CC BY-SA 4.0", "CC0 1.0", "Creative Commons Attribution 4.0", "cc-by-nc-nd", "Creative Commons Zero"]
    texts += ["x " + matching(r.pattern, rng) + " y" for r in signatures() for _ in range(2 if r.priority == 2 else 1)]
    df = make(texts).coalesce(2)
    got = {r.doc_id: r.licenses for r in license_scan.scan(df).collect()}
    monkeypatch.setattr(license_scan, "GATE", ("",))
    want = {r.doc_id: r.licenses for r in license_scan.scan(df, [replace(r, keyword=" ") for r in signatures()]).collect()}
    assert [{d.label for d in got[k].found} for k in range(6)] == [{"cc-by-4.0"}, {"cc-by-sa-4.0"}, {"cc0-1.0"}, {"cc-by-4.0"}, {"cc-by-nc", "cc-by-nc-nd-4.0"}, {"cc0-1.0"}]
    assert [texts[k] for k in got if got[k] != want[k]] == [] and all(x.found for x in got.values())


@pytest.fixture(scope="module")
def reference_tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())


def test_bpe_against_the_library(reference_tokenizer, docs):
    rng = random.Random(5)
    letters = "abcdeéÉßΣςσİıK'’sStTllvV ²½Ⅷ٣́\x1c\x85\xa0\u2003\u200b\u3000#!$😀日本語กัx<|>\x00\n_-…"
    special = ["<|endoftext|>", "<|startoftext|>", "'re", "'ll"]
    texts = ["", "a" * 1001, "#" * 999, "ab" * 500, "<|endoftext|> hi<|startoftext|>", "ΌΣΟΣ ΑΣ", *[r.text for r in docs.select("text").limit(150).collect()]]
    texts += ["".join(rng.choice(special) if rng.random() < 0.03 else rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    e = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    for text, ids, want in zip(texts, e.encode(texts), reference_tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text
        assert e.decode(ids) == reference_tokenizer.decode(want.ids, skip_special_tokens=False)


def test_bpe_forgets_and_merges_one_by_one(monkeypatch):
    v = bpe.Vocabulary(bpe.default_path())
    texts = [f"word{i} other{i % 7} mixing" for i in range(200)]
    want = [i.tolist() for i in bpe.Encoder(v).encode(texts)]
    monkeypatch.setattr(bpe, "KEEP", 10)
    small = bpe.Encoder(v)
    assert [i.tolist() for t in texts for i in small.encode([t])] == want
    v.alone = np.ones_like(v.alone)  # the leftmost place of a word at a time gives the same
    assert [i.tolist() for i in bpe.Encoder(v).encode(texts)] == want


def test_bpe_table(make, edge, reference_tokenizer):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(make(edge), digest=True).collect())
    want = Counter()
    for i, t in edge:
        ids = reference_tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(reference_tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(make(["hello"])).first().decoded == "hello</w>" and bpe.encode(make([])).count() == 0


ITEMS = [("s1", "Foo bar"), ("s2", None), ("s3", "!!"), ("s4", "bar baz"), (None, "quick-brown"), ("s1", "foo bar baz x"), ("t", "a b c d e f g h i j k l"), ("t", "a b c d e f g h i j k l")]
HIT = [(101, "foo Bar baz"), (102, "foo x foo bar"), (103, "the quick brown " * 5), (104, "x b c d e f g h i j k y"), (105, "A-b-c d e f g h i J k l")]


def windows_hit(rows, items, size=10):
    grams = defaultdict(set)
    for name, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            grams[tuple(w[k:k + size])].add(name)
    for i, text in rows:
        w, hit, names = item_words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit.update(range(k, k + n))
                    names |= grams[tuple(w[k:k + n])]
        names = sorted(x for x in names if x is not None)
        yield i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_decontamination(spark, make, edge, monkeypatch, block_words):
    df, items = make([*edge, *HIT]), spark.createDataFrame(ITEMS, "item_id string, text string")
    monkeypatch.setattr(decontaminate, "table", lambda s, d, n: df if n == "documents" else items)
    monkeypatch.setattr(decontaminate.mark, "__defaults__", (10, "text", "hits", block_words))
    got = Counter(map(tuple, decontaminate.query(spark, SF).collect()))
    assert got == Counter(windows_hit([*edge, *HIT], ITEMS))


def test_blocks_are_scanned_one_by_one(spark, make, monkeypatch):
    """With many blocks no plan holds two scans, and each broadcast goes before the next block is collected."""
    df, items = make([*HIT, (3, None)]), spark.createDataFrame(ITEMS, "item_id string, text string")
    alive, most, make_block, written = [], [], decontaminate._block, decontaminate.written

    def block(*a):
        assert not alive
        alive.append(1)
        return make_block(*a)

    def counted(d, *a):
        most.append(d._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        out = written(d, *a)
        alive.clear()
        return out

    monkeypatch.setattr(decontaminate, "_block", block)
    monkeypatch.setattr(decontaminate, "written", counted)
    marked = decontaminate.mark(df, items, block_words=3)
    assert len(most) > 3 and max(most) == 1 and "MapInArrow" not in marked._jdf.queryExecution().executedPlan().toString()
    one = decontaminate.mark(df, items).collect()
    assert sorted(map(str, marked.collect())) == sorted(map(str, one))


def test_decontamination_removes(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    df = make([(1, "keep Foo, bar! and quick brown end"), (2, "clean"), (3, None), (4, "foo bar - BAR baz. foo bar"), (5, "x quick-brown foo bar. y")])
    assert sorted(r.doc_id for r in decontaminate.remove(df, items).collect()) == [2, 3]
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.remove(df, items, "spans").collect()}
    assert got == {1: ("keep ! and  end", 15), 2: ("clean", 5), 3: (None, None), 4: ("", 0), 5: ("x . y", 5)}
    assert decontaminate.remove(df, items.limit(0)).count() == 5 and decontaminate.remove(make([]), items).count() == 0
    assert decontaminate.mark(make([(1, "a", 2)], "hits int"), items).columns[-1] == "_hits"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    sizes, n = np.array([1, 4, 3, 5]), 3
    e, step = rng.normal(size=(sizes.sum(), n)), rng.normal(size=(n, n))
    got, at = language_crf.forward_backward(e, step, sizes), 0
    for size in sizes:
        want = np.zeros((size, n))
        for path in np.ndindex(*[n] * size):
            w = np.exp(sum(e[at + i, k] for i, k in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(got[at:at + size], want / want.sum(axis=1, keepdims=True))
        at += size


def test_gradient_of_steps():
    """The pair marginals that training uses are those of all paths."""
    rng = np.random.default_rng(3)
    e, step, sizes, n = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), np.array([4]), 3
    factor, forward, backward = language_crf.messages(e, step, sizes)
    for t in range(3):
        want = np.zeros((n, n))
        for path in np.ndindex(n, n, n, n):
            want[path[t], path[t + 1]] += np.exp(sum(e[i, k] for i, k in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
        got = np.exp(step) * forward[t][:, None] * (factor[t + 1] * backward[t + 1])[None]
        assert np.allclose(got / got.sum(), want / want.sum())


def test_language(spark, docs, make, edge):
    got = {r.doc_id: r for r in language_crf.query(spark, SF).collect()}
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in got.items())
    held = [known[d] == r.lang_pred for d, r in got.items() if r.held_out]
    assert np.mean(held) > 0.93
    crf = language_crf.train(docs, max_docs=60, rounds=6)
    out = {r.doc_id: r.language for r in language_crf.predict(make([*edge, (50, "123 ...!"), (51, "日本語")]), crf).collect()}
    assert out[1].lang == out[2].lang == out[3].lang == out[50].lang == "und" and out[51].lang in crf.langs
    none = language_crf.train(docs.limit(0))
    assert {r.language.lang for r in language_crf.predict(make(edge), none).collect()} == {"und"}
    mixed = [w for d in ("de", "en") for w in language_crf.words_of(docs.where(F.col("lang") == d).first().text)[:30]]
    p = language_crf.forward_backward(crf.emissions(mixed), crf.step, np.array([len(mixed)])).argmax(axis=1)
    assert np.mean(p[:len(mixed) // 2] == crf.langs.index("de")) > 0.8 and np.mean(p[len(mixed) // 2:] == crf.langs.index("en")) > 0.8


def test_many_languages(spark, make, docs):
    """Dirty lang values: the most frequent are learned, the driver gets no more of them; repeated ids count once in the lexicon."""
    plain = docs.where("lang in ('en', 'de')").select("doc_id", "text", "lang")
    dirty = spark.range(300).selectExpr("id + 100000 as doc_id", "concat('word', id, ' other text here') as text", "concat('x-', id) as lang")
    crf = language_crf.train(plain.unionByName(dirty).unionByName(plain), max_docs=1000, max_langs=2, rounds=2)
    assert sorted(crf.langs) == ["de", "en"]
    once = language_crf.train(plain, max_docs=1000, rounds=2)
    assert all(np.allclose(getattr(crf, k), getattr(once, k)) for k in ("weight", "step", "entry"))


def test_language_of_words_never_seen(spark):
    """Held-out words that neither the lexicon nor the training runs hold are told by their parts; the lexicon tells what parts do not."""
    more = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{more}/documents.parquet")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    crf = language_crf.train(docs, odd != 1, rounds=6)
    held = [(r.lang, language_crf.words_of(r.text)) for r in docs.where(odd == 1).where("lang is not null").collect()]
    seen = {w for r in docs.where(odd != 1).collect() for w in language_crf.words_of(r.text)}
    new = [(lang, w) for lang, ws in held for w in dict.fromkeys(ws) if w not in seen and len(w) > 3]
    got = crf.emissions([w for _, w in new]).argmax(axis=1)
    assert len(new) > 50 and np.mean([crf.langs[k] == lang for k, (lang, _) in zip(got, new, strict=True)]) > 0.7
    a, b = crf.langs[:2]
    counts = {f"{p}qq{k}".encode(): {lang: 5} for p, lang in (("x", a), ("y", b)) for k in range(40)}
    runs = [(lang, [w for w, c in counts.items() if lang in c][k % 7:][:10]) for lang in (a, b) for k in range(30)]
    small = language_crf.fit(runs, counts | {b"same": {a: 9}, b"equal": {b: 9}}, rounds=20)
    assert [small.langs[k] for k in small.emissions([b"same", b"equal"]).argmax(axis=1)] == [a, b]
