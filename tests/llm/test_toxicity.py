"""op13: lengths against zstandard itself, held-out labels, and edge cases."""

import random
import zlib

import numpy as np
import pytest
import zstandard

from adloom.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    """Invented texts; a fourth of them calls names."""
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("aeiou") + rnd.choice("nrstl") for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    rude = ["blockhead", "nitwit", "dunderhead", "gormquux"]
    rows = []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(5, 80))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(rude) + rnd.choice(["", "s", "ish"]))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark, make):
    rows = corpus(600)
    docs, labels = make([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, x) for i, _, x in rows], LABELS)
    return rows, docs, labels, T.train(docs, labels, use=T.F.crc32(T.F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def test_held_out(learned):
    rows, docs, _, model = learned
    got = {r.doc_id: r.toxicity for r in T.score(docs, model).select("doc_id", "toxicity").collect()}
    out = [(got[i] >= T.THRESHOLD, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p for p, x in out if x]) >= 0.95 and np.mean([p for p, x in out if not x]) <= 0.02
    assert {"blockhead", "nitwit"} <= set(model.toxic)


def test_score_is_the_margins(learned):
    """The score in Spark is that of lengths which zstandard gives one window after another."""
    rows, docs, _, model = learned
    wide = T.code()
    assert len({bytes(x) for x in wide}) == 256

    def length(window, words):
        put = lambda w: b"".join(bytes(wide[b]) for b in f" {w} ".encode())
        d = zstandard.ZstdCompressionDict(b"".join(map(put, words)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(T.LEVEL, source_size=64, dict_size=len(d), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(put(window)))

    text = rows[0][1]
    windows = [w[k:k + T.LONGEST] for w in text.lower().strip(".").split() for k in range(0, len(w), T.LONGEST)]
    margins = sorted((max(T.FLOOR, length(w, model.ordinary) - length(w, model.toxic)) for w in windows), reverse=True)[:3]
    x = T.Margins(model)([text])
    assert x[0].tolist() == [*margins, np.log(len(windows))]
    got = T.score(docs.where("doc_id = 0"), model).first()["toxicity"]
    assert got == pytest.approx(model.probability(x)[0])


def test_edges(spark, make, edge, learned):
    *_, model = learned
    rows = [*edge, (20, "Blockhead" * 30_000), (21, "blockhead " * 20_000), (22, "BLOCKHEAD, nitwits and DUNDERHEADS!"), (23, "the" * 40_000 + " nitwit")]
    got = T.score(make([(*r, "mine") for r in rows], "toxicity string"), model)
    assert len(got.columns) == 7 and got.where("toxicity = 'mine'").count() == len(rows)
    by = [(r.doc_id, r["_toxicity"]) for r in got.collect()]
    assert all(0 <= s <= 1 for _, s in by) and len(by) == len(rows)
    by = dict(by)
    assert by[1] == by[2] == by[3]  # null, empty, blank
    assert by[22] > 0.9 and by[21] > 0.9 and by[4] < 0.5
    assert T.score(make([]), model).count() == 0


def test_labels_of_one_class_or_none(spark, make):
    docs = make([(i, "some words") for i in range(6)])
    for rows in ([], [(1, 1, 0), (2, 1, 0)], [(3, 1, 1)], [(1, 1, None), (2, 0, 7), (None, 1, 1)]):
        model = T.train(docs, spark.createDataFrame(rows, LABELS))
        assert len({r.toxicity for r in T.score(docs, model).collect()}) == 1


def test_repeated_ids_and_labels(spark, make, learned):
    rows, *_ = learned
    docs = make([(i, t) for i, t, _ in rows[:80]] * 2 + [(None, "x")])
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows[:80]] + [(i, 1, 0) for i, _, x in rows[:80]], LABELS)
    sample = T.labelled(docs, labels, 1000, None).collect()
    assert sorted((r.key, r.toxic) for r in sample) == [(i, x) for i, _, x in rows[:80]]
    assert len(T.labelled(docs, labels, 7, None).collect()) == 7


def test_keep_clean(spark, learned):
    rows, docs, labels, _ = learned
    kept = T.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert {i for i, _, x in rows if not x} <= left and len(left & {i for i, _, x in rows if x}) <= 5


def test_query(spark, tmp_path, learned):
    rows, docs, labels, _ = learned
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = T.query(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {r.doc_id: r for r in got.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", T.F.when(T.F.crc32(T.F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")).cast("int"))
    other.write.parquet(str(tmp_path / "again" / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "again" / "documents.parquet"))
    assert {r.doc_id: r.score for r in T.query(spark, str(tmp_path / "again")).collect()} == {i: r.score for i, r in got.items()}
