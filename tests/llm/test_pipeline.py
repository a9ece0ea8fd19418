import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from adloom.llm import bpe, decontaminate, quality_rules, quality_trees, registry
from adloom.llm.common import table, written

from .conftest import SF
from .test_quality import base
from .test_text_ops import windows_hit


def test_stages(spark, docs, labels):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[0] == "quality rules" and names[-1].startswith("BPE")
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, SF))
        assert at.columns == docs.columns
        kept.append({r.doc_id: r.text for r in at.collect()})
    everyone = {r.doc_id: r.text for r in docs.collect()}
    rules = quality_rules.learn(docs, labels)
    told = {r.doc_id: r.quality for r in quality_rules.judge(docs, rules).collect()}
    assert set(kept[0]) == {d for d, t in everyone.items() if not base(t)[-1] and told[d].rule is None}
    first = spark.createDataFrame(list(kept[0].items()), "doc_id long, text string")
    trees = quality_trees.train(docs, labels)
    assert set(kept[1]) == {r.doc_id for r in quality_trees.score(first, trees).collect() if r.quality_score >= quality_trees.THRESHOLD}
    # one document of equal texts, and only documents with a near copy go
    assert len(set(kept[2].values())) == len(kept[2]) and set(kept[1].values()) >= set(kept[2].values())
    sets = {d: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for d, t in kept[1].items() for w in [t.lower().split()]}
    for gone in set(kept[1]) - set(kept[2]):
        assert max(len(sets[gone] & sets[d]) / len(sets[gone] | sets[d]) for d in kept[1] if d != gone) >= 0.8
    bench = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    assert set(kept[3]) == {r[0] for r in windows_hit(kept[2].items(), bench) if not r[-1]}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(kept[3])
    e = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    for d, t in kept[3].items():
        ids = next(e.encode([t]))
        assert np.array_equal(out[d].ids, ids) and out[d].decoded == e.decode(ids) and out[d].n_tokens == len(ids)


def test_classifier_stage_rejects_what_rules_keep(spark):
    """The stage's trees tell documents apart on the rules' survivors; good and bad come as labels have them, held out from both learners."""
    more = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{more}/{n}.parquet") for n in ("documents", "labels"))
    trees = quality_trees.train(docs, labels)
    assert len(trees.feature) > 10
    kept = written(corpus_pipeline.STAGES[0][1](spark, docs, more))
    scores = {r.quality_score for r in quality_trees.score(kept, trees).collect()}
    assert len(scores) > 20 and max(scores) - min(scores) > 0.01
    # with rules that keep all but the shortest, the stage removes the bad ones and hardly a good one
    all_ = docs.where("n_chars > 200")
    left = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, all_, more).collect()}
    known = {r.doc_id: r.quality for r in labels.join(all_, "doc_id", "left_semi").collect()}
    assert np.mean([d in left for d, q in known.items() if q == 0]) < 0.1 and np.mean([d in left for d, q in known.items() if q == 1]) > 0.97


def test_stages_on_empty_tables(spark, docs, tmp_path):
    odd = docs.limit(40).withColumn("quality", docs.n_chars).withColumn("hits", docs.text).withColumn("_row", docs.doc_id)
    for name, rows in {"labels": 0, "benchmark": 0, "documents": 40}.items():
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        (t.limit(0) if not rows else t).write.parquet(str(tmp_path / f"{name}.parquet"))
    for df in (odd, odd.limit(0)):
        at = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = written(stage(spark, at, str(tmp_path)))
            assert at.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == at.count() and (at.count() > 0) == (df is odd)


def test_registered(spark):
    names = set(entry.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names and set(registry.ORACLE) <= set(registry.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert decontaminate.SIZE == 10


def test_queries_match_sql(spark):
    import duckdb

    c = duckdb.connect()
    for n in ("documents", "benchmark", "pages", "conversations"):
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    for name, sql in registry.ORACLE.items():
        df = registry.QUERIES[name](spark, SF)
        r = c.sql(sql)
        at = [r.columns.index(n) for n in df.columns]
        assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(x[k] for k in at) for x in r.fetchall()), key=str), name
