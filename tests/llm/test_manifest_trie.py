"""op11 and op12 against plain Python, and their edge cases."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from adloom.llm import common, merkle_manifest, prefix_trie

H = lambda *x: sha256("".join(x).encode()).hexdigest()
TURN = "conv_id long, turn long, role string, text string"


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, n=0):
    doc, text, lang, source, chars = r
    return H(part(doc), part(source), part(lang), part(chars if chars is None else chars + n), part(text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([H(*x[i:i + 2]) for i in range(0, len(x), 2)])
    return out


def steps(tree, rank):
    return [((rank >> k) % 2 == 1, level[i] if (i := (rank >> k) ^ 1) < len(level) else None) for k, level in enumerate(tree[:-1])]


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by["" if r[2] is None else "=" + r[2]].append(r)
    langs = sorted(by, key=str.encode)
    for k in langs:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: levels([leaf(r) for r in by[k]]) for k in langs}
    forest = levels([trees[k][-1][0] for k in langs])
    out = []
    for at, k in enumerate(langs):
        for rank, r in enumerate(by[k]):
            path = steps(trees[k], rank) + steps(forest, at)
            acc = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for left, h in path:
                acc = H(h, acc) if left else H(acc, h or "")
            root = forest[-1][0]
            out.append((r[0], leaf(r), trees[k][-1][0], root, H(*[h for _, h in path if h]), acc, acc == root))
    return sorted(out, key=str)


def documents(n, seed, langs=("en", "en", "en", "de", None, "é", "")):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, i, i, i, i % 5]), rnd.choice([None, "", "x", "words " * 3, "日本"]), rnd.choice(langs), rnd.choice([None, "s"]), rnd.choice([None, 0, 12])) for i in range(n)]
    return rows + rows[:n // 10]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def told(spark, docs, bits):
    leaves = merkle_manifest.leaves_of(docs, change=merkle_manifest.tampered)
    m = merkle_manifest.build(leaves.select("tree", "rank", "digest"), bits)
    got = merkle_manifest.proofs(m, leaves, bits)
    fold = merkle_manifest.folded(merkle_manifest.F.col("changed"), merkle_manifest.F.col("path"))
    rows = got.select("doc_id", "digest", "subroot", merkle_manifest.F.lit(m.root), merkle_manifest.F.sha2(merkle_manifest.F.array_join(merkle_manifest.siblings(merkle_manifest.F.col("path")), ""), 256), fold).collect()
    return sorted([(*r, r[5] == m.root) for r in rows], key=str)


@pytest.mark.parametrize(("n", "bits"), [(1, 2), (2, 2), (70, 2), (300, 3), (90, 6)])
def test_manifest(spark, n, bits):
    rows = documents(n, n)
    assert told(spark, frame(spark, rows), bits) == manifest(rows)


def test_manifest_of_one_group_and_of_lone_leaves(spark):
    rows = documents(65, 5, ("en",))
    assert told(spark, frame(spark, rows), 6) == manifest(rows)
    rows = [(i, "t", f"l{i}", None, 3) for i in range(9)]
    assert told(spark, frame(spark, rows), 2) == manifest(rows)


def test_manifest_query(spark, tmp_path):
    rows = documents(40, 3)
    frame(spark, rows).withColumn("rank", prefix_trie.F.lit("x")).withColumn("tree", prefix_trie.F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle_manifest.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == manifest(rows)
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert merkle_manifest.query(spark, str(tmp_path / "none")).count() == 0


def test_proofs_of_some_leaves(spark):
    """Requests descend only where they are asked, and tell the same."""
    rows = [(i, f"t{i}", "en" if i % 3 else "de", None, 1) for i in range(200)]
    leaves = merkle_manifest.leaves_of(frame(spark, rows))
    m = merkle_manifest.build(leaves.select("tree", "rank", "digest"), 2)
    few = leaves.where("doc_id in (7, 8, 150)")
    got = {r.doc_id: (r.digest, [tuple(s) for s in r.path]) for r in merkle_manifest.proofs(m, few, 2).collect()}
    assert set(got) == {7, 8, 150}
    for d, path in got.values():
        for left, h in path:
            d = H(h, d) if left else H(d, h or "")
        assert d == m.root


def test_ranked_over_partitions(spark):
    """A key that spans many partitions is numbered through."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("a", i) for i in range(50)] + [("b", i) for i in range(3000)] + [("c", 0)]
        random.Random(1).shuffle(rows)
        got = common.ranked(spark.createDataFrame(rows, "k string, v long").repartition(5), "k", ["v"]).collect()
        assert all(r["rank"] == r.v for r in got) and len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_joined_by(spark):
    many = spark.createDataFrame([(k, i) for k, n in (("hot", 500), ("b", 3), ("c", 1)) for i in range(n)], "k string, i long")
    one = spark.createDataFrame([("hot", 500, 1), ("b", 3, 2), ("c", 1, 3), ("none", 0, 4)], "k string, n long, v long")
    assert sorted((r.k, r.v) for r in common.joined_by(many, one, "k", "n", 4).collect()) == sorted([("hot", 1)] * 500 + [("b", 2)] * 3 + [("c", 3)])


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + v[h:]
    return out


def trie(rows):
    convs, members, ended = rebuilt(rows), defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ended[tuple(convs[c])].append(c)
    kids = defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted([(m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], H(",".join(map(str, ended[n])))) for n, m in members.items()], key=str)


def conversations(n, seed, longest=12, texts=("a", "b", None, "", "é")):
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(3 * n), n):
        rows += [(c, rnd.choice([t, t, t, None]), rnd.choice(["user", "user", None, ""]), rnd.choice(texts)) for t in range(rnd.randint(1, longest))]
    return rows + [(None, 1, "user", "nobody")]


def nodes(spark, rows, path):
    spark.createDataFrame(rows, TURN).withColumn("depth", prefix_trie.F.lit("x")).write.parquet(f"{path}/conversations.parquet")
    got = prefix_trie.query(spark, str(path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("piece", [4096, 3, 1])
def test_trie(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 100)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = conversations(60, piece) + [(1000 + i, t, "user", "same") for i in range(30) for t in range(9)] + [(2000, t, "user", str(t // 2)) for t in range(40)]
    assert nodes(spark, rows, tmp_path) == trie(rows)


def test_trie_edges(spark, tmp_path):
    assert nodes(spark, [], tmp_path / "none") == []
    lost = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)  # its start is absent, its own turns go
    rows = [(lost, 0, "user", "x"), (lost, 1, "user", "y")]
    assert nodes(spark, rows, tmp_path / "turnless") == trie(rows) == [(lost, 0, None, 1, 0, 1, 0, H(str(lost)))]
    rows = [(c, 0, "user", "x" * 100_000) for c in (5, 10, 15)] * 2
    assert nodes(spark, rows, tmp_path / "long") == trie(rows)


def test_slots():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    keys[:100, 0] = 7  # half a key may repeat
    s = prefix_trie.Slots(keys)
    assert sorted(s(keys)) == list(range(len(keys)))
    assert (s(keys + np.uint64(1)) == -1).all()
    assert len(prefix_trie.Slots(keys[:0]).keys) == 0
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.concatenate([keys[:5], keys[:1]]))
