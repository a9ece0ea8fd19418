"""A Merkle manifest of a table: a content-addressed DAG of digests, proofs of its leaves, and a check of them.

Leaves stand in one tree a group (here a language), in the order of their ids; the roots of the groups are the leaves of one
more tree. A level's nodes are joined two by two until one is left; a node that has no partner is hashed alone.

The DAG is stored as records (digest, levels): the digest of a node and what lies in the `BITS` levels below it, its children
last. A record is found by its digest alone, so equal subtrees are stored once. A request for a leaf descends from the root:
the digits of its rank (to the base 2**BITS) say which child to take, and what is not taken is collected; the path so
collected runs from the root down and is turned round to give the proof. Requests that share a prefix of digits descend
together, as one row, and part only in the record that holds their leaves.

Every step groups by a node of bounded fan-out, so that no group or lane grows with the largest language; ranks come from
range partitions. Rounds: one for every BITS levels.

Cases: null columns count as `-`, an empty text as `0:`; null ids come first and are never tampered with; a repeated id takes
the order of its leaves; repeated rows are leaves of their own with equal digests and proofs of their own; a null group is a
group, and comes first; other columns are no part of a leaf; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import joined_by, let, ranked, table, written

BITS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left: boolean, hash: string>>"


@dataclass(frozen=True)
class Manifest:
    """records (digest, levels); trees (tree, n, steps, subroot, rank), one row a group; the root (null for an empty table)."""

    records: DataFrame
    trees: DataFrame
    root: str | None
    n_trees: int


def part(value: Column) -> Column:
    """One value of a leaf: its length in bytes, a colon and the value, or `-`."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def tree_key(group: Column) -> Column:
    """A group as a key that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _level(nodes: Column) -> Column:
    """The level above."""
    pair = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def _levels(children: Column, height: Column, bits: int) -> Column:
    """children and the levels above them, up to `height` (at most bits)."""
    rounds = F.slice(F.array(*[F.lit(k) for k in range(bits)]), F.lit(1), height)
    return F.aggregate(rounds, F.array(children), lambda found, _: F.concat(found, F.array(_level(F.element_at(found, -1)))))


def _height(n: Column, bits: int) -> Column:
    """Levels above n nodes until one is left, at most `bits`."""
    return F.least(F.lit(bits), F.length(F.bin(n - 1)) * (n > 1).cast("int"))


def _steps(n: int, bits: int) -> int:
    """Records between a root of n leaves and a leaf."""
    return -(-(n - 1).bit_length() // bits)


def _reduced(leaves: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """(records, roots) of trees given as (tree, rank, digest); roots has (tree, n, subroot)."""
    sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    single = leaves.join(sizes.where("n = 1").select("tree"), "tree", "left_semi").select("tree", F.lit(1).cast("long").alias("n"), F.col("digest").alias("subroot"))
    records, roots, nodes, width = [], [single], leaves, 1
    for _ in range(_steps(most, bits)):
        pieces = nodes.groupBy("tree", F.shiftright("rank", bits).alias("rank")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("c"))
        width <<= bits  # leaves below a record
        here = sizes.where(F.col("n") > max(1, width >> bits)).withColumn("nodes", F.expr(f"(n - 1) div {width >> bits} + 1")).withColumn("pieces", F.expr(f"(n - 1) div {width} + 1"))
        sized = joined_by(written(pieces), here, "tree", "pieces")
        levels = _levels(F.col("c.digest"), F.col("height"), bits)
        told = sized.withColumn("height", _height(F.col("nodes"), bits)).select("tree", "n", "rank", levels.alias("levels"))
        told = written(told.withColumn("digest", F.element_at("levels", -1)[0]))
        records.append(told.select("digest", "levels"))
        roots.append(told.where(F.col("n") <= width).select("tree", "n", F.col("digest").alias("subroot")))
        nodes = told.where(F.col("n") > width).select("tree", "rank", "digest")
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return records, written(out)


def build(leaves: DataFrame, bits: int = BITS) -> Manifest:
    """The manifest of leaves (tree, rank, digest): ranks from 0 without a gap in each tree, trees in the order of their keys."""
    records, roots = _reduced(leaves, bits)
    forest = ranked(roots.withColumn("_all", F.lit("")), "_all", ["tree"])
    more, top = _reduced(forest.select(F.col("_all").alias("tree"), "rank", F.col("subroot").alias("digest")), bits)
    whole = top.first()
    store = None
    for r in (*records, *more):
        store = r if store is None else store.unionByName(r)
    if store is not None:
        store = written(store.groupBy("digest").agg(F.any_value("levels").alias("levels")))
    return Manifest(store, forest.select("tree", "n", "subroot", "rank"), whole["subroot"] if whole else None, whole["n"] if whole else 0)


def _below(levels: Column, digit: Column, bits: int) -> Column:
    """What a descent through a record leaves aside: a step a level, from the top."""
    def step(k: Column) -> Column:
        below = F.size(levels) - 2 - k  # levels of the record below the one that the step is made in
        place = F.call_function("shiftright", digit, below)
        return F.struct((place.bitwiseAND(F.lit(1)) == 1).alias("left"), F.get(F.get(levels, below), place.bitwiseXOR(F.lit(1))).alias("hash"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), step)).otherwise(F.array().cast(_STEP))


def _descend(records: DataFrame | None, starts: DataFrame, wanted: DataFrame, most: int, bits: int) -> DataFrame:
    """(tree, piece, path, levels, …): for each tree of starts (tree, n, digest, path, …) the records that hold the leaves of wanted (tree, rank), piece being rank >> bits, and the path to them."""
    extra = [c for c in starts.columns if c not in ("n", "digest", "path")]
    single = F.array(F.array("digest"))
    found = starts.where("n = 1").select(*extra, F.lit(0).cast("long").alias("piece"), "path", single.alias("levels"))
    frontier = None
    for step in range(_steps(most, bits), 0, -1):
        low = 1 << bits * (step - 1)
        enter = starts.where((F.col("n") > low) & (F.col("n") <= low << bits)).select(*extra, F.lit(0).cast("long").alias("piece"), "path", "digest")
        frontier = enter if frontier is None else frontier.unionByName(enter)
        at = frontier.join(records, "digest")
        if step == 1:
            return found.unionByName(at.select(*found.columns))
        child = at.select(*extra, "piece", "path", "levels", F.posexplode(F.col("levels")[0]).alias("digit", "digest"))
        child = child.select(*extra, (F.shiftleft("piece", bits) + F.col("digit")).alias("piece"), F.concat("path", _below(F.col("levels"), F.col("digit"), bits)).alias("path"), "digest")
        asked = wanted.select("tree", F.shiftright("rank", bits * (step - 1)).alias("piece")).distinct()
        frontier = written(child.join(asked, ["tree", "piece"], "left_semi"))
    return found


def proofs(manifest: Manifest, requests: DataFrame, bits: int = BITS) -> DataFrame:
    """requests (tree, rank, …) with the subroot of their tree and `path`: the steps from leaf to root, each with whether the sibling stands on the left, and its hash (null where there is none)."""
    none = F.array().cast(_STEP)
    forest = manifest.trees.select(F.lit("").alias("tree"), "rank", F.col("tree").alias("_tree"), "n", "subroot")
    top = requests.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(manifest.n_trees).cast("long").alias("n"), F.lit(manifest.root).alias("digest"), none.alias("path"))

    def to_leaves(rows: DataFrame, held: DataFrame) -> DataFrame:
        digit = F.col("rank").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        met = rows.withColumn("piece", F.shiftright("rank", bits)).join(held, ["tree", "piece"])
        return met.withColumn("path", F.concat("path", _below(F.col("levels"), digit, bits))).drop("levels", "piece")

    trees = to_leaves(forest, _descend(manifest.records, top, forest, manifest.n_trees, bits))
    starts = written(trees.select(F.col("_tree").alias("tree"), "n", F.col("subroot").alias("digest"), "subroot", "path"))
    most = starts.agg(F.max("n")).first()[0] or 0
    out = to_leaves(requests, _descend(manifest.records, starts, requests, most, bits))
    return out.withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    step = lambda acc, s: F.sha2(F.when(s["left"], F.concat(s["hash"], acc)).otherwise(F.concat(acc, F.coalesce(s["hash"], F.lit("")))), 256)
    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """Hashes of a proof, from leaf to root."""
    return F.filter(path["hash"], lambda h: h.isNotNull())


def leaves_of(docs: DataFrame, group: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, change: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """(tree, rank, doc_id, digest) of every row, and with `change`, which gets the columns by name and gives changed ones, the digest of the changed row as `changed`."""
    values = {c: F.col(f"`{c}`") for c in columns}
    more = [leaf_of(list((values | change(values)).values())).alias("changed")] if change else []
    rows = docs.select(tree_key(F.col(f"`{group}`")).alias("tree"), F.col(f"`{id_col}`").alias("doc_id"), leaf_of(list(values.values())).alias("digest"), *more)
    return ranked(rows, "tree", ["doc_id", "digest"])


def tampered(values: dict[str, Column]) -> dict[str, Column]:
    """n_chars one more where 7 divides the CRC-32 of the id."""
    hit = F.coalesce(F.crc32(values["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    n = values["n_chars"].cast("decimal(20,0)")
    return {"n_chars": F.when(hit, n + 1).otherwise(n)}


def query(spark, sf_dir) -> DataFrame:
    """op11: leaf, roots, proof and check of every document after tampering."""
    leaves = leaves_of(table(spark, sf_dir, "documents"), change=tampered)
    manifest = build(leaves.select("tree", "rank", "digest"))
    told = lambda p: F.struct(F.sha2(F.array_join(siblings(p), ""), 256).alias("proof_sha256"), folded(F.col("changed"), p).alias("folded_root"))
    out = proofs(manifest, leaves).select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), let(F.col("path"), told).alias("_t"))
    return out.select("doc_id", "leaf", "subroot", "root", "_t.proof_sha256", "_t.folded_root", (F.col("_t.folded_root") == F.col("root")).alias("verified"))


_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in COLUMNS) + ")"
_BIT = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
SQL = f"""
WITH RECURSIVE crcs AS (
    SELECT doc_id, 0 AS pos, CAST(4294967295 AS BIGINT) AS c, CAST(doc_id AS VARCHAR) AS s FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL
    SELECT doc_id, pos + 1, list_reduce([xor(c, CAST(ascii(substr(s, pos + 1, 1)) AS BIGINT))] || CAST(range(8) AS BIGINT[]), lambda c, x: {_BIT}), s FROM crcs WHERE pos < length(s)
), hit AS (
    SELECT doc_id FROM crcs WHERE pos = length(s) AND xor(c, 4294967295) % 7 = 0
), l AS (
    SELECT coalesce('=' || lang, '') AS tree, doc_id, {_LEAF} AS leaf,
        {_LEAF.replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars + CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN 1 ELSE 0 END AS VARCHAR)")} AS changed
    FROM documents
), r AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l
), t AS (
    SELECT tree, 0 AS level, rank, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM r
    UNION ALL
    SELECT tree, level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, rank // 2
), top AS (
    SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS rank FROM t WHERE n = 1
), f AS (
    SELECT 0 AS level, rank, subroot AS digest, count(*) OVER () AS n FROM top
    UNION ALL
    SELECT level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 1) // 2 FROM f WHERE n > 1 GROUP BY level, rank // 2
), steps AS (
    SELECT r.tree, r.rank, t.level, t.digest AS sibling, t.rank % 2 = 0 AS on_left FROM r JOIN t ON t.tree = r.tree AND t.rank = xor(r.rank // CAST(pow(2, t.level) AS BIGINT), 1) AND t.n > 1
    UNION ALL
    SELECT r.tree, r.rank, top.height + f.level, f.digest, f.rank % 2 = 0 FROM r JOIN top USING (tree) JOIN f ON f.rank = xor(top.rank // CAST(pow(2, f.level) AS BIGINT), 1) AND f.n > 1
), whole AS (
    SELECT digest AS root, level AS up FROM f WHERE n = 1
), proof AS (
    SELECT tree, rank, sha256(string_agg(sibling, '' ORDER BY level)) AS proof FROM steps GROUP BY tree, rank
), fold AS (
    SELECT r.tree, r.rank, 0 AS level, changed AS acc, top.height + whole.up AS height FROM r JOIN top USING (tree), whole
    UNION ALL
    SELECT fold.tree, fold.rank, fold.level + 1, sha256(CASE WHEN on_left THEN sibling || acc ELSE acc || coalesce(sibling, '') END), height
    FROM fold LEFT JOIN steps ON steps.tree = fold.tree AND steps.rank = fold.rank AND steps.level = fold.level WHERE fold.level < height
)
SELECT r.doc_id, r.leaf, top.subroot, whole.root, coalesce(proof.proof, sha256('')) AS proof_sha256, fold.acc AS folded_root, fold.acc = whole.root AS verified
FROM r JOIN top USING (tree) JOIN fold ON fold.tree = r.tree AND fold.rank = r.rank AND fold.level = fold.height LEFT JOIN proof ON proof.tree = r.tree AND proof.rank = r.rank, whole
"""
