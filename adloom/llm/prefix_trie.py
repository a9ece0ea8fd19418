"""The trie of conversation prefixes: which conversations share how many of their first turns, and what a cache of them saves.

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. Turns get their place in a conversation (`ranked`), and lie in pieces of `PIECE` turns, so that a conversation may have any
   length. A node's digest is SHA-256 over the digest of the node at its piece's start and the turns since then; the digests at
   starts follow from hashes of whole pieces, which few conversations have. Equal digests are equal sequences.
2. Nodes are counted by digest. Each belongs to its smallest member, of whose path it is a part.
3. Nodes and what lies above them on their owner's path are dealt to shards, pieces whole, by the first turn and then the
   owner. A shard enumerates its distinct digests, gives them slots by a minimal perfect hash (`Slots`, each key compared with
   the digest in its slot), scatters the values of the nodes that it owns into flat arrays, and adds every slot to its
   parent's, the deepest first. What comes out for a node in several shards is added up. A piece is told what lies below it by
   one value at its end, so a long path is no chain of tasks.

Cases: rows without a conv_id belong to no conversation; null roles and texts count as empty; rows of one turn number take the
order of a hash of role and text; repeated rows are turns of their own; a conversation may have any number of turns, also none
after it is rebuilt; other columns are ignored; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import joined_by, ranked, table, written

PIECE = 4096
#: Turns that a conversation takes from another, at most; conversations that share a start.
HEAD, GROUP = 8, 5
#: Rows of a shard, about.
SHARD_ROWS = 200_000
#: Bytes of conv_ids that are hashed at once.
CHUNK = 1 << 16
ROOT = hashlib.sha256(b"").digest()[:16]
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class Slots:
    """A minimal perfect hash of distinct 128-bit keys given as (n, 2) uint64: n keys have the slots 0 to n - 1.

    A level gives each key that is left a place by a hash of its own; keys alone at their place stay there, the others go on
    to the next level. A slot is the number of places taken before the key's.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []
        left, used = keys, 0
        while len(left):
            at = self._place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((used, np.append(0, np.cumsum(alone))))
            used += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
        self.keys = np.zeros((len(keys), 2), np.uint64)
        slot = self._slot(keys)
        self.keys[slot] = keys
        if len(np.unique(slot)) != len(keys):
            raise ValueError("keys are not distinct")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = (keys[:, 0] ^ (keys[:, 1] >> np.uint64(29))) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * _MIX[0] + keys[:, 1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (used, taken) in enumerate(self.levels):
            at = self._place(keys[left], level, len(taken) - 1)
            here = taken[at + 1] > taken[at]
            out[left[here]] = used + taken[at[here]]
            left = left[~here]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for one that is not there."""
        slot = self._slot(keys)
        known = slot >= 0
        known[known] = (self.keys[slot[known]] == keys[known]).all(axis=1)
        return np.where(known, slot, -1)


def subtree_sums(digest: np.ndarray, parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) of the distinct digests of a shard's rows: values of a node's rows and of all below it that the shard holds.

    digest and parent are (n, 2) uint64, values (n, k); a row without a parent in the shard hands nothing on.
    """
    keys, first = np.unique(digest, axis=0, return_index=True)
    slots = Slots(keys)
    above, deep = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    own = slots(keys)
    above[own], deep[own] = slots(parent[first]), depth[first]
    sums = np.zeros((len(keys), values.shape[1]), np.int64)
    np.add.at(sums, slots(digest), values)
    order = np.argsort(-deep, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(deep[order])) + 1):
        level = level[above[level] >= 0]
        np.add.at(sums, above[level], sums[level])
    return slots.keys, sums


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, n_bytes) of every turn, place from 0; the texts stay where they are."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    role = text("role")
    # the role's length tells where it ends
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text("text")), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("turn_hash"), F.octet_length(text("text")).cast("long").alias("n_bytes"))
    return ranked(rows, "conv_id", ["turn", "turn_hash"], "place").drop("turn")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): every conversation with its number of rebuilt turns, and those turns as (conv_id, place, turn_hash, n_bytes).

    A conversation takes the first h turns of the first one of its group, h by its id, and goes on with its own after h.
    """
    first = own.groupBy("conv_id").agg(F.max("place").alias("last"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("place") < HEAD, F.struct("place", "turn_hash", "n_bytes"))))).alias("head"))
    first = written(first)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    starts = first.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_start"), F.col("head").alias("_head"))
    convs = first.withColumns({"h": h, "_start": F.col("conv_id") - F.col("conv_id") % GROUP}).join(starts, "_start", "left")
    taken = F.slice(F.coalesce("_head", F.array().cast(starts.schema["_head"].dataType)), F.lit(1), F.col("h"))
    convs = written(convs.select("conv_id", "h", "last", taken.alias("taken")).withColumn("n_taken", F.size("taken")))
    pieces = convs.select("conv_id", "h", "n_taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {PIECE}"))).alias("_piece"))
    tail = own.withColumn("_piece", F.expr(f"place div {PIECE}")).join(pieces, ["conv_id", "_piece"]).where(F.col("place") >= F.col("h"))
    head = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.place", "t.turn_hash", "t.n_bytes")
    rows = head.unionByName(tail.select("conv_id", (F.col("place") - F.col("h") + F.col("n_taken")).alias("place"), "turn_hash", "n_bytes"))
    return convs.select("conv_id", (F.col("n_taken") + F.greatest(F.lit(0), F.col("last") + 1 - F.col("h"))).alias("n_turns")), rows


def paths(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, home, n_bytes, ends) of every prefix of every conversation, the empty one too; home is the same for all that share a piece's start (in the first piece: the first turn)."""
    piece = F.expr(f"place div {PIECE}")
    told = F.array_sort(F.collect_list(F.struct("place", "turn_hash", "n_bytes")))
    pieces = rows.groupBy("conv_id", piece.alias("piece")).agg(told.alias("t"))
    shape = convs.select("conv_id", "n_turns", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n_turns - 1, 0) div {PIECE}"))).alias("piece"))
    pieces = written(shape.join(pieces, ["conv_id", "piece"], "left").select("conv_id", "piece", "n_turns", F.col("t.turn_hash").alias("hashes"), F.col("t.n_bytes").alias("n_bytes")))
    # digests at the starts of pieces, for conversations of several
    joined = F.sha2(F.aggregate("hashes", F.unhex(F.lit("")), lambda a, x: F.concat(a, x)), 256)
    long = pieces.where((F.col("n_turns") > PIECE) & (F.size("hashes") == PIECE)).select("conv_id", "piece", joined.alias("whole"))
    chain = F.array_sort(F.collect_list(F.struct("piece", "whole")))["whole"]
    step = lambda a, x: F.concat(a, F.array(F.substring(F.unhex(F.sha2(F.concat(F.element_at(a, -1), F.unhex(x)), 256)), 1, 16)))
    starts = long.groupBy("conv_id").agg(F.aggregate(chain, F.array(F.lit(ROOT)), step).alias("s")).select("conv_id", F.posexplode("s").alias("piece", "start"))
    starts = written(starts.where("piece > 0").withColumn("piece", F.col("piece").cast("long")))
    met = pieces.where("piece = 0").withColumn("start", F.lit(ROOT)).unionByName(pieces.where("piece > 0").join(starts, ["conv_id", "piece"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                out: list[list] = [[] for _ in range(7)]
                for conv, at, n, hashes, size, start in zip(*[b[c].to_pylist() for c in ("conv_id", "piece", "n_turns", "hashes", "n_bytes", "start")], strict=True):
                    running, found = hashlib.sha256(), []
                    for x in hashes or ():
                        running.update(x)
                        found.append(hashlib.sha256(start + running.digest()).digest()[:16])
                    above = [start, *found[:-1]] if found else []
                    size, depths = size or [], list(range(at * PIECE + 1, at * PIECE + len(found) + 1))
                    if not at:
                        found, above, size, depths = [ROOT, *found], [None, *above], [0, *size], [0, *depths]
                    home = start if at else found[min(1, len(found) - 1)]
                    for column, x in zip(out, ([conv] * len(found), depths, found, above, [home] * len(found), size, [d == n for d in depths]), strict=True):
                        column += x
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], _PATH)

    return met.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, home binary, n_bytes long, ends boolean")


_PATH = ["conv_id", "depth", "digest", "parent", "home", "n_bytes", "ends"]


def _wide(column: pa.Array) -> np.ndarray:
    """16-byte values as (n, 2) uint64; a null is zero."""
    return np.frombuffer(b"".join(x or bytes(16) for x in column.to_pylist()), "<u8").reshape(-1, 2)


def _sums(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """(digest, n_leaves, saved_tokens) over the subtrees of nodes (digest, parent, depth, home, conv_id, n_children, worth)."""
    piece = F.expr(f"greatest(depth - 1, 0) div {PIECE}")
    leaf = (F.col("n_children") == 0).cast("long")
    owned = nodes.withColumns({"piece": piece, "leaf": leaf})
    owners = owned.groupBy("conv_id", "piece").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("worth").alias("worth"))
    told = F.array_sort(F.collect_list(F.struct("piece", "top", "leaf", "worth")))
    chain = owners.groupBy("conv_id").agg(told.alias("p"))
    # for every piece of an owner's path: its uppermost own node, and what its own nodes further down come to
    after = lambda name: F.aggregate(F.filter("p", lambda x: x["piece"] > F.col("piece")), F.lit(0).cast("long"), lambda a, x: a + x[name])
    span = chain.select("conv_id", "p", F.col("p")[0]["top"].alias("top"), F.explode(F.sequence(F.lit(0).cast("long"), F.element_at("p", -1)["piece"])).alias("piece"))
    span = span.select("conv_id", "piece", "top", after("leaf").alias("leaf"), after("worth").alias("worth"))
    above = path.select("conv_id", "depth", "digest", "parent", "home").withColumn("piece", piece).join(span, ["conv_id", "piece"])
    at_end = (F.col("depth") == (F.col("piece") + 1) * PIECE) & ((F.col("leaf") != 0) | (F.col("worth") != 0))
    above = above.where((F.col("depth") < F.col("top")) | at_end)
    above = above.withColumns({c: F.when(at_end, F.col(c)).otherwise(0) for c in ("leaf", "worth")})
    names = ["conv_id", "depth", "digest", "parent", "home", "leaf", "worth"]
    rows = written(owned.select(names).unionByName(above.select(names)))
    shards = rows.count() // SHARD_ROWS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a shard: about SHARD_ROWS rows
        if not held:
            return
        t = pa.Table.from_batches(held)
        depth = t["depth"].to_numpy()
        values = np.stack([t["leaf"].to_numpy(), t["worth"].to_numpy()], axis=1)
        parent = _wide(t["parent"]).copy()
        parent[(depth > 1) & ((depth - 1) % PIECE == 0)] = 0  # the piece above is told by its own end
        keys, sums = subtree_sums(_wide(t["digest"]), parent, depth, values)
        raw = keys.astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw[k:k + 16] for k in range(0, len(raw), 16)], pa.binary()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["digest", "n_leaves", "saved_tokens"])

    parts = rows.repartitionByRange(shards, "home", "conv_id").mapInArrow(run, "digest binary, n_leaves long, saved_tokens long")
    return parts.groupBy("digest").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _ends(path: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end.

    Ids are sorted in range partitions and told as texts of up to CHUNK bytes; a node's texts then run through its hash one after another.
    """
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["digest", "first", "ids"])

        for b in batches:
            for digest, conv in zip(b["digest"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if ids and (digest != node or size > CHUNK):
                    yield told()
                    ids, size = [], 0
                if not ids:
                    node, first = digest, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield told()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            out = []
            for digest, ids in zip(b["digest"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if digest == node:
                    h.update(b",")
                else:
                    if h is not None:
                        out.append((node, h.hexdigest()))
                    node, h = digest, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["digest", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["digest", "ends_sha256"])

    ended = path.where("ends").select("digest", "conv_id")
    chunks = ended.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(texts, "digest binary, first long, ids string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashes, "digest binary, ends_sha256 string")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, n_turns) with turns (conv_id, place, turn_hash, n_bytes): digest, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    path = written(paths(convs, rows))
    counted = path.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("home").alias("home"), F.first("n_bytes").alias("n_bytes"))
    counted = written(counted.withColumn("worth", (F.col("n_convs") - 1) * F.col("n_bytes")))
    children = counted.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = written(counted.join(children.withColumnRenamed("parent", "digest"), "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    owner = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    under = joined_by(nodes.where("parent is not null").select("digest", "parent"), owner, "parent", "n_children").select("digest", "parent_conv_id")
    out = nodes.join(_sums(nodes, path), "digest").join(under, "digest", "left").join(_ends(path), "digest", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def query(spark, sf_dir) -> DataFrame:
    """op12: the trie of rebuilt conversations."""
    convs, rows = rebuilt(turns(table(spark, sf_dir, "conversations")))
    return trie(convs, rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_BIT = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
SQL = f"""
WITH RECURSIVE ids AS (
    SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), crcs AS (
    SELECT conv_id, 0 AS pos, CAST(4294967295 AS BIGINT) AS c, CAST(conv_id AS VARCHAR) AS s FROM ids
    UNION ALL
    SELECT conv_id, pos + 1, list_reduce([xor(c, CAST(ascii(substr(s, pos + 1, 1)) AS BIGINT))] || CAST(range(8) AS BIGINT[]), lambda c, x: {_BIT}), s FROM crcs WHERE pos < length(s)
), heads AS (
    SELECT conv_id, xor(c, 4294967295) % {HEAD + 1} AS h, conv_id - conv_id % {GROUP} AS start FROM crcs WHERE pos = length(s)
), own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place,
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS hash, strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL
), got AS (
    SELECT h.conv_id, h.h, h.start, count(o.conv_id) AS n FROM heads h LEFT JOIN own o ON o.conv_id = h.start AND o.place < h.h GROUP BY ALL
), turns AS (
    SELECT g.conv_id, o.place, o.hash, o.bytes FROM got g JOIN own o ON o.conv_id = g.start AND o.place < g.h
    UNION ALL
    SELECT g.conv_id, o.place - g.h + g.n, o.hash, o.bytes FROM got g JOIN own o ON o.conv_id = g.conv_id AND o.place >= g.h
), path AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS depth, sha256('') AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS bytes FROM ids
    UNION ALL
    SELECT p.conv_id, p.depth + 1, sha256(p.node || t.hash), p.node, t.bytes FROM path p JOIN turns t ON t.conv_id = p.conv_id AND t.place = p.depth
), lengths AS (
    SELECT conv_id, max(depth) AS n FROM path GROUP BY conv_id
), nodes AS (
    SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(path.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS worth,
        sha256(coalesce(string_agg(CAST(path.conv_id AS VARCHAR), ',' ORDER BY path.conv_id) FILTER (depth = lengths.n), '')) AS ends_sha256
    FROM path JOIN lengths USING (conv_id) GROUP BY node
), kids AS (
    SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), up AS (
    SELECT node AS top, node, parent FROM nodes
    UNION ALL
    SELECT n.node, up.node, n.parent FROM up JOIN nodes n ON n.node = up.parent
), sums AS (
    SELECT up.top AS node, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum(nodes.worth) AS saved FROM up JOIN nodes ON nodes.node = up.node LEFT JOIN kids ON kids.node = up.node GROUP BY up.top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids ON kids.node = n.node
"""
