"""SimHash near-dedup with multi-index hashing.

A fingerprint has majority bits over the hashes of word shingles, 64 a lane, and is cut into segments. A segment's values
are looked up in a table of their own: every distinct fingerprint is entered under each value within one bit of its own, so
that two fingerprints whose segments differ in two bits or fewer share an entry. Members of an entry have their complete
distances verified, and links that join them are told: a forest of least distances, never all pairs.

Tables are dealt to tasks by segment and the upper bits of the value (a group); flips of the lower bits are made in the task.

Two searches use this:

* `near_components`: 64 bits, two segments of 32 and a limit of 4. One of two halves differs in two bits or fewer, so no link
  is lost; for that, fingerprints go to the groups one upper bit away too.
* `similar_components`: pairs of a Jaccard similarity of shingle sets. Fingerprints are of distinct shingles, as the
  similarity is. Upper bits must agree; `LOWER` bits below them make up the rest of a segment, so that an entry stays as
  small as the corpus grows. The upper bits follow from the number of rows, and the number of segments from those, so that
  a pair at the threshold shares an entry with the probability `RECALL` at every size. The first `HELD` lanes have their
  distances counted against a loose limit. Each set's nearest links are then held against the whole shingle sets of both
  texts and go if the similarity is lower. Where that leaves what loose links join in several components, members of different components meet
  again and are held against each other; so the choice of links decides nothing. Pairs that fingerprints keep in different
  loose groups are found by a prefix join (`_missed`): two sets as alike as that share one of the rarest shingles of both,
  at places that leave enough behind them; of such pairs those are held against each other whose parity bits allow it. So no pair is lost: fingerprints decide how much work is left, not what is found.

A group beyond `most` fingerprints is dealt finer, by entry: each member goes to the 1 + lower entries it belongs to. An
entry beyond `block` members is dealt to pairs of blocks where no link may be lost; where the prefix join finds the rest,
it is cut to blocks that all hold the same few hundred members drawn by hash, so that the work stays in proportion.

Components are found by alternating stars in Spark tables.

Cases: null and blank texts have fingerprint zero and link like others; texts with fewer words than a shingle are one
shingle; repeated rows each get a row; a null doc_id is never a component's id (null if no member has one); an empty table
gives an empty result; other columns are carried by `keep_one` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import TEXT_ROWS, table, written
from adloom.llm.components import components

SEED, MOST, BLOCK = 42, 32_768, 2048
#: Upper bits: least and most.
LEAST_UPPER, TOP = 6, 12
LOWER, MOST_UPPER, RECALL = 16, 16, 0.998
#: Lanes whose distances are counted.
HELD = 3
NEAR_SHINGLE, NEAR = 5, 0.8
#: Entries up to this size have all their pairs compared at once.
SMALL = 24
#: Members of an entry that each of its blocks holds, about.
PIVOTS = 256
#: Ids that a broadcast may hold (about 16 MB); more are joined by a shuffle of both sides.
BROADCAST_IDS = 1_000_000
#: Bytes of shingle sets, and members for each of `block`, in a block of a loosely joined group.
SETS, WIDER = 16 << 20, 8
#: Texts whose shingles are counted to put frequent ones last, about, and shingles so put; any order finds the same pairs.
COUNTED, COMMON = 20_000, 1 << 18
#: The bits of a byte, high first, one to a byte of a 64-bit number; sums of up to 255 such numbers are eight counts.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes for a lane: the hashes themselves, or a mix of them."""
    if not lane:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle in order; none for a text without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    stop = (start + size)[min(shingle, len(words)) - 1:]
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), stop.tolist(), strict=True)), np.uint64, n)


def fingerprints_of(hashes: list[np.ndarray], lanes: int) -> np.ndarray:
    """(texts, 8 * lanes) bytes, high bits first."""
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out, some = np.zeros((len(hashes), 8 * lanes), np.uint8), np.flatnonzero(size)
    if not len(some):
        return out
    h, n = np.concatenate(hashes), size[some]
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    start = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for lane in range(lanes):
        parts = _lane(h, lane).astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts = np.add.reduceat(_SPREAD[parts[:, k]], start).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
            out[some, 8 * lane + k] = np.packbits(2 * ones > n[:, None], axis=1)[:, 0]
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of distinct 64-bit hashes."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared) if len(x) or len(y) else 1.0


def node_of(f: np.ndarray) -> np.ndarray:
    """Numbers of fingerprints given as rows of 64-bit lanes: the lane itself, or a mix of several."""
    h = f[:, 0].astype(np.uint64)
    for lane in f.T[1:]:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + lane.astype(np.uint64)
    return h.astype(np.int64)


def common_shingles(docs: DataFrame, rows: int, shingle: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that most of about COUNTED different texts of `rows` hold, ascending, and the rank of each, rarest first: COMMON of them at most, each in two texts or more."""
    h = text_hash(F.col(f"`{text_col}`"))
    some = docs.where(F.pmod(h, F.lit(max(1, rows // COUNTED))) == 0).groupBy(h).agg(F.first(F.col(f"`{text_col}`").cast("binary")).alias("t")).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            h = np.concatenate([np.unique(shingle_hashes(t, shingle)) for t in b["t"].to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(h.view(np.int64), return_counts=True)], ["h", "n"])

    counted = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    h = counted.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)  # COMMON rows at most
    order = np.argsort(h)
    return h[order], len(h) - order


def rarest(h: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of the distinct ascending hashes h in the order that all sets share, common ones last: all but ceil(least * size) - 1."""
    n = len(h) - ceil(least * len(h) - 1e-9) + 1 if len(h) else 0
    codes, rank = common
    at = np.minimum(np.searchsorted(codes, h), len(codes) - 1) if len(codes) else np.zeros(len(h), np.int64)
    often = codes[at] == h if len(codes) else np.zeros(len(h), bool)
    first = h[~often]
    return first[:n] if len(first) >= n else np.concatenate([first, h[often][np.argsort(rank[at[often]])]])[:n]


def parities(h: np.ndarray) -> bytes:
    """Whether an odd number of the hashes falls on each bit; one to two bits a hash, 64 at least."""
    bits = 1 << max(6, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """A number of hashes that only one of two sets has, told from their parities; there may be more, never fewer."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False, distinct: bool = False,
                 least: float | None = None, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, text_hash, node, fp) of every row, with sets also the distinct hashes of its shingles; node is the fingerprint as a number, or a 64-bit hash of its first HELD lanes with several lanes. With distinct a repeated shingle counts once.

    With least and common also own, a hash of the whole set, the set's size, its `rarest` hashes in order and its `parities`.
    """
    import xxhash

    kind = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_hash(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(common) if least is not None else None
    schema = "doc_id long, text_hash long, node long, fp binary" + ", shingles binary" * sets + ", own long, size int, rare binary, odd binary" * (least is not None)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            every = [shingle_hashes(t, shingle) for t in b["t"].to_pylist()]
            if distinct or sets or shared:
                once = [np.unique(h) for h in every]
            fps = fingerprints_of(once if distinct else every, lanes)
            nodes = node_of(fps.view(">i8").astype(np.int64)[:, :HELD])
            more = [pa.array([h.astype("<u8").tobytes() for h in once], pa.binary())] if sets else []
            if shared:
                own = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in once], np.uint64).view(np.int64)
                more += [pa.array(own), pa.array([len(h) for h in once], pa.int32()), pa.array([rarest(h, least, shared.value).astype("<u8").tobytes() for h in once], pa.binary()),
                         pa.array([parities(h) for h in once], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(nodes, pa.int64()), pa.array([f.tobytes() for f in fps], pa.binary()), *more], names)

    return kind.mapInArrow(run, schema)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lanes(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b["fp"].to_pylist()), ">i8").astype(np.int64).reshape(b.num_rows, -1)


def _values(f: np.ndarray, width: int, segments: int) -> np.ndarray:
    """(rows, segments) values of the segments, `width` bits each, of fingerprints given as lanes."""
    bits = np.unpackbits(f.astype(">i8").view(np.uint8).reshape(len(f), -1), axis=1)[:, :segments * width]
    wide = np.zeros((len(f), segments, 32), np.uint8)
    wide[:, :, 32 - width:] = bits.reshape(len(f), segments, width)
    return np.packbits(wide, axis=2).view(">u4")[:, :, 0].astype(np.int64)


def _exact_upper(fps: DataFrame, most: int) -> int:
    """The least number of upper bits, LEAST_UPPER to TOP, that leaves `most` fingerprints or fewer of each 32-bit value; TOP if none does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, n = np.unique((_values(_lanes(b), 32, 2) >> (32 - TOP)) | (np.arange(2) << TOP), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], ["v", "n"])

    rows = fps.select("fp").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()  # at most 2 x 2**TOP rows
    for upper in range(LEAST_UPPER, TOP):
        counts: dict[int, int] = {}
        for r in rows:
            counts[r["v"] >> (TOP - upper)] = counts.get(r["v"] >> (TOP - upper), 0) + r["n"]
        if max(counts.values(), default=0) <= most:
            return upper
    return TOP


def shape(rows: int, similarity: float, most: int = MOST, recall: float = RECALL) -> tuple[int, int, int, int]:
    """(upper bits, segments, lanes, limit) of the search for pairs of that similarity among so many rows.

    A bit of two fingerprints differs with the angle of the sets over pi. The limit is passed by one pair in ten thousand.
    """
    flip = acos(2 * similarity / (1 + similarity)) / pi
    upper = min(MOST_UPPER, max(LEAST_UPPER, ceil(log2(max(1, 2 * rows / most)))))
    agree = (1 - flip) ** upper * sum(comb(LOWER, k) * flip**k * (1 - flip) ** (LOWER - k) for k in range(3))
    segments = ceil(log(1 - recall) / log(1 - agree))
    bits = 64 * HELD
    return upper, segments, max(HELD, ceil(segments * (upper + LOWER) / 64)), ceil(bits * flip + 3.72 * sqrt(bits * flip * (1 - flip)))


def _dealt(fps: DataFrame, lanes: int, width: int, segments: int, upper: int, flip_upper: bool, counts: bool = False) -> DataFrame:
    """(grp, value, f0, f1, …): the first HELD lanes of each fingerprint in the groups of its segments' upper bits; with flip_upper also as they are with one of those flipped. With counts (grp, n) of pieces of the table."""
    flips = np.array([0, *(1 << k for k in range(upper if flip_upper else 0))], np.int64)
    names = [f"f{k}" for k in range(min(lanes, HELD))]
    step = (50 if counts else 1) * (16_000 // (8 * segments))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                f = _lanes(whole.slice(at, step))
                value = _values(f, width, segments)
                keys = ((value >> (width - upper))[:, :, None] ^ flips) | (np.arange(segments, dtype=np.int64) << 32)[None, :, None]
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(keys, return_counts=True)], ["grp", "n"])
                    continue
                times = np.repeat(np.arange(len(f)), keys[0].size if len(f) else 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(value.ravel(), len(flips))), *[pa.array(lane[times]) for lane in f.T[:HELD]]], ["grp", "value", *names])

    return fps.select("fp").mapInArrow(run, "grp long, n long" if counts else "grp long, value long, " + ", ".join(f"{n} long" for n in names))


def _tree(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links within the limit that join all members that such links join."""
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            u = frontier.pop()
            hit = np.bitwise_count(fp[rest] ^ fp[u]).sum(axis=1) <= limit
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                out += [(u, x) for x in found]
                frontier += list(found)
    return out


def _forest(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Places of links of least gaps that join what all links join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    keep = []
    for k in np.lexsort((b, a, gap)).tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def _links(dealt: DataFrame, limit: int, width: int, lanes: int, upper: int) -> DataFrame:
    """Verified links (a, b, gap) of nodes, a the greater one, gap their distance; dealt has (grp, part, value, f0, …), and members meet within a part of a group. Part 0 is a group's table; any other is one entry."""
    lower = width - upper
    flips = np.array([0, *(1 << k for k in range(lower))], np.int64)

    def entries(grp: np.ndarray, part: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of table entries: rows are entered under their value, those of the group's own upper bits under each flip of a lower bit too."""
        every = np.cumsum(np.append(False, (grp[1:] != grp[:-1]) | (part[1:] != part[:-1]))) << lower
        table = part == 0
        own = np.flatnonzero(table & ((value >> lower) == (grp & 0xFFFFFFFF)))
        other = np.flatnonzero(table & ((value >> lower) != (grp & 0xFFFFFFFF)))
        single, low = np.flatnonzero(~table), value & ((1 << lower) - 1)
        keys = np.concatenate([(every[own, None] | (low[own, None] ^ flips)).ravel(), every[other] | low[other], every[single]])
        return keys, np.concatenate([np.repeat(own, len(flips)), other, single])

    def pairs(grp: np.ndarray, part: np.ndarray, value: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links (a, b, distance) of nodes, of whole parts."""
        keys, row = entries(grp, part, value)
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], row[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        bit, node, found = f.astype(np.uint64), node_of(f), []
        few = np.repeat(sizes <= SMALL, sizes)
        left, at = row[few], keys[few]
        for d in range(1, SMALL):
            same = np.flatnonzero(at[d:] == at[:-d])
            if not len(same):
                break
            a, b = left[same], left[same + d]
            gap = np.bitwise_count(bit[a] ^ bit[b]).sum(axis=1, dtype=np.int64)
            near = gap <= limit
            found.append((node[a[near]], node[b[near]], gap[near]))
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            members = row[s:s + n]
            members = members[np.argsort(node[members])]  # trees of other entries grow from the same member
            if tree := _tree(bit[members], limit):
                a, b = members[np.array(tree, np.int64)].T
                found.append((node[a], node[b], np.bitwise_count(bit[a] ^ bit[b]).sum(axis=1, dtype=np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def tell(held: list) -> Iterator[pa.RecordBatch]:
        a, b, gap = pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if len(a):
            a, b = np.maximum(a, b), np.minimum(a, b)
            once = np.unique(np.stack([a, b, gap]), axis=1)
            keep = once[:, _forest(*once)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in keep], ["a", "b", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the last part, whose other rows may come in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, part, value = (batch[n].to_numpy() for n in ("grp", "part", "value"))
            f = np.stack([batch[f"f{k}"].to_numpy() for k in range(min(lanes, HELD))], axis=1)
            last = np.flatnonzero((grp != grp[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (grp[0], part[0]) != (held[0][0][0], held[0][1][0]):
                yield from tell(held)
                held = []
            if cut:
                yield from tell([*held, (grp[:cut], part[:cut], value[:cut], f[:cut])])
                held = []
            held.append((grp[cut:], part[cut:], value[cut:], f[cut:]))
        if held:
            yield from tell(held)

    return dealt.repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(run, "a long, b long, gap long")


def _block_pairs(b: Column, n: Column) -> Column:
    """Numbers of the parts that block b of n goes to: any two blocks make a part."""
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda j: F.least(b, j) * n + F.greatest(b, j))


def _main_parts(h: Column, main: Column, k: Column, m: Column) -> Column:
    """Numbers of the parts that a member of hash h goes to: those below k² are pairs of the k blocks of others; beyond, one of the m blocks of main members with a block of others."""
    own, each = F.pmod(h, k), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    of_main = F.transform(each(k), lambda i: k * k + i * m + F.pmod(h, m))
    of_other = F.concat(_block_pairs(own, k), F.transform(each(m), lambda j: k * k + own * m + j))
    return F.when(main, of_main).otherwise(of_other)


def link(fps: DataFrame, limit: int, lanes: int, width: int, segments: int, upper: int, exact: bool, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Links (a, b, gap) of nodes that join what distances of `limit` or less join, within shared entries; fps holds distinct (node, fp). With exact none is lost where segments differ in two bits or fewer."""
    dealt = _dealt(fps, lanes, width, segments, upper, flip_upper=exact)
    names = [f"f{k}" for k in range(min(lanes, HELD))]
    sized = _dealt(fps, lanes, width, segments, upper, flip_upper=exact, counts=True).groupBy("grp").agg(F.sum("n").alias("n"))
    hot = written(sized.where(F.col("n") > 2 * most).select("grp"))
    if hot.isEmpty():
        return _links(dealt.withColumn("part", F.lit(0).cast("long")), limit, width, lanes, upper).distinct()
    mask = (1 << (width - upper)) - 1
    low = F.col("value").bitwiseAND(F.lit(mask))
    own = F.shiftright("value", width - upper) == F.col("grp").bitwiseAND(F.lit(0xFFFFFFFF))
    # parts of a hot group: the entries its members belong to, from 1 on
    flips = F.concat(F.array(low), F.when(own, F.transform(F.array(*[F.lit(1 << k).cast("long") for k in range(width - upper)]), lambda x: low.bitwiseXOR(x))).otherwise(F.array().cast("array<bigint>")))
    marked = dealt.join(hot.withColumn("_hot", F.lit(True)), "grp", "left")
    entry = F.when(F.col("_hot"), F.transform(flips, lambda x: x + 1)).otherwise(F.array(F.lit(0).cast("long")))
    entered = marked.select("grp", F.explode(entry).alias("entry"), "value", *names)
    big = written(entered.where("entry > 0").groupBy("grp", "entry").count().where(F.col("count") > block))
    n = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("long")
    h = F.xxhash64(*names)
    b = F.pmod(h, n).cast("long")
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    blocks = _block_pairs(b, n) if exact else F.when(F.pmod(F.shiftrightunsigned(h, 20), F.coalesce("count", F.lit(1))) < PIVOTS, every).otherwise(F.array(b))
    # a part's number tells entry and block apart
    parts = F.when(F.col("count").isNull(), F.array(F.col("entry"))).otherwise(F.transform(blocks, lambda x: F.shiftleft(x + 1, width - upper + 1) + F.col("entry")))
    return _links(entered.join(big, ["grp", "entry"], "left").select("grp", F.explode(parts).alias("part"), "value", *names), limit, width, lanes, upper).distinct()


def _nearest(links: DataFrame) -> DataFrame:
    """(a, b) of each node's link of the least gap to a lower node, and to a higher one."""
    down = links.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    up = links.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    return down.unionByName(up).distinct()


def _few(ids: DataFrame) -> DataFrame:
    """ids (a written table) marked for a broadcast if there are BROADCAST_IDS or fewer."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _sets(links: DataFrame, whole: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the ends of links. A set's text is that of its least (doc_id, text_hash), or of a row without a doc_id if all are."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = written(whole.join(ends, "node", "left_semi").select("node", F.col("least.doc_id").alias("_id"), F.coalesce("least.text_hash", "text_hash").alias("_hash")))
    ids = written(named.select("_id", "_hash").distinct())
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(_few(ids), F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash(F.col("text")) == F.col("_hash")), "left_semi")
    told = fingerprints(texts, shingle, 1, sets=True).select("doc_id", "text_hash", "shingles")
    found = told.join(named, told["doc_id"].eqNullSafe(named["_id"]) & (told["text_hash"] == named["_hash"]))
    return written(found.groupBy("node").agg(F.min("shingles").alias("shingles")), TEXT_ROWS)


def _similar(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) whose texts have that similarity or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(x, y) >= least for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return links.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) but for those whose sizes and parities tell that they are less alike than that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch["n"].to_numpy().astype(np.int64) + batch["m"].to_numpy()
            most = both - 2 * np.ceil(least / (1 + least) * both - 1e-9)
            good = [apart_at_least(x, y) <= k for x, y, k in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = whole.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("odd").alias("x"))
    y = whole.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("odd").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def joining(sets: list[np.ndarray], root: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between sets that join all which similarities of `least` or more join; those of one root are joined already.

    Two sets as alike as that share one of the rarest of either: with codes in the order of how many sets hold them, all but
    ceil(least * size) - 1 of a set's codes, from the rarest on. Only sets that meet there are held against each other, so
    sets that share a template of frequent codes alone never are; and of two of unlike sizes none.
    """
    n, size, root, out = len(sets), np.array([len(x) for x in sets], np.int64), root.copy(), []
    stop = np.cumsum(size)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    count = np.bincount(codes)
    rarity = np.empty(len(count), np.int64)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    own = [np.sort(rarity[codes[e - k:e]]) for e, k in zip(stop.tolist(), size.tolist(), strict=True)]
    kept = np.array([len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1 if len(x) else 0 for x in own], np.int64)
    rare = np.concatenate([x[:k] for x, k in zip(own, kept.tolist(), strict=True)])
    ends = np.cumsum(kept)
    first = np.append(0, np.cumsum(np.bincount(rare, minlength=len(count))))  # holders[first[c]:first[c + 1]] hold the rare code c
    holders = np.repeat(np.arange(n), kept)[np.argsort(rare, kind="stable")]
    held = np.zeros(len(count), bool)

    def join(i: int, j: int) -> None:
        if root[i] != root[j]:
            out.append((min(i, j), max(i, j)))
            root[root == root[j]] = root[i]

    empty = np.flatnonzero(size == 0).tolist()
    for j in empty[1:]:
        join(empty[0], j)
    for i in np.flatnonzero(size).tolist():
        apart = (root != root[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9)
        apart[:i] = False  # met at their own turn
        if not apart.any():
            continue
        c = rare[ends[i] - kept[i]:ends[i]]
        many = first[c + 1] - first[c]
        at = np.arange(many.sum()) + np.repeat(first[c] - np.cumsum(many) + many, many)
        met = np.zeros(n, bool)
        met[holders[at]] = True
        met = np.flatnonzero(met & apart)
        if not len(met):
            continue
        held[own[i]] = True
        shared = np.add.reduceat(held[np.concatenate([own[j] for j in met])].astype(np.int64), np.cumsum(size[met]) - size[met])
        held[own[i]] = False
        for j in met[shared / (size[i] + size[met] - shared) >= least].tolist():
            join(i, j)
    return out


def _untested(loose: DataFrame, joined: DataFrame, sets: DataFrame, least: float, block: int, set_bytes: int) -> DataFrame:
    """Links (a, b) of that similarity between what `joined` leaves apart of `loose`, both with (a, b) of components.

    Members of a group's largest component (main) need not meet each other: their blocks meet those of the other members only.
    """
    members = sets.select("node", F.octet_length("shingles").cast("long").alias("bytes"))
    for found, name in ((loose, "grp"), (joined, "root")):
        members = members.join(found.select(F.col("a").alias("node"), F.col("b").alias(name)), "node", "left").withColumn(name, F.coalesce(name, "node"))
    members = written(members)
    roots = members.groupBy("grp", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    apart = roots.groupBy("grp").agg(F.max(F.struct("n", "bytes", "root")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / set_bytes), F.lit(1)).cast("long")
    apart = written(apart.select("grp", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("mains"),
                                 blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("others")))
    parts = _main_parts(F.xxhash64("node"), F.col("root") == F.col("main"), F.col("others"), F.col("mains"))
    dealt = members.join(apart, "grp").join(sets, "node").select("grp", F.explode(parts).alias("part"), "node", "root", "shingles")

    def tell(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, root = (np.concatenate([x[name].to_numpy() for x in held]) for name in ("node", "root"))
        if (root == root[0]).all():
            return
        if found := joining([np.frombuffer(x, "<u8") for b in held for x in b["shingles"].to_pylist()], root, least):
            i, j = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None  # rows of the last part, whose other rows may come in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, part = batch["grp"].to_numpy(), batch["part"].to_numpy()
            starts = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(grp)]
            for s, e in zip(starts, starts[1:]):
                if held and key != (grp[s], part[s]):
                    yield from tell(held)
                    held = []
                key = (grp[s], part[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield from tell(held)

    return dealt.repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(run, "a long, b long")


def crossing(code: np.ndarray, grp: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of nodes of different grp that share a code (ascending) at places `at` which leave enough behind them in both sets for that similarity."""
    def near(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        shared = np.ceil(least / (1 + least) * (size[i] + size[j]) - 1e-9)
        return (grp[i] != grp[j]) & (at[i] + shared <= size[i]) & (at[j] + shared <= size[j])

    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    sizes = np.diff(np.append(starts, len(code)))
    left = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for d in range(1, SMALL):
        same = np.flatnonzero(code[left[d:]] == code[left[:-d]]) if len(left) > d else left[:0]
        if not len(same):
            break
        i, j = left[same], left[same + d]
        good = near(i, j)
        yield node[i[good]], node[j[good]]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        names, count = np.unique(grp[s:s + n], return_counts=True)
        main = grp[s:s + n] == names[count.argmax()]  # its members need not meet each other
        rows = s + np.concatenate([np.flatnonzero(~main), np.flatnonzero(main)])
        for k, i in enumerate(rows[:n - int(main.sum())].tolist()):
            j = rows[k + 1:]
            j = j[near(i, j)]
            yield np.full(len(j), node[i]), node[j]


def _missed(whole: DataFrame, loose: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs (a, b) of sets of different loose groups that may have that similarity; none that has is left out.

    whole has (node, size, rare), loose (a, b) of components. Sets meet by their rare codes. Codes of more than `block` sets
    are dealt to pairs of blocks.
    """
    grouped = whole.where("size > 0").join(loose.select(F.col("a").alias("node"), F.col("b").alias("grp")), "node", "left").select("node", F.coalesce("grp", "node").alias("grp"), "size", "rare")
    told = "code long, grp long, node long, size int, at int"

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 500) for x in batches for k in range(0, x.num_rows, 500)):
            n = np.array([len(x) // 8 for x in b["rare"].to_pylist()], np.int64)
            code = np.frombuffer(b"".join(b["rare"].to_pylist()), "<i8")
            at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(code), *[pa.array(np.repeat(b[x].to_numpy(), n)) for x in ("grp", "node", "size")], pa.array(at.astype(np.int32))], ["code", "grp", "node", "size", "at"])

    def pairs(rows: dict[str, np.ndarray], run: np.ndarray) -> Iterator[np.ndarray]:
        """(2, pairs) of rows, some at a time."""
        some, n = [], 0
        for a, b in crossing(run, rows["grp"], rows["node"], rows["size"].astype(np.int64), rows["at"].astype(np.int64), least):
            some.append(np.stack([np.maximum(a, b), np.minimum(a, b)]))
            n += len(a)
            if n >= 1 << 18:
                yield np.unique(np.concatenate(some, axis=1), axis=1)
                some, n = [], 0
        if n:
            yield np.unique(np.concatenate(some, axis=1), axis=1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the codes of `block` sets or fewer; the rows of other codes go on, with a and b null."""
        held, on = [], None  # rows of the last code, whose other rows may come in the next batch, and the last code that goes on

        def tell() -> Iterator[pa.RecordBatch]:
            rows = {x: np.concatenate([b[x].to_numpy() for b in held]) for x in names}
            starts = np.flatnonzero(np.append(True, rows["code"][1:] != rows["code"][:-1]))
            sizes = np.diff(np.append(starts, len(rows["code"])))
            many = np.repeat((sizes > block) | (rows["code"][starts] == on if on is not None else False), sizes)
            if many.any():
                none = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *[pa.array(rows[x][many]) for x in names]], ["a", "b", *names])
            few = {x: v[~many] for x, v in rows.items()}
            for a, b in pairs(few, few["code"]) if len(few["code"]) else ():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), t) for t in (pa.int64(),) * 3 + (pa.int32(),) * 2]], ["a", "b", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch["code"].to_numpy()
            cut = int(np.searchsorted(code, code[-1]))
            if held and (cut or held[0]["code"][0].as_py() != code[0]):
                if held[0]["code"][0].as_py() == code[0]:
                    held.append(batch.slice(0, cut))
                    batch, cut = batch.slice(cut), 0
                yield from tell()
                held = []
            if cut:
                held = [batch.slice(0, cut)]
                yield from tell()
                held = []
            held.append(batch.slice(cut))
            if sum(b.num_rows for b in held) > block:
                yield from tell()
                held, on = [], code[-1]
        if held:
            yield from tell()

    def met_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one part

        def tell() -> Iterator[pa.RecordBatch]:
            rows = {x: np.concatenate([b[x].to_numpy() for b in held]) for x in names}
            for a, b in pairs(rows, np.zeros(len(rows["code"]), np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code, part = batch["code"].to_numpy(), batch["part"].to_numpy()
            starts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(code)]
            for s, e in zip(starts, starts[1:]):
                if held and (held[0]["code"][0].as_py(), held[0]["part"][0].as_py()) != (code[s], part[s]):
                    yield from tell()
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from tell()

    names = [x.split()[0] for x in told.split(", ")]
    dealt = grouped.mapInArrow(codes, told).repartition("code").sortWithinPartitions("code")
    found = written(dealt.mapInArrow(met, "a long, b long, " + told))
    few, many = found.where("a is not null").select("a", "b"), found.where("a is null").select(*names)
    apart = many.groupBy("code", "grp").count().groupBy("code").agg(F.max(F.struct("count", "grp")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("groups")).where("groups > 1")
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("long")
    apart = written(apart.select("code", F.col("main.grp").alias("main"), blocks(F.col("main.count")).alias("mains"), blocks(F.col("n") - F.col("main.count")).alias("others")))
    if apart.isEmpty():
        return written(few.distinct())
    parts = _main_parts(F.xxhash64("node"), F.col("grp") == F.col("main"), F.col("others"), F.col("mains"))
    dealt = many.join(apart, "code").select(F.explode(parts).alias("part"), *names).repartition("code", "part").sortWithinPartitions("code", "part")
    return written(few.unionByName(dealt.mapInArrow(met_in_parts, "a long, b long")).distinct())


def near_components(docs: DataFrame, shingle: int = 4, limit: int = 4, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id that links of `limit` (5 at most) differing bits of 64 reach, the row's own included."""
    rows = written(fingerprints(docs, shingle, 1, id_col, text_col), TEXT_ROWS)
    fps = written(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("least")))
    return _named(rows, fps, components(link(fps, limit, 1, 32, 2, _exact_upper(fps, most), True, most, block).select("a", "b")))


def similar_components(docs: DataFrame, similarity: float = NEAR, shingle: int = NEAR_SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text",
                       most: int = MOST, block: int = BLOCK, set_bytes: int = SETS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, kept_hash) of every row: as near_components, with links between texts of that Jaccard similarity or more of their distinct shingles; kept_hash is the text_hash of the component's first row by (doc_id, text_hash)."""
    n = docs.count()
    upper, segments, lanes, limit = shape(n, similarity, most, recall)
    common = common_shingles(docs, n, shingle, text_col)
    rows = written(fingerprints(docs, shingle, lanes, id_col, text_col, distinct=True, least=similarity, common=common), TEXT_ROWS)
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("least")
    whole = written(rows.groupBy("own").agg(least, *[F.min(x).alias(x) for x in ("text_hash", "node", "fp", "size", "rare", "odd")]))
    fps = written(whole.groupBy("node").agg(F.min("fp").alias("fp"), F.min("least").alias("least"), F.min("own").alias("first")))
    near = written(link(fps.select("node", "fp", "least"), limit, lanes, upper + LOWER, segments, upper, False, most, block))
    # from here on a node is a set: links are those of the first set of each fingerprint, and of the others to that
    named = lambda x: fps.select(F.col("node").alias(x), F.col("first").alias(f"{x}_"))
    of_sets = lambda links: links.join(named("a"), "a").join(named("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    same = written(whole.join(fps.select("node", "first"), "node").where("own != first").select(F.col("own").alias("a"), F.col("first").alias("b")))
    whole = whole.drop("node").withColumnRenamed("own", "node")
    loose = written(of_sets(near).unionByName(same))
    sets = _sets(loose, whole, docs, shingle, id_col, text_col)
    joined = components(_similar(of_sets(_nearest(near)).unionByName(same), sets, similarity))
    loose = components(loose)
    more = written(_untested(loose, joined, sets, similarity, WIDER * block, set_bytes))
    missed = written(_possible(_missed(whole, loose, similarity, block), whole, similarity))
    if not missed.isEmpty():
        more = written(more.unionByName(_similar(missed, _sets(missed, whole, docs, shingle, id_col, text_col), similarity)))
    rows = rows.select("doc_id", "text_hash", "fp", F.col("own").alias("node"))
    return _named(rows, whole.select("node", "least"), joined if more.isEmpty() else components(joined.unionByName(more)))


def _named(rows: DataFrame, fps: DataFrame, joined: DataFrame) -> DataFrame:
    """rows with the least (doc_id, text_hash) of the component of their node, as component_id and kept_hash; joined has components()."""
    rooted = written(fps.join(joined.withColumnRenamed("a", "node"), "node", "left").select("node", "least", F.coalesce("b", "node").alias("root")))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("first")))
    named = written(rooted.join(least, "root", "left").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("kept_hash")))
    return rows.join(named, "node", "left").select("doc_id", "text_hash", "fp", "component_id", "kept_hash")


def keep_one(docs: DataFrame, similarity: float = NEAR, shingle: int = NEAR_SHINGLE, **search) -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest doc_id; columns as in docs.

    Rows without a doc_id stay. Of rows that repeat a doc_id and its text one stays; of different texts of one doc_id only
    those go that are near copies.
    """
    h, keep = text_hash(F.col("text")), [F.col(f"`{c}`") for c in docs.columns]
    groups = written(similar_components(docs, similarity, shingle, **search).where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash"))).alias("_kept")))
    gone = written(groups.where("not _kept").select("_id", "_hash").distinct())
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (h == F.col("_hash"))
    kept = docs.join(_few(gone), same, "left_anti").select(*keep)
    twice = written(groups.where("_kept").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash"))
    if twice.isEmpty():
        return kept
    few = _few(twice)
    return kept.join(few, same, "left_anti").unionByName(kept.join(few, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*keep)


def query(spark, sf_dir) -> DataFrame:
    """op10: fingerprint in hexadecimal and component of every document."""
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
