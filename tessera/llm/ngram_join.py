"""N-gram Jaccard join: documents whose sets of word n-grams are similar, by signature trees, and the components they form.

A document's set is that of its n-word shingles; with fewer words, its whole sequence is the only one. Two documents
link if |A and B| / |A or B| is at least the threshold. Every link is found: nothing depends on a random choice.

1. Equal sets are one node: the smallest id of its rows stands for them (a digest of the set, 128 bits).
2. Dealing. Shingles have one order for all sets: rare ones first (by the number of sets that have them, counted over all
   documents and rounded to quarter octaves), then by hash. Two similar sets have a shingle in common among the first
   n - ceil(threshold * n) + 1 of each in this order. So sets meet by each of these that another set has too; a set whose
   first shingles are all its own meets nobody. Counts are made and fetched in blocks: a unit of texts sends its different
   shingles to the parts that count them, and gets their ranks back. No group of sets is cut or capped.
3. Hubs. In a group of near copies nearly all link with any of them, so each member of like size is compared with the
   group's first set, its hub, a pair once however many groups it has in common. That spares the trees work. Groups of one hub
   are one from here on, so that a set goes to each hub once; what has two sets only is settled.
4. Signature trees search every group whose sets are not all in one component yet. Leaves are sets, each node holds the
   bitwise or of its sets' token bitmaps, the range of their sizes and the most tokens that any of them has beyond its
   bits. Sets of one octave of sizes have one tree, with bitmaps of a width that suits their sizes. Two trees, or one with
   itself, are traversed together from their roots; a pair of nodes is dropped if its sizes are too far apart, if the
   common bits and the smaller excess leave too little overlap, or if both lie in one component. Pairs of leaves are
   compared exactly. A group's largest component and its other sets are dealt to parts of about `tree_tokens` tokens each;
   pairs of parts within the largest component need no search, so that a group with few others costs its size.
5. Components of all links, by rounds of large-star and small-star.

Defined cases: null and empty texts have an empty set and link with nothing. Rows with a null id get no component and link
with nothing. Rows with the same id and different sets are different documents that have one id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, discard, documents, parts, small_batches, spread_join, stored
from .tidying import packed, squeezed, tidied, unpacked, unsqueezed
from .words import _PLACE, Words, binary, chunks, mix

_U = np.uint64
TREE_TOKENS = 1 << 16
FANOUT = 4
#: Quarter octaves of small counts.
_QUARTERS = (4 * np.log2(np.maximum(np.arange(1 << 12), 1))).astype(np.uint8)
_UNIT = 1 << 20


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles."""
    found = Words(texts, lower=True)
    hashes, _ = found.windows(words)
    first = found.first.tolist()
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(hashes[a : b - words + 1]))
        elif b > a:
            out.append(mix((found.hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingled(texts: list[bytes], words: int) -> list[np.ndarray]:
    """shingle_sets(), an eighth of a megabyte at a time."""
    return [s for _, some in chunks(texts, 1 << 17) for s in shingle_sets(some, words)]


def ranked_first(n: int, percent: int) -> int:
    """How many of n shingles, the first in a common order, no similar set can do without."""
    return n - -(-percent * n // 100) + 1


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of the different sets, sorted, and how many of these sets have each."""
    different = {digest(own): own for own in sets if len(own)}
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *different.values()]), return_counts=True)


#: kind 0: a unit's texts and their hashes; 1: a unit's shingles of one part, 32 bits of each, and how many of its sets have each; 2: their ranks.
_BLOCK = "kind int, unit long, part long, ids array<long>, tags array<long>, texts binary, shingles binary, counts binary"


def _rows(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    n = max(len(x) for x in columns.values())
    types = {"kind": pa.int32(), "unit": pa.int64(), "part": pa.int64(), "ids": pa.list_(pa.int64()), "tags": pa.list_(pa.int64()), "texts": pa.binary(), "shingles": pa.binary(), "counts": pa.binary()}
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in types.items()], list(types))


def _dealt(shingles: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted shingles by part, and where each part's begin, one after the last included."""
    part = (shingles & _U(0xFFFFFFFF)) % _U(n_parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n_parts + 1, dtype=np.uint64))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of so many batches that they fill a unit."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        texts += binary(batch.column("text"))
        size += batch.nbytes
        if size >= _UNIT:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _units(words: int, n_parts: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        unit = (context.partitionId() if context else 0) << 32
        for ids, texts in _gathered(batches):
            for begin, own in chunks(texts, 2 * _UNIT):
                tags = np.array([xxhash.xxh64_intdigest(t, 42) for t in own], np.uint64).view(np.int64)  # as Spark's
                own = [b" ".join(t.lower().split()) for t in own]
                sets = shingled(own, words)
                shingles, n = counted(sets)
                order, edge = _dealt(shingles, n_parts)
                short, n = (shingles[order] >> _U(32)).astype("<u4"), np.minimum(n[order], 255).astype(np.uint8)
                used = np.flatnonzero(np.diff(edge))
                yield _rows(0, unit=pa.array([unit]), ids=pa.array([ids[begin : begin + len(own)]], pa.list_(pa.int64())), tags=pa.array([tags.tolist()], pa.list_(pa.int64())), texts=pa.array([squeezed(b"\n".join(own))], pa.binary()))
                if len(used):
                    spans = [slice(edge[p], edge[p + 1]) for p in used.tolist()]
                    yield _rows(1, unit=pa.array(np.full(len(used), unit)), part=pa.array(used), shingles=pa.array([packed(short[x]) for x in spans], pa.binary()), counts=pa.array([squeezed(n[x].tobytes()) for x in spans], pa.binary()))
                unit += 1

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part: for each unit's block of shingles their ranks: 0 for what one set of all has, then by quarter octaves."""

    def of(rows: list[tuple]) -> pa.RecordBatch:
        edge = np.cumsum([0, *(int.from_bytes(r[2][:8], "little") // 4 for r in rows)])
        keys = np.empty(int(edge[-1]), np.uint64)  # a shingle's 32 bits and its place
        n = np.empty(len(keys), np.uint8)
        for r, begin, end in zip(rows, edge, edge[1:], strict=False):
            keys[begin:end] = unpacked(r[2])
            n[begin:end] = np.frombuffer(unsqueezed(r[3]), np.uint8)
        keys <<= _U(32)
        keys |= np.arange(len(keys), dtype=np.uint32)
        keys.sort()
        place = keys.astype(np.uint32)
        keys >>= _U(32)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).astype(np.uint32)
        total = np.add.reduceat(n[place], first, dtype=np.uint32)
        own = _QUARTERS[np.minimum(total, len(_QUARTERS) - 1)]
        many = np.flatnonzero(total >= len(_QUARTERS))
        own[many] = 4 * np.log2(total[many])
        n[place] = np.repeat(own, np.diff(first, append=np.uint32(len(keys))))
        return _rows(2, unit=pa.array([r[1] for r in rows]), part=pa.array([r[0] for r in rows]), counts=pa.array([squeezed(n[a:b].tobytes()) for a, b in zip(edge, edge[1:], strict=False)], pa.binary()))

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "unit", "shingles", "counts")), strict=True):
            if rows and row[0] != rows[0][0]:
                yield of(rows)
                rows = []
            rows.append(row)
    if rows:
        yield of(rows)


def _keyed(words: int, percent: int, n_parts: int):
    """Sorted by unit, kind and part: of each document the digest of its set, and its first shingles that others have too; for
    the smallest id of a unit's equal sets that has such, also the set."""

    def of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, _, ids, tags, blob, _ = rows[0]
        texts = unsqueezed(blob).split(b"\n")
        sets = shingled(texts, words)
        shingles, _ = counted(sets)
        order, _ = _dealt(shingles, n_parts)
        rank = np.empty(len(shingles), np.uint8)
        rank[order] = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(unsqueezed(r[5]), np.uint8) for r in rows[1:])])
        digests = [digest(own) for own in sets]
        least: dict[bytes, int] = {}
        for k, d in enumerate(digests):
            if ids[k] is not None and (d not in least or ids[k] < ids[least[d]]):
                least[d] = k
        keys, tokens = [], []
        for k, own in enumerate(sets):
            met = None
            if len(own) and least.get(digests[k]) == k:
                own_rank = rank[np.searchsorted(shingles, own)]
                first = np.lexsort((own, own_rank))[: ranked_first(len(own), percent)]
                met = own[first[own_rank[first] > 0]].view(np.int64)
            keys.append(met if met is not None and len(met) else None)
            tokens.append(own.tobytes() if keys[-1] is not None else None)
        pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
            ["doc_id", "tag", "n_shingles", "d1", "d2", "keys", "tokens"],
        )

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "unit", "ids", "tags", "texts", "counts")), strict=True):
                if row[0] == 0 and rows:
                    yield from of(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from of(rows)

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _linked(percent: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c) for c in ("left", "right"))
            keep = [similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), percent) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Level:
    """Nodes of one depth: or-combined bitmaps, sizes from low to high, most tokens beyond a set's own bits."""

    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray):
        self.bits, self.low, self.high, self.excess = bits, low, high, excess

    def above(self) -> "Level":
        start = np.arange(0, len(self.low), FANOUT)
        return Level(np.bitwise_or.reduceat(self.bits, start, axis=0), np.minimum.reduceat(self.low, start), np.maximum.reduceat(self.high, start), np.maximum.reduceat(self.excess, start))


class SignatureTree:
    """Level 0 holds the sets in the order given."""

    def __init__(self, sets: list[np.ndarray], width: int, levels: int):
        bits = np.zeros((len(sets), (1 << width) // 64), np.uint64)
        for k, own in enumerate(sets):
            at = own >> _U(64 - width)
            np.bitwise_or.at(bits[k], (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.levels = [Level(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64))]
        for _ in range(levels):
            self.levels.append(self.levels[-1].above())


class Groups:
    """Which component each set is in; the smaller of two that join takes the other's number."""

    def __init__(self, of: np.ndarray):
        _, self.of = np.unique(of, return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        self.members = dict(enumerate(np.split(order, np.cumsum(np.bincount(self.of))[:-1])))

    def join(self, k: int, l: int) -> None:
        small, large = sorted((int(self.of[k]), int(self.of[l])), key=lambda g: len(self.members[g]))
        moved = self.members.pop(small)
        self.of[moved] = large
        self.members[large] = np.concatenate([self.members[large], moved])


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (k, l) that join different groups, enough to join all that links can: of sets of `left` with each other, or of
    `left` (0 ..) with `right` (len(left) ..). groups: a component's number for each set, in the same order."""
    sets = left if right is None else left + right
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    octave = np.frexp(size)[1]
    # near copies have like sizes, and often the same smallest token
    order = np.lexsort((np.array([s[0] for s in sets], np.uint64), np.floor(8 * np.log2(size)), octave))
    side = np.arange(len(sets)) >= len(left)
    found = Groups(groups)
    links: list[tuple[int, int]] = []
    held = {o: order[octave[order] == o] for o in np.unique(octave).tolist()}
    none = np.zeros(0, np.int64)
    for o, own in held.items():
        pairs = [(own, None)] if right is None else [(own[~side[own]], own[side[own]])]
        for j in range(1, math.ceil(math.log2(100 / percent)) + 1):
            far = held.get(o + j, none)
            pairs += [(own, far)] if right is None else [(own[~side[own]], far[side[far]]), (far[~side[far]], own[side[own]])]
        for a, b in pairs:
            if len(a) and (b is None or len(b)):
                links += _searched(sets, a, b, found, percent)
    return links


def _searched(sets: list[np.ndarray], own: np.ndarray, other: np.ndarray | None, groups: Groups, percent: int) -> list[tuple[int, int]]:
    """tree_links() of the sets `own` among themselves, or with those of `other`."""
    same = other is None
    sides = [own] if same else [own, other]
    most = max(len(sets[k]) for side in sides for k in side.tolist())
    width = max(8, (4 * most - 1).bit_length())
    depth = max(math.ceil(math.log(max(len(side), 2), FANOUT)) for side in sides)
    trees = [SignatureTree([sets[k] for k in side.tolist()], width, depth) for side in sides]
    one, two, own, other = trees[0], trees[-1], sides[0], sides[-1]
    links: list[tuple[int, int]] = []

    def uniform() -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each level's nodes in both trees: their group, or else -1 and -2."""
        out = []
        for where, none in ((own, -1), (other, -2)):
            low = high = groups.of[where]
            levels = [low]
            for _ in range(depth):
                start = np.arange(0, len(low), FANOUT)
                low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
                levels.append(np.where(low == high, low, none))
            out.append(levels)
        return list(zip(*out, strict=True))

    groups_at = uniform()
    child = np.arange(FANOUT)
    step = max(16, (1 << 20) // max(1, (1 << width) // 64) // FANOUT**2)
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > step:
            stack.append((level, a[step:], b[step:]))
            a, b = a[:step], b[:step]
        x, y = one.levels[level], two.levels[level]
        keep = (groups_at[level][0][a] != groups_at[level][1][b]) & (100 * x.high[a] >= percent * y.low[b]) & (100 * y.high[b] >= percent * x.low[a])
        a, b = a[keep], b[keep]
        overlap = np.bitwise_count(x.bits[a] & y.bits[b]).sum(1, dtype=np.int64) + np.minimum(x.excess[a], y.excess[b])
        keep = (100 + percent) * overlap >= percent * (x.low[a] + y.low[b])
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level:
            a, b = (np.repeat(a * FANOUT, FANOUT**2) + np.tile(np.repeat(child, FANOUT), len(a)), np.repeat(b * FANOUT, FANOUT**2) + np.tile(child, FANOUT * len(b)))
            keep = (a < len(one.levels[level - 1].low)) & (b < len(two.levels[level - 1].low)) & ((a <= b) if same else True)
            stack.append((level - 1, a[keep], b[keep]))
            continue
        new = False
        for k, l in zip(own[a].tolist(), other[b].tolist(), strict=True):
            if groups.of[k] != groups.of[l] and similar(sets[k], sets[l], percent):
                links.append((k, l))
                groups.join(k, l)
                new = True
        if new:
            groups_at = uniform()
    return links


def _trees(percent: int):
    """Sorted by (key, p, q): a block's sets, or those of its parts p and q, to links."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        p, q = rows[0][1], rows[0][2]
        sides = [rows] if p == q else [[r for r in rows if r[3] == s] for s in (p, q)]
        if not all(sides):
            return []
        rows = [r for side in sides for r in side]
        sets = [np.frombuffer(r[6], "<u8") for r in rows]
        _, groups = np.unique(np.array([r[5] for r in rows]), return_inverse=True)
        cut = len(sides[0])
        return [(rows[k][4], rows[l][4]) for k, l in tree_links(sets[:cut], sets[cut:] if len(sides) > 1 else None, groups, percent)]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q", "side", "id", "component", "tokens")), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    found += links(rows)
                    rows = []
                rows.append(row)
            yield _pairs(found)
        if rows:
            yield _pairs(links(rows))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, tree_tokens: int = TREE_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), tag (xxhash64 of the text, null as empty) and
    component (a number of its own; null without a set or an id) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    n = parts(spark)
    units = stored(docs.select("doc_id", "text").mapInArrow(_units(words, 2 * n), _BLOCK), "shingle-units")
    ranks = units.where("kind = 1").repartition(2 * n, "part").sortWithinPartitions("part").mapInArrow(_ranks, _BLOCK)
    both = units.where("kind = 0").unionByName(ranks).repartition(n, "unit").sortWithinPartitions("unit", "kind", "part")
    sets = stored(both.mapInArrow(_keyed(words, percent, 2 * n), "doc_id long, tag long, n_shingles long, d1 long, d2 long, keys array<long>, tokens binary"), "shingle-sets")
    discard(units)

    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    copies = stored(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    # of each digest the row of the smallest id; a repeated row may be there twice
    met = full.where("keys IS NOT NULL").select("doc_id", "d1", "d2", "n_shingles", "keys", "tokens")
    met = met.join(copies.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "id", "node"), (F.col("id") == F.col("doc_id")) & (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")))
    met = stored(met.select("node", F.col("n_shingles").alias("size"), "keys", "tokens").dropDuplicates(["node"]), "met-sets")

    groups = stored(met.select("node", "size", F.explode("keys").alias("key")), "groups")
    first = F.struct("node", "size")
    several = groups.groupBy("key").agg(F.min(first).alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("hub.node <> last")
    several = stored(several.select("key", "n", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")), "hubs")
    # all groups of one hub are searched together
    members = stored(spread_join(groups, several, ["key"]).select("hub", "hub_size", "node", "size").distinct(), "members")
    discard(groups, several)
    tokens = met.select("node", "tokens")
    like = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    pairs = members.where(F.col("node") != F.col("hub")).where(like).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pairs = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a")
    pairs = pairs.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b").select("a", "b", "left", "right")
    near = stored(pairs.mapInArrow(_linked(percent), "a long, b long"), "hub-links")
    label = connected_components(near)

    placed = stored(members.join(label, "node", "left").select("hub", "node", "size", F.coalesce("label", "node").alias("component")), "placed")
    discard(members)
    mixed = placed.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    mixed = mixed.groupBy("hub").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.max(F.struct("tokens", "component")).alias("main"), F.count(F.lit(1)).alias("components"))
    # the one pair of two sets is compared
    mixed = mixed.where("components > 1 AND n > 2")
    mixed = mixed.select("hub", "n", F.col("main.component").alias("main"), F.ceil(F.col("main.tokens") / tree_tokens).cast("int").alias("large"), F.ceil((F.col("tokens") - F.col("main.tokens")) / tree_tokens).cast("int").alias("rest"))
    # sides 0 .. large - 1 hold the largest component, the next ones the other sets; pairs of sides have a set of the latter
    rows = spread_join(placed, stored(mixed, "mixed"), ["hub"])
    inside, hashed = F.col("component") == F.col("main"), F.xxhash64("node")
    rows = rows.withColumn("side", F.when(inside, F.pmod(hashed, F.col("large"))).otherwise(F.col("large") + F.pmod(hashed, F.col("rest"))).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.when(inside, F.col("large")).otherwise(0), F.col("large") + F.col("rest") - 1)))
    rows = rows.select(F.col("hub").alias("key"), F.least("side", "t").alias("p"), F.greatest("side", "t").alias("q"), "side", "node", "component")
    rows = rows.join(tokens, "node").repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    far = stored(rows.select("key", "p", "q", "side", F.col("node").alias("id"), "component", "tokens").mapInArrow(_trees(percent), "a long, b long").distinct(), "tree-links")
    discard(placed)

    # the hubs' components stay as they are; only what trees have joined is new
    joined = far.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    over = connected_components(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    whole = copies.join(label, "node", "left").select("d1", "d2", "id", "n", F.coalesce("label", "node").alias("near"))
    whole = whole.join(over.withColumnRenamed("label", "far"), F.col("near") == F.col("node"), "left").select("d1", "d2", "id", "n", F.coalesce("far", "near").alias("component"))
    whole = stored(whole, "placed-copies")
    first = whole.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("digests")).where("digests > 1")
    whole = stored(whole.join(first, "component", "left").select("d1", "d2", "n", "component", F.coalesce("component_id", "id").alias("component_id")), "components")
    out = ["doc_id", "n_shingles", "component_id", "tag", "component"]
    linked = spread_join(full.select("doc_id", "tag", "n_shingles", "d1", "d2"), whole, ["d1", "d2"]).select(*out)
    alone = sets.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return linked.unionByName(alone.select(*out))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), words=4, percent=85).drop("tag", "component")


OP1_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)"""
