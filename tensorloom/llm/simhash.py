"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

Fingerprints: bit b of a document is 1 if more than half of its shingles' XXH64 have it.

Candidates: distinct fingerprints alone are compared. Four bands of 16 bits: two
fingerprints that differ in at most 3 bits agree in one band; of the other 48 bits, cut
into four again, they agree in one sub-band. So each fingerprint goes to 16 blocks keyed
by 28 bits, and every link shows in a block.

Comparison: in a block the fingerprints are stored as vertical bit planes; the distances
of many pairs are kept in carry-save counter planes and one plane of pairs beyond the
radius, and a tile is abandoned once all its pairs are beyond. Of the links in a tile
a spanning forest is enough. Blocks are compared in tiles of a bounded number of rows;
a block with more rows than that has its pairs of tiles dealt out to other tasks.

Components: alternating large-star and small-star steps over the forest edges, each
written to the shared folder, until the edges rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, keep_rows, located, looked_up, map_batches, quoted, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows of a block that are compared with each other in one tile.
TILE = 2048
#: Rows of a batch of fingerprints, which are a few bytes each.
NUMBERS = 20_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    space, digest = b" ", xxhash.xxh64_intdigest
    total, ones = n, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[at : min(n, at + (1 << 16)) + shingle - 1]
        grams = map(space.join, zip(*[part[k:] for k in range(shingle)])) if len(words) >= shingle else [space.join(words)]
        h = np.array([digest(g, SEED) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a signed long) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_batches(held, run, "doc_id long, text_hash long, fp long")


def blocks(fps: DataFrame) -> DataFrame:
    """fp in its 16 blocks: `key` holds band, sub-band and the 28 bits on which members agree."""
    fp = F.col("fp")
    keys = []
    for band in range(4):
        head = F.shiftrightunsigned(fp, 16 * band).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * band) - 1) if band else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 16 * (band + 1)), 16 * band)) if band < 3 else low
        for sub in range(4):
            tail = F.shiftrightunsigned(rest, 12 * sub).bitwiseAND(0xFFF)
            keys.append(F.lit((band * 4 + sub) << 28).bitwiseOR(F.shiftleft(head, 12)).bitwiseOR(tail))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of single bits for each fingerprint; fps is (n,) or, of several words each, (n, w)."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def _planes(fps: np.ndarray) -> np.ndarray:
    """A row of packed bits for each bit place: bit i of row b is bit b of fps[i]."""
    packed = np.packbits(_bits(fps).T, axis=1, bitorder="little")
    wide = np.zeros((packed.shape[0], -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


class Distances:
    """Counters of many lanes at once, as bit planes; a lane is far once its count exceeds the radius.

    A place of the counter holds its plane and at most one more of the same weight; a
    third is added to both by a carry-save adder, whose carry goes to the next place. The
    counters start so high that what leaves the last place says that the radius is passed.
    """

    def __init__(self, radius: int, shape) -> None:
        places = radius.bit_length()
        start = (1 << places) - 1 - radius
        self.sums = [np.full(shape, ONES if start >> k & 1 else np.uint64(0), np.uint64) for k in range(places)]
        self.waiting: list[np.ndarray | None] = [None] * places
        self.far = np.zeros(shape, np.uint64)

    def add(self, plane: np.ndarray, place: int = 0) -> None:
        if place == len(self.sums):
            self.far |= plane
        elif (other := self.waiting[place]) is None:
            self.waiting[place] = plane
        else:
            self.waiting[place] = None
            both = self.sums[place] ^ other
            carry = (self.sums[place] & other) | (both & plane)
            self.sums[place] = both ^ plane
            self.add(carry, place + 1)

    def result(self) -> np.ndarray:
        """The lanes that are far, after all planes."""
        for place in range(len(self.sums)):
            if self.waiting[place] is not None:
                self.add(np.zeros_like(self.far), place)
        return self.far


def _far(differences: Iterator[np.ndarray], shape, radius: int = RADIUS) -> np.ndarray:
    """Lanes with more than radius set bits among the differences; given up once all are."""
    counted = Distances(radius, shape)
    for k, d in enumerate(differences):
        counted.add(d)
        if k % 8 == 7 and (counted.far == ONES).all():
            return counted.far
    return counted.result()


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of left and right at radius or fewer differing bits."""
    planes = _planes(right)
    flip = np.where(_bits(left).T.astype(bool), ONES, np.uint64(0))
    rows, cols = [], []
    for at in range(0, len(left), 256):
        f = flip[:, at : at + 256]
        far = _far((planes[b][None, :] ^ f[b][:, None] for b in range(len(planes))), (f.shape[1], planes.shape[1]), radius)
        hit = np.unpackbits((~far).view(np.uint8), axis=1, bitorder="little")[:, : len(right)]
        i, j = np.nonzero(hit)
        rows.append(i + at)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join the same values as the edges (a, b), one less than a component has values."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(r, r)
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def _neighbours(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small blocks at once: rows sorted by key, compared at lag 1, 2, ...

    The difference planes at a lag are the bit planes of the rows XOR those of the rows
    `lag` later, so one pass over 64 planes compares a pair for every row.
    """
    links = ([], [])
    lag = 1
    at = np.arange(len(fps))
    while (at := at[at + lag < len(fps)]).size and (at := at[keys[at] == keys[at + lag]]).size:
        x, y = _planes(fps[at]), _planes(fps[at + lag])
        far = _far((x[b] ^ y[b] for b in range(64)), x.shape[1])
        hit = at[np.unpackbits((~far).view(np.uint8), bitorder="little")[: len(at)].astype(bool)]
        links[0].append(fps[hit])
        links[1].append(fps[hit + lag])
        lag += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in links)


SMALL = 32
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("tile", pa.int64())])


def _edge_batch(a, b) -> pa.RecordBatch:
    a, b = forest(np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64))
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none], schema=EDGES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> edges; rows of a block beyond its first tile also
    come out as members (a = fp, key, tile) for the comparison of tiles with each other."""
    key, held = None, np.zeros(0, np.uint64)  # the block that the batches seen so far end in
    tiles = 0

    def close(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fps) > 1:
            i, j = near_pairs(fps, fps)
            yield _edge_batch(fps[i[i < j]], fps[j[i < j]])

    def members(fps: np.ndarray, tile: int) -> pa.RecordBatch:
        n = len(fps)
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, tile))], schema=EDGES)

    for b in batches:
        ks, fs = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.diff(ks)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(ks)]
        small = (ends - starts <= SMALL) & (starts > 0) & (ends < len(ks))
        take = np.repeat(small, ends - starts)
        if take.any():
            yield _edge_batch(*_neighbours(fs[take], ks[take]))
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
            if ks[s] != key:
                yield from close(held)
                if tiles:
                    yield members(held, tiles)
                key, held, tiles = int(ks[s]), np.zeros(0, np.uint64), 0
            held = np.r_[held, fs[s:e]]
            while len(held) > TILE:
                full, held = held[:TILE], held[TILE:]
                yield from close(full)
                yield members(full, tiles)
                tiles += 1
    yield from close(held)
    if tiles:
        yield members(held, tiles)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, side, fp) sorted by pair: the links between the two tiles of each pair."""
    pair, sides = None, ([], [])

    def close() -> Iterator[pa.RecordBatch]:
        x, y = (np.asarray(s, np.int64).view(np.uint64) for s in sides)
        if len(x) and len(y):
            i, j = near_pairs(x, y)
            yield _edge_batch(x[i], y[j])

    for b in batches:
        for p, s, f in zip(b.column("pair").to_pylist(), b.column("side").to_pylist(), b.column("fp").to_pylist()):
            if p != pair:
                yield from close()
                pair, sides = p, ([], [])
            sides[s].append(f)
    yield from close()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints fps into their components."""
    schema = "a long, b long, key long, tile long"
    sorted_blocks = blocks(fps).repartition("key").sortWithinPartitions("key")
    found = written(map_batches(sorted_blocks, _compare, schema, NUMBERS), "simhash-links")
    edges = found.filter("key IS NULL").select("a", "b")
    large = found.filter("key IS NOT NULL")
    tiles = large.groupBy("key").agg((F.max("tile") + 1).alias("n"))
    if not tiles.isEmpty():  # blocks of several tiles: every pair of tiles once
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
        dealt = large.join(tiles, "key").select(F.col("a").alias("fp"), "key", "tile", other).filter("tile != other")
        low, high = F.least("tile", "other"), F.greatest("tile", "other")
        dealt = dealt.select("fp", F.concat_ws(":", "key", low, high).alias("pair"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
        crossed = map_batches(dealt.repartition("pair").sortWithinPartitions("pair"), _cross, schema, NUMBERS)
        edges = edges.unionByName(crossed.select("a", "b"))
    return edges


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has an edge.

    Large-star: a node hands its larger neighbours to the smallest of its neighbourhood.
    Small-star: it hands its smaller ones there. The edges end as stars around the
    smallest nodes after about the logarithm of the number of nodes in rounds. Minima are
    aggregated before the shuffle, so a node may have any number of neighbours.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        seen = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = seen.join(least, "u")
        if both:
            return joined.filter("v > u AND v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                joined.filter("v < u AND u != m").select(F.col("u").alias("a"), F.col("m").alias("b"))
            ).distinct()
        return joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = written(star(star(now, True), False), "components")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, text_hash, root.

    Words are lower-cased (A-Z); a text of fewer words than a shingle is one shingle; null
    and empty texts have fingerprint zero, linked like any other. component_id is the
    smallest doc_id reachable over links of at most 3 differing bits; rows that repeat a
    text or identifier are rows of their own. root is the smallest fingerprint of the
    component, and tells components apart where identifiers repeat. An empty table gives
    an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    roots = components(links(fps.select("fp").distinct()))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "root")
    # a fingerprint that many rows share (all empty texts have one) meets its component in many tasks
    found = looked_up(fps, named, rooted.count(), ["fp"], F.struct("doc_id", "text_hash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, null being the largest.

    Rows that share that identifier tie; the smallest hash of their texts and then the
    locator decide. An empty table gives an empty result.
    """
    rows = located(docs, "simhash-input")
    text = F.col(f"row.{quoted(text_col)}").cast("string")
    held = rows.select(F.col(f"row.{quoted(id_col)}").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), "file", "pos")
    found = simhash_components(rows.select(F.col(f"row.{quoted(id_col)}").alias("doc_id"), text.alias("text"))).select("text_hash", "root").distinct()
    return keep_rows(rows, least_of_each(held.join(found, "text_hash"), "text_hash"))


def least_of_each(rows: DataFrame, *ties: str) -> DataFrame:
    """file, pos, kept of rows (root, doc_id, file, pos): one row of each root is kept."""
    rows = written(rows.select("root", "doc_id", *ties, "file", "pos"), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ties, "file", "pos")
    stay = rows.groupBy("root").agg(F.min(order).alias("s")).select("s.file", "s.pos", F.lit(True).alias("kept"))
    return rows.select("file", "pos").join(stay, ["file", "pos"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
