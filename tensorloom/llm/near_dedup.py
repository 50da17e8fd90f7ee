"""Near-duplicates by a five-word Jaccard similarity of at least 0.8, compared by wide SimHash.

A SimHash of 64 bits at a radius of 3 can't find them: at 0.8 two of them differ in some
10 bits, and in up to 20, for which no blocks of agreeing bits are exact. So the method
is kept for the comparison, with fingerprints of 256 bits, and blocks come from elsewhere.

Blocks: 240 min-hashes of a text's shingle set in 40 bands of 6; texts that agree in a
band meet. Two texts of similarity 0.8 agree in none with chance (1 - 0.8^6)^40, which is
5e-6, and more similar ones with less.

Comparison: the components of what meets hold those of the links. The shingle sets of
their members alone are sent on, in tiles of a bounded size: its pairs within RADIUS of
256 bits, found by bit-sliced comparison of their fingerprints, are the ones whose whole
sets are compared, unless joined already. At 0.8 some 39 to 51 bits differ, six deviations
below the radius; of unrelated texts 128 do. A component of several tiles is joined inside
its tiles first, then one row of each part goes on to other tiles; what is still apart in
the end is compared part by part, all pairs of tiles. So a group of copies costs its
length. Shingles and texts are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, located, looked_up, map_batches, quoted, shared, written
from .simhash import LOWER, NUMBERS, SEED, components, least_of_each, near_pairs

SHINGLE = 5
BANDS, ROWS = 40, 6
#: Words of a wide fingerprint, and the differing bits up to which two texts are compared by their sets.
WIDE, RADIUS = 4, 90
#: Texts and shingles of a tile, about.
TILE, TILE_SHINGLES = 256, 1_000_000
_DRAW = np.random.RandomState(SEED)
_TIMES = (_DRAW.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PLUS = _DRAW.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_KEYS = _DRAW.randint(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _DRAW.randint(0, 1 << 63, (2, WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted XXH64 of the distinct shingles; fewer words than a shingle are one, as is no word."""
    words = (text or "").encode().translate(LOWER).split()
    space, digest = b" ", xxhash.xxh64_intdigest
    grams = map(space.join, zip(*[words[k:] for k in range(shingle)])) if len(words) >= shingle else [space.join(words)]
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of the set's min-hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    half = BANDS * ROWS // 2
    for at in range(0, len(found), 512):
        part = found[at : at + 512]
        for rows, h in ((slice(0, half), part.astype(np.uint32)), (slice(half, None), (part >> np.uint64(32)).astype(np.uint32))):
            np.minimum(least[rows], (h[None, :] * _TIMES[rows] + _PLUS[rows]).min(axis=1), out=least[rows])
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _KEYS).sum(axis=1, dtype=np.uint64)


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set in WIDE words: each shingle's hash is mixed anew for every word."""
    ones = np.zeros(WIDE * 64, np.int64)
    for at in range(0, len(found), 1 << 14):
        h = found[at : at + (1 << 14), None] * _SPREAD[0]
        h = (h ^ (h >> np.uint64(29))) * _SPREAD[1]
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [band_keys(shingles(t.as_py())) for t in b.column("text")]
        nodes = np.repeat(b.column("node").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()), pa.array(nodes)], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n in range(b.num_rows):
            found = shingles(b.column("text")[n].as_py()).view(np.int64)
            held = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([b.column("root").slice(n, 1), b.column("node").slice(n, 1), held, pa.array([len(found)], pa.int64())], ["root", "node", "found", "size"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least 0.8, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def joined(tiles: list[int], known: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[tuple[int, int]]]:
    """Of rows of two tiles (or the one), parts `known` to be joined: roots by place, and the links that join parts."""
    first = {c: k for k, c in reversed(list(enumerate(known)))}
    root = [first[c] for c in known]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    fps = np.stack([wide_fingerprint(s.view(np.uint64)) for s in sets])
    tile = np.array(tiles)
    sides = [np.flatnonzero(tile == t) for t in sorted(set(tiles))]
    i, j = near_pairs(fps[sides[0]], fps[sides[-1]], RADIUS)
    for a, b in zip(sides[0][i].tolist(), sides[-1][j].tolist()):
        if (len(sides) > 1 or a < b) and (p := find(a)) != (q := find(b)) and similar(sets[a], sets[b]):
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return [find(k) for k in range(len(sets))], out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int], list[np.ndarray]]]:
    """tiles, nodes, parts and sets of each group of rows (root, low, high, tile, node, part, found) sorted by the first three."""
    key, held = None, ([], [], [], [])
    for b in batches:
        column = lambda c: b.column(c).to_pylist()
        keys = zip(column("root"), column("low"), column("high"))
        for n, (k, *row) in enumerate(zip(keys, column("tile"), column("node"), column("part"))):
            if k != key:
                if held[0]:
                    yield held
                key, held = k, ([], [], [], [])
            for place, value in zip(held, (*row, b.column("found")[n].values.to_numpy().copy())):
                place.append(value)
    if held[0]:
        yield held


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, part for every row of each tile: the part is named by one of its nodes."""
    for tiles, nodes, known, sets in _groups(batches):
        roots, _ = joined(tiles, known, sets)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[k] for k in roots], pa.int64())], ["node", "part"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between parts of each pair of tiles."""
    for tiles, nodes, known, sets in _groups(batches):
        if len(set(known)) > 1:
            _, found = joined(tiles, known, sets)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[f[side]] for f in found], pa.int64()) for side in (0, 1)], ["node", "part"])


def _dealt(rows: DataFrame, run) -> DataFrame:
    """run over the groups (root, low, high) of rows."""
    rows = rows.select("root", "low", "high", "tile", "node", "part", "found")
    return map_batches(rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high"), run, "node long, part long", NUMBERS)


def _tiles(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and n, the number of tiles of their rows."""
    return rows.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("size") / TILE_SHINGLES)).alias("n"))


def _in_tiles(sets: DataFrame, turn: int) -> DataFrame:
    """node, part of the rows of sets, each compared with those of its tile alone."""
    tile = F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("n"))
    rows = sets.join(_tiles(sets, "root"), "root").withColumns({"tile": tile, "low": tile, "high": tile, "part": F.col("node")})
    return written(_dealt(rows, _labels), "near-tiles")


def _between_parts(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between the parts of each root: all pairs of tiles but those inside one part.

    A part of more than a tile has tiles of its own, the others share tiles. So the work
    is that of large parts with each other and of the rest with everything.
    """
    held = sets.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = held.groupBy("root").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a != b").select("root")
    held = written(held.join(several, "root", "left_semi"), "near-open")
    sizes = _tiles(held, "root", "part").withColumn("own", F.when(F.col("n") > 1, F.col("part")))
    small = _tiles(held.join(sizes.filter("own IS NULL").select("root", "part"), ["root", "part"], "left_semi"), "root")
    rows = held.join(sizes, ["root", "part"]).join(small.withColumnRenamed("n", "shared_n"), "root", "left")
    number = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("part"), "shared_n")).otherwise(F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("n"))))
    rows = written(rows.select("root", "node", "part", "own", "found", number.alias("tile")), "near-parts")
    tiles = rows.select("root", "tile", "own").distinct()
    other = tiles.select("root", F.col("tile").alias("other"), F.col("own").alias("other_own"))
    pairs = tiles.join(other, "root").filter("NOT own <=> other_own OR own IS NULL").select("root", "tile", "other")
    met = rows.join(pairs, ["root", "tile"]).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    return _dealt(met, _edges)


def _whole(found: DataFrame) -> DataFrame:
    """node, root of components, with a row for the roots too."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def links(texts: DataFrame) -> DataFrame:
    """Edges (a, b) that join the rows (node, text) into the components of their links; nodes may repeat."""
    keys = written(map_batches(texts, _bands, "key long, node long"), "near-bands")
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    near = keys.join(least, "key").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    members = written(_whole(components(near)), "near-members")
    # only texts of members leave the scan if these stay below a bound
    found = texts.join(shared(members, members.count()), "node").groupBy("root", "node").agg(F.first("text").alias("text"))
    sets = written(map_batches(found, _sets, "root long, node long, found array<long>, size long"), "near-sets")
    found = _in_tiles(sets, 0)
    edges = found.filter("node != part")
    large = written(_tiles(sets, "root").filter("n > 1").select("root"), "near-large")
    if not large.isEmpty():
        # of components of several tiles one row of each part goes on, in other tiles, while that joins parts
        sets = written(sets.join(large, "root", "left_semi"), "near-large-sets")
        turn, before, left = 0, 0, sets
        while turn < 2 or now < 0.8 * before:
            left = written(left.join(found.select(F.col("part").alias("node")).distinct(), "node", "left_semi"), "near-parts")
            turn, before, found = turn + 1, left.count(), _in_tiles(left, turn + 1)
            edges = edges.unionByName(found.filter("node != part"))
            now = found.select("part").distinct().count()
        parts = written(_whole(components(edges.toDF("a", "b"))).toDF("node", "part"), "near-joined")
        edges = edges.unionByName(_between_parts(sets, parts))
    return edges.toDF("a", "b")


def named_nodes(rows: DataFrame, text: Column, node: Callable[[Column], Column]) -> DataFrame:
    """rows with `node`, a number for each distinct text.

    A number that stands for several texts, which their digests tell, is replaced by a
    hash of the digest, until none does. Such numbers are so few that they are looked up.
    """
    digest, turn = F.sha2(F.encode(text, "UTF-8"), 256), 0
    rows = rows.withColumn("node", node(text))
    while True:
        kinds = rows.select("node", digest.alias("digest")).groupBy("node").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
        several = written(kinds.where("a < b").select("node", F.lit(True).alias("_several")), "near-collisions")
        n = several.count()
        if not n:
            return rows
        turn += 1
        again = F.xxhash64(digest, F.lit(turn))
        rows = looked_up(rows, several, n, ["node"], text).withColumn("node", F.when(F.col("_several"), again).otherwise(F.col("node"))).drop("_several")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """docs with one row of each component of texts linked by a similarity of at least 0.8: that with the smallest doc_id.

    Words are lower-cased (A-Z); empty and null texts are like each other. A null
    identifier is the largest. Rows that share the smallest identifier tie; the smallest
    number of their texts and then the locator decide. An empty table gives an empty
    result; further columns pass through, whatever their names. node maps a text to a
    number; any map gives the right rows.
    """
    rows = located(docs, "near-input")
    text = F.coalesce(F.col(f"row.{quoted(text_col)}").cast("string"), F.lit(""))
    named = named_nodes(rows, text, node)
    roots = _whole(components(links(named.select("node", text.alias("text")))))
    held = named.select(F.col(f"row.{quoted(id_col)}").cast("long").alias("doc_id"), "node", "file", "pos")
    roots = written(roots, "near-roots")
    # a number that many rows share meets its root in many tasks
    rooted = looked_up(held, roots, roots.count(), ["node"], F.struct("file", "pos")).withColumn("root", F.coalesce("root", "node"))
    return keep_rows(rows, least_of_each(rooted, "node"))
