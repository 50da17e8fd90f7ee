"""Phrases whose words stand together more often than their parts would: counts by top-order marginalisation.

Every word of a piece leads one window, the longest one: itself and the words after it in
columns of their own, padded where the piece ends. Only these windows are counted; a
ROLLUP over the columns adds their counts up into those of all shorter prefixes, and a
prefix that ends in a pad is none. So the table of words is not expanded once for each
length, and the number of all words is the level above the first column.

Before that, a window is cut where it can't matter: a phrase that occurs LEAST times has
only parts that do. Passes over the text count hashes of words and pairs, of those triples
whose pairs are left, and of those quadruples whose triples are left; a hash that reaches
LEAST sets a bit in a filter of 2^FILTER_BITS bits (32 MB, whatever the input). A window
ends before the prefix whose bit is unset. What shares a bit only lets a window grow longer
than it needs to, so counts stay exact; the more there is, the less the filter saves.
What goes through a shuffle in these passes are hashes of HASH_BITS bits, not words.

A null text is empty, a null language is `und`, an empty table gives no rows; repeated
rows count each, texts may have any length and further columns any name. Ties go by the
order that the contract states. Phrases are told apart by their text: words have no blanks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, looked_up, map_batches, written

LEAST, TOP, ORDER = 30, 2000, 4
#: Bits that a hash keeps, and those of them that name its bit of the filter.
HASH_BITS, FILTER_BITS = 40, 28
WORDS = [f"w{k}" for k in range(1, ORDER + 1)]
#: A phrase is dropped for a longer one around it that has at least this share (in percent) of its places.
ABSORBED = 80
SCALE = 2_000_000
#: Share of all cuts from which on a part is split.
HOT_SHARE = 1e-3


#: Bytes of a text that are split at once; a longer word is one part.
PART_BYTES = 1 << 20
WORD, BLANK, END = 0, 1, 2
KINDS = np.full(256, WORD, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = END
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd numbers of 64 bits: base of the words' polynomials, its inverse, and a multiplier.
BASE = 0x9E3779B97F4A7C15
INVERSE, MIX = pow(BASE, -1, 1 << 64), 0xD6E8FEB86659FD93


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of BASE and INVERSE modulo 2^64, as many as have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


@dataclass
class Tokens:
    """Words of a batch of texts: their bytes in `text`, hash, text, and whether the next word stands in the same piece."""

    text: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    joined: np.ndarray


def tokens_of(column: pa.Array, powers: Powers) -> Tokens:
    """All words of a column of texts, which Arrow holds one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, whole = offsets - offsets[0], LOWER[whole]
    n, at, ends_before, found = len(whole), 0, 0, []
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    while at < n:
        stop = min(n, at + PART_BYTES)
        while stop < n and KINDS[whole[stop]] == WORD and not first[stop]:  # no word is cut
            nxt = np.flatnonzero((KINDS[whole[stop : stop + PART_BYTES]] != WORD) | first[stop : min(n, stop + PART_BYTES)])
            stop = stop + int(nxt[0]) if len(nxt) else min(n, stop + PART_BYTES)
        kinds, here = KINDS[whole[at:stop]], first[at : stop + 1]
        word = kinds == WORD
        before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
        start, end = np.flatnonzero(word & (~before | here[:-1])), np.flatnonzero(word & (~after | here[1:])) + 1
        up, down = powers.first(stop - at + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((whole[at:stop].astype(np.uint64) + np.uint64(1)) * up[:-1])])
        ended = np.cumsum(kinds == END)
        found.append((start + at, end + at, _mixed((sums[end] - sums[start]) * down[start]), ended[start] + ends_before))
        at, ends_before = stop, ends_before + int(ended[-1])
    start, end, h, piece = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    doc = np.searchsorted(offsets, start, side="right") - 1
    joined = np.zeros(len(start), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return Tokens(whole.tobytes(), start, end, h, doc, joined)


class Filter:
    """Bits of the hashes that occur often enough, of all levels; without bits of a level all pass."""

    def __init__(self, bits: np.ndarray, levels: int) -> None:
        self.bits, self.levels, self.hash_mask = bits, levels, (1 << HASH_BITS) - 1

    def passes(self, keys: np.ndarray, level: int) -> np.ndarray:
        if level > self.levels:
            return np.ones(len(keys), bool)
        at = keys & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def prefixes(self, t: Tokens, langs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length the hash of the prefix that each word leads, and whether the prefix exists with all its parts passing.

        A prefix of the first length that isn't counted yet is asked for its parts alone.
        """
        n = len(t.hash)
        keys, alive = [_mixed(t.hash + langs[t.doc])], []
        alive.append(self.passes(keys[0], 1))
        for k in range(1, ORDER):
            last = np.minimum(np.arange(n) + k, n - 1)
            key = _mixed(keys[-1] * np.uint64(MIX) + t.hash[last])
            next_ = np.concatenate([alive[-1][1:], [False]]) if n else alive[-1]
            alive.append(alive[-1] & next_ & t.joined & self.passes(key, k + 1))
            keys.append(key)
            if k > self.levels:
                break
        return keys, alive


def _mapped(docs: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(tokens, languages, hashes of languages) over batches of texts."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in rows:
            names = b.column("lang").to_pylist()
            hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
            yield from run(tokens_of(b.column("text"), powers), names, hashes)

    held = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(held, batches, schema)


def _often(docs: DataFrame, held: Filter, levels: list[int], least: int) -> np.ndarray:
    """The bits, packed, of all hashes of prefixes of these lengths that occur `least` times."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(t: Tokens, names: list[str], langs: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = shared.value
        keys, alive = held.prefixes(t, langs)
        chosen = np.concatenate([keys[k - 1][alive[k - 1]] & np.uint64(held.hash_mask) for k in levels])
        h, n = np.unique(chosen, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], ["h", "n"])

    often = _mapped(docs, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1) + 1  # Spark's bitmaps count from 1
    maps = often.select(place.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    out = np.zeros(max(1 << FILTER_BITS >> 3, 4096), np.uint8)
    for bucket, bits in maps.collect():  # 2^FILTER_BITS bits at most
        at = (bucket - 1) * len(bits)
        out[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
    shared.destroy()
    return out


def prefix_filter(docs: DataFrame, least: int) -> Filter:
    held = Filter(np.zeros(1, np.uint8), 0)
    for levels in ([1, 2], *([k] for k in range(3, ORDER + 1))):
        more = _often(docs, held, levels, least)
        held = Filter(more if not held.levels else held.bits | more, levels[-1])
    return held


def windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, w1 ..., n: the longest windows that words lead, padded with '', each once a batch with its number there."""
    shared = docs.sparkSession.sparkContext.broadcast(prefix_filter(docs, least))

    def run(t: Tokens, names: list[str], langs: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, alive = shared.value.prefixes(t, langs)
        reach = np.sum(alive, axis=0)
        used = np.zeros(len(reach) + ORDER, bool)  # words of some window
        for k in range(ORDER):
            used[np.flatnonzero(reach > k) + k] = True
        at, known = np.flatnonzero(used), {b"": 0}
        ids = np.zeros(len(used), np.int64)
        ids[at] = [known.setdefault(t.text[a:b], len(known)) for a, b in zip(t.start[at].tolist(), t.end[at].tolist())]
        lang_of = {x: k for k, x in enumerate(dict.fromkeys(names))}
        columns = [np.array([lang_of[x] for x in names], np.int64)[t.doc]]
        columns += [np.where(reach > k, ids[k : k + len(reach)], 0) for k in range(ORDER)]
        key = columns[0]
        for c in columns[1:]:  # numbers of distinct rows, column by column
            key = np.unique(key * len(known) + c, return_inverse=True)[1]
        _, chosen, n = np.unique(key, return_index=True, return_counts=True)
        words = pa.array([w.decode() for w in known])
        out = [pa.array(list(lang_of)).take(pa.array(columns[0][chosen])), *[words.take(pa.array(c[chosen])) for c in columns[1:]]]
        yield pa.RecordBatch.from_arrays([*out, pa.array(n)], ["lang", *WORDS, "n"])

    return _mapped(docs, run, ", ".join(f"{c} string" for c in ["lang", *WORDS]) + ", n bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f: every phrase of up to ORDER words with at least `least` places; no words: all words of a language."""
    longest = windows(docs, least).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    end = f"coalesce({', '.join(reversed(WORDS))}, 'all')"
    rolled = docs.sparkSession.sql(
        f"SELECT lang, {', '.join(WORDS)}, sum(n) AS f FROM {{longest}} GROUP BY lang, ROLLUP({', '.join(WORDS)}) HAVING {end} <> '' AND (w1 IS NULL OR sum(n) >= {int(least)})", longest=longest
    )
    words = F.array_compact(F.array(*WORDS))
    return rolled.select("lang", words.alias("words"), F.array_join(words, " ").alias("phrase"), "f")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def _with_count(cuts: DataFrame, table: DataFrame, n_cuts: int, part: str, name: str) -> DataFrame:
    """cuts with the count of their `part`.

    A part that HOT_SHARE of the cuts or more have is met in SALTS parts; there are 1 / HOT_SHARE of these at most.
    """
    hot = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(1.0, HOT_SHARE * n_cuts)).select("lang", part, F.lit(SALTS).alias("_salts"))
    hot = F.broadcast(written(hot, "hot-parts"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = table.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(hot, ["lang", part], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    rows = cuts.join(hot, ["lang", part], "left").withColumn("_salt", F.pmod(F.xxhash64("phrase", "k"), salts).cast("int")).drop("_salts")
    return rows.join(dealt, ["lang", part, "_salt"], "left").drop("_salt")


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score: candidates with their lowest-scoring cut, of equal ones the first."""
    table = counts.where(F.size("words") < ORDER)
    cuts = counts.where(F.size("words") > 1).select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    parts = [F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, ORDER), " ").alias("right")]
    cuts = written(cuts.select("lang", "phrase", "a", "k", *parts), "cuts")
    n_cuts = cuts.count()
    found = _with_count(_with_count(cuts, table, n_cuts, "left", "l"), table, n_cuts, "right", "r")
    found = found.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = found.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def absorbed(counts: DataFrame) -> DataFrame:
    """lang, phrase, around: the highest count of a longer candidate around each phrase of two words or more."""
    longer = counts.where(F.size("words") > 2).select("lang", "words", "f", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("m"))
    longer = longer.select("lang", "words", "f", "m", F.explode(F.expr("sequence(1, size(words) - m + 1)")).alias("at"))
    inner = longer.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("m")), " ").alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    The best of a language are found among those of each of SALTS parts of its phrases, so
    no task orders all of them.
    """
    counts = written(phrase_counts(docs, least), "phrase-counts")
    total = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    counts = counts.where(F.size("words") > 0)
    found = scored(counts).join(absorbed(counts), ["lang", "phrase"], "left")
    found = found.where(F.col("around").isNull() | (_exact("around") * 100 < _exact("a") * ABSORBED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("part")
    within = found.select("lang", "phrase", "a", "l", "r", "score", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    best = looked_up(best, total, total.count(), ["lang"], F.col("phrase"))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
