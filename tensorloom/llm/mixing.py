"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources, in code-point order with null last, get weights from a repeating cycle and
   share a number of words; a source stops at `max_repeats` times its own size and the
   excess is reshared by weight until none is above.
2. Every source is cut into shards of a bounded number of words, and every shard, its
   documents in seeded order, into blocks of equal size. All blocks to be taken are
   apportioned to the shards by highest quotients v/1, v/3, v/5 ..., which gives each
   shard an integer quota.
3. A quota of q out of n blocks takes all blocks q div n times and a further q mod n
   blocks from a seeded start, in a circle. As the documents are in seeded order and the
   run is contiguous, nearly all documents are taken whole or not at all.

The words that a document contributes follow from its place in its shard by arithmetic,
so blocks are never expanded into rows. A hot source only has more shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, located, quoted, shared, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 8
SHARD_WORDS = 1 << 17
#: Rows of a shard, about, where texts are so short or empty that words don't bound them.
SHARD_ROWS = 1 << 16
SEED = 20
#: What places a row in its shard; rows that are alike in all of it are interchangeable.
ORDER = ("h", "doc_id", "text_hash", "file", "pos")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """df with `position`, the rank of each row from 0, found without one task seeing all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_id", 33)), "positions")
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # one row for each partition
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", before.alias("_start"))
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1))
        .drop("_id", "_part", "_start")
    )


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources(skey, source, source_size) with `target`, the words that the mix takes of each."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = positions(sources, F.col("source").isNull(), F.col("source"))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("position") % len(weights)).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    ranked = written(ranked.withColumns({"cap": cap, "full_at": cap / F.col("weight")}), "mix-sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = -1.0, -1
    while True:  # each round caps further sources; one aggregate a round
        full = F.col("full_at") <= level
        n, held, weight = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not weight:
            break
        capped, level = n, max(level, (total - (held or 0.0)) / weight)
    return ranked.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * level)).drop("cap", "full_at", "position")


def apportion(cells: DataFrame, total: int) -> DataFrame:
    """cells(value, most, ...) with `quota`: `total` seats by highest quotients, at most `most` a cell.

    Seat k of a cell is won by the quotient value / (2k - 1), so the seats won at a
    divisor d number floor(value / d + 1/2). A few aggregates, each trying many divisors,
    close in on the d that hands out exactly `total`; cells whose quotients tie at the
    last seat are served in key order.
    """

    def seats(d) -> Column:
        return F.least(F.floor(F.col("value") / d + 0.5), F.col("most"))

    whole = cells.agg(F.sum("value"), F.sum("most")).first()
    total = min(total, int(whole[1] or 0))
    if not total:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    n = cells.count()
    # rounding moves at most half a seat a cell; where `most` binds the bracket has to be wider
    low, high = whole[0] / (total + n), whole[0] / (total - n) if total > 2 * n else 4.0 * whole[0] + 1.0
    at_low, at_high = cells.agg(F.sum(seats(low)), F.sum(seats(high))).first()
    low, high = low if at_low >= total else whole[0] / total / 4096, high if at_high <= total else 4.0 * whole[0] + 1.0
    fits = None
    for _ in range(24):
        tries = [low + (high - low) * (k / 33) ** (3 if high > 2 * low else 1) for k in range(1, 33)]
        sums = cells.agg(*[F.sum(seats(d)).alias(f"s{k}") for k, d in enumerate(tries)]).first()
        fits = next((d for d, s in zip(tries, sums) if s == total), None)
        if fits or high - low < 1e-12 * high:
            break
        above = [d for d, s in zip(tries, sums) if s > total]
        below = [d for d, s in zip(tries, sums) if s < total]
        low, high = max([low, *above]), min([high, *below])
    if fits:
        return cells.withColumn("quota", seats(fits).cast("long"))
    first = cells.withColumn("quota", seats(high).cast("long"))
    rest = total - first.agg(F.sum("quota")).first()[0]
    extra = first.filter((seats(low) > F.col("quota"))).orderBy("skey", "shard").limit(rest).select("skey", "shard", F.lit(1).alias("_more"))
    return first.join(extra, ["skey", "shard"], "left").withColumn("quota", F.col("quota") + F.coalesce("_more", F.lit(0))).drop("_more")


def _taken_before(at: Column, block: int) -> Column:
    """Words taken from the first `at` words of a shard with quota, n_blocks and start."""
    n, q, c = F.col("n_blocks"), F.col("quota"), F.col("start")
    rest = q % n
    b, inside = F.floor(at / block), at % block
    chosen = F.greatest(F.lit(0), F.least(b, c + rest) - c) + F.greatest(F.lit(0), F.least(b, c + rest - n))
    here = ((b >= c) & (b < c + rest)) | (b < c + rest - n)
    return at * F.floor(q / n) + block * chosen + F.when(here, inside).otherwise(0)


def _sized(rows: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *carried: str) -> DataFrame:
    """doc_id, source, skey, size and what places a row in its shard; file and pos are 0 where none is given."""
    doc_id, text, source = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string")
    place = [F.xxhash64(c) if c == "file" else F.col(c) for c in ("file", "pos")] if carried else [F.lit(0).cast("long")] * 2
    text_hash = F.xxhash64(text)
    return rows.select(
        *[c for c in carried if c not in ("file", "pos")],
        doc_id.alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed + 1), doc_id, text_hash).alias("h"),
        text_hash.alias("text_hash"),
        place[0].alias("file"),
        place[1].alias("pos"),
    )


def _placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """sized with its source's columns and its shard."""
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    return sized.join(sources.drop("source"), "skey").withColumn("shard", F.pmod(hashed, F.col("n_shards")))


def _mixed(sized: DataFrame, weights, share: float, max_repeats: int, block: int, shard_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The placed rows with `taken`, and the sources with their targets and numbers of shards."""
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_rows") / SHARD_ROWS))
    sources = written(source_targets(sources.withColumn("n_shards", n_shards).drop("_rows"), weights, share, max_repeats), "mix-targets")
    placed = _placed(sized, sources, seed)

    cells = placed.groupBy("skey", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_size").alias("_all"), F.first("target").alias("_target"))
    cells = cells.filter("cell_size > 0").withColumns({"value": F.col("_target") * F.col("cell_size") / F.col("_all"), "n_blocks": F.ceil(F.col("cell_size") / block)})
    cells = written(cells.withColumn("most", F.col("n_blocks") * max_repeats).drop("_all", "_target"), "mix-cells")
    total = round((cells.agg(F.sum("value")).first()[0] or 0.0) / block)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("skey"), F.col("shard")), F.col("n_blocks"))
    quotas = apportion(cells, total).select("skey", "shard", "n_blocks", "quota", start.alias("start"))

    w = Window.partitionBy("skey", "shard").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(w), F.lit(0))
    taken = _taken_before(F.col("at") + F.col("size"), block) - _taken_before(F.col("at"), block)
    mixed = placed.withColumn("at", at).join(quotas, ["skey", "shard"], "left")
    return mixed.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long")), sources


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    A null text has size 0; a null source is a source of its own, last in order. Rows
    that repeat an identifier are documents of their own (those of equal text are
    interchangeable, and share a shard). taken never exceeds max_repeats times size; a
    source's sum of taken is its target but for rounding to blocks. The same table and
    seed give the same rows, however they are partitioned. An empty table gives an empty
    result; further columns of docs are not read.
    """
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    mixed, _ = _mixed(sized, weights, share, max_repeats, block, shard_words, seed)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix as documents: a row of docs stays as often as the mix takes it.

    A document that a quota's edge cuts goes whole to the side that holds more of it;
    one without words is not taken. Nulls, repeated rows and empty tables are as in mix.

    Along the order of a shard the number of copies changes only where its run of blocks
    starts or ends. These few steps of each shard, a row for 131,072 words, are what the
    rows look their copies up in: no text is moved while they stay below a bound.
    """
    rows = located(docs, "mix-input")
    of_row = [f"row.{quoted(c)}" for c in (id_col, text_col, source_col)]
    sized = written(_sized(rows, *of_row, seed, "file", "pos"), "mix-sizes")
    mixed, sources = _mixed(sized, weights, share, max_repeats, block, shard_words, seed)
    place = F.struct(*ORDER)
    counted = mixed.filter("size > 0").select("skey", "shard", place.alias("place"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies"))
    before = F.lag("copies").over(Window.partitionBy("skey", "shard").orderBy("place"))
    changes = counted.withColumn("_before", before).filter("_before IS NULL OR copies != _before")
    steps = changes.groupBy("skey", "shard").agg(F.sort_array(F.collect_list(F.struct("place", "copies"))).alias("steps"))  # a few for each shard
    steps = written(steps, "mix-steps")
    n_steps, n_sources = steps.agg(F.sum(F.size("steps"))).first()[0] or 0, sources.count()
    placed = _placed(_sized(rows, *of_row, seed, "row", "file", "pos").filter("size > 0"), shared(sources.select("skey", "source", "n_shards"), n_sources, 200), seed)
    found = placed.join(shared(steps, n_steps, 100), ["skey", "shard"])
    passed = F.filter("steps", lambda s: s["place"] <= place)
    taken = found.withColumn("copies", F.element_at(passed, -1)["copies"]).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
