"""Exact dedup, SimHash, mixing: brute force on small tables, and the edge cases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tensorloom.llm import exact_dedup, mixing, simhash
from tensorloom.llm.queries import op1_exact_dedup, op5_mixing, op9_simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, size string, row string"
LONG = "wort " * 30_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "k", "z", "r") for i, t, s in rows], SCHEMA)


EDGE = [
    (1, "Ab c", "a"), (2, "aB C", "a"), (3, "ÄB", "b"), (4, "äb", "b"), (5, None, None), (6, "", None), (7, LONG, "a"), (8, LONG.upper(), "c"),
    (9, "same", "a"), (9, "same", "a"), (9, "other", "b"), (None, "same", "c"), (None, None, "c"), (10, " ", "a"),
]


def brute_groups(rows):
    keys = [(t or "").translate(LOWER) for _, t, _ in rows]
    keep = {}
    for (i, _, _), k in zip(rows, keys):
        keep[k] = max(keep.get(k, -1), -1 if i is None else i)
    size = Counter(keys)
    return sorted((str(i), str(None if keep[k] == -1 else keep[k]), size[k]) for (i, _, _), k in zip(rows, keys))


def test_exact_dedup_edges(spark):
    found = exact_dedup.exact_dedup(docs(spark, EDGE)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == brute_groups(EDGE)
    texts = {(t or "").translate(LOWER) for _, t, _ in EDGE}
    assert sum(r["kept"] for r in found) == len(texts)
    kept = exact_dedup.drop_duplicates(docs(spark, EDGE))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(texts)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_colliding_digests_are_told_apart_by_their_text(spark):
    rows = [(i, f"t{i % 7}", "a") for i in range(40)]
    weak = lambda c: (F.crc32(F.encode(c, "UTF-8")) % 2).cast("string")
    found = exact_dedup.exact_dedup(docs(spark, rows), digest=weak).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == brute_groups(rows)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    make = lambda ids: spark.createDataFrame([(i, "f", i, "s", f"d{i % 3}") for i in ids], "doc_id long, file string, pos long, text_sha256 string, digest string")
    for ids in (range(5), range(5, 9), ()):
        make(ids).write.mode("append").parquet(ledger)
        state = exact_dedup.fold_into_state(spark, ledger, make(()).schema, f"{tmp_path}/state")
    assert {r["digest"]: (r["group_size"], r["keep"]["doc_id"]) for r in state.collect()} == {"d0": (3, 6), "d1": (3, 7), "d2": (3, 8)}


def test_rows_of_one_place_are_told_apart(spark, data):
    """Rows that an explode makes of one stored row are rows of their own."""
    df = spark.read.parquet(f"{data}/documents.parquet").withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    texts = df.select(F.lower("text")).distinct().count()
    assert exact_dedup.drop_duplicates(df).count() == texts
    assert exact_dedup.exact_dedup(df).where("kept").count() == texts
    assert exact_dedup.exact_dedup(df.unionByName(df)).where("kept").count() == texts


def test_a_column_named_metadata(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "m"), (2, "A", "m"), (3, "b", "m")], "doc_id long, text string, _metadata string")
    df.write.parquet(f"{tmp_path}/t")
    for t in (df, spark.read.parquet(f"{tmp_path}/t")):
        kept = exact_dedup.drop_duplicates(t)
        assert sorted(tuple(r) for r in kept.collect()) == [(2, "A", "m"), (3, "b", "m")]


@pytest.mark.parametrize("weak", [False, True])
def test_later_calls_count_on(spark, tmp_path, weak):
    """Batches of rows through one checkpoint end as one table would, also where digests collide."""
    digest = (lambda c: (F.crc32(F.encode(c, "UTF-8")) % 2).cast("string")) if weak else exact_dedup.sha256_hex
    batches = [[(1, "a", "s"), (2, "b", "s"), (3, "A", "s")], [(4, "b", "s"), (5, "c", "s")], [(0, "a", "s"), (6, "C", "s")]]
    seen = []
    for k, rows in enumerate(batches):
        docs(spark, rows).write.parquet(f"{tmp_path}/in{k}")
        seen += rows
        found = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/in{k}"), digest=digest, checkpoint=f"{tmp_path}/state").collect()
        want = [x for x in brute_groups(seen) if x[0] in {str(i) for i, _, _ in rows}]
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == want


def test_a_call_that_failed_counts_once(spark, tmp_path, monkeypatch):
    """A call that dies before or after its rows are in the state, and one that is repeated, count each row once."""
    docs(spark, [(1, "a", "s"), (2, "A", "s")]).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.read.parquet(f"{tmp_path}/in")
    fold = exact_dedup.fold_into_state

    def dies(*args):
        raise OSError("lost")

    def dies_late(*args):
        fold(*args)
        raise OSError("lost")

    for f in (dies, dies_late):
        monkeypatch.setattr(exact_dedup, "fold_into_state", f)
        with pytest.raises(OSError):
            exact_dedup.exact_dedup(read(), checkpoint=f"{tmp_path}/state")
    monkeypatch.setattr(exact_dedup, "fold_into_state", fold)
    for _ in range(2):
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(read(), checkpoint=f"{tmp_path}/state").collect()} == {(1, 2, 2), (2, 2, 2)}
    part = exact_dedup.exact_dedup(read().where("doc_id = 1"), checkpoint=f"{tmp_path}/state").collect()
    assert [r["group_size"] for r in part] == [3]


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_both_ways_of_moving_texts(spark, monkeypatch, bound):
    from tensorloom.llm import common

    monkeypatch.setattr(exact_dedup, "SHARED_BYTES", bound)
    monkeypatch.setattr(common, "SHARED_BYTES", bound)
    texts = {(t or "").translate(LOWER) for _, t, _ in EDGE}
    assert exact_dedup.drop_duplicates(docs(spark, EDGE)).count() == len(texts)
    found = exact_dedup.exact_dedup(docs(spark, EDGE)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == brute_groups(EDGE)


def test_op1_on_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    found = op1_exact_dedup(spark, data).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == brute_groups(rows)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    values = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 3).tolist():
            parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(ids))]


def test_simhash_on_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r["doc_id"] for r in rows]))}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash(spark, data).collect()}
    assert found == want


def test_simhash_edges(spark):
    rows = [(4, None, "a"), (2, "", "a"), (3, " \n", "a"), (5, "One", "a"), (6, "one", "a"), (7, "one two", "a"), (8, LONG, "a"), (8, LONG, "a"), (None, "x y z", "a")]
    found = simhash.simhash_components(docs(spark, rows)).collect()
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in found}
    assert len(found) == len(rows) and got[4, "0" * 16] == 2 and got[2, "0" * 16] == 2
    assert all(int(r["fingerprint"], 16) == brute_fingerprint(dict((i, t) for i, t, _ in rows)[r["doc_id"]]) for r in found)
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    more = [(9, "alpha beta gamma delta", "a"), (9, "zeta eta theta iota", "a")]  # one identifier, two components
    kept = simhash.drop_near_duplicates(docs(spark, rows + more + [(None, "one two", "a")]))
    assert kept.columns == docs(spark, []).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "7", "8", "9", "9", "None"]


def test_bit_sliced_distances_and_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 1 << 63, (90, 4), dtype=np.uint64)
    wide[30:60] = wide[:30] ^ (wide[60:] & wide[60:][::-1] & np.roll(wide[60:], 7, axis=0))
    apart = np.bitwise_count(wide[:, None, :] ^ wide[None, :, :]).sum(axis=2)
    for radius in (0, 1, 3, 20, 31, 32, 40, 90, 127, 128):
        assert set(zip(*map(np.ndarray.tolist, simhash.near_pairs(wide, wide, radius)))) == {(i, j) for i, j in np.argwhere(apart <= radius).tolist()}
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = [int(centre[k % 12]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)))) for k in range(700)]
    fps = np.unique(np.array(values, np.uint64))
    near = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3).tolist()}
    assert set(zip(*map(np.ndarray.tolist, simhash.near_pairs(fps, fps)))) == near
    monkeypatch.setattr(simhash, "TILE", 64)
    keys = np.where(np.arange(len(fps)) < 400, 7, 8 + np.arange(len(fps)) // 3)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 90]), pa.array(fps[i : i + 90].view(np.int64))], ["key", "fp"]) for i in range(0, len(fps), 90)]
    rows = [r for b in simhash._compare(iter(batches)) for r in b.to_pylist()]
    tiles = {}
    for r in rows:
        if r["key"] is not None:
            tiles.setdefault(r["tile"], []).append(r["a"])
    assert len(tiles) == 7 and sum(map(len, tiles.values())) == 400
    cross = [(f"{p}:{q}", side, f) for p in tiles for q in tiles if p < q for side, t in ((0, p), (1, q)) for f in tiles[t]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cross)], ["pair", "side", "fp"])
    edges = [(r["a"], r["b"]) for r in rows if r["key"] is None] + [(r["a"], r["b"]) for b in simhash._cross(iter([batch])) for r in b.to_pylist()]
    parent = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert np.bitwise_count(np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))) <= 3
        parent[find(a)] = find(b)
    signed = fps.view(np.int64).tolist()
    assert all(find(signed[i]) == find(signed[j]) for i, j in near if keys[i] == keys[j])


def test_blocks_show_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    twins = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for b in base], np.uint64)
    keys = {r["fp"]: set(r["keys"]) for r in simhash.blocks(spark.createDataFrame([(int(x),) for x in np.r_[base, twins].view(np.int64)], "fp long")).groupBy("fp").agg(F.collect_set("key").alias("keys")).collect()}
    assert all(keys[a] & keys[b] for a, b in zip(base.view(np.int64).tolist(), twins.view(np.int64).tolist()))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found.get(k, k) for k in range(41)} == {0} and {found.get(k, k) for k in range(100, 140)} == {100} and found[301] == 300


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * left / total >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * left / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check_mix(rows, found):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    targets = brute_targets(sizes)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 12 + 0.002 * t


def test_mix_of_the_table(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    found = mixing.mix(df).collect()
    check_mix(rows, found)
    again = {(r["doc_id"], r["taken"]) for r in op5_mixing(spark, data).collect()}
    other = mixing.mix(df.repartition(7, "text").withColumn("taken", F.lit(1))).collect()
    assert again == {(r["doc_id"], r["taken"]) for r in other} and "source" not in op5_mixing(spark, data).columns


def test_mix_edges(spark):
    rows = EDGE + [(k, "w " * (k % 5), f"s{k % 4}") for k in range(20, 400)]
    found = mixing.mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    check_mix(rows, found)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None)])).first()["taken"] == 0
    mixed = mixing.mixed_documents(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns
    wanted = sum(int(r["taken"] / r["size"] + 0.5) for r in found if r["size"])
    assert mixed.count() == wanted


def test_words_taken_by_brute_force(spark):
    """Blocks written out word by word, seats given one by one to the highest quotient."""
    rows = EDGE + [(k, "w " * (k * 13 % 41), f"s{k % 3}") for k in range(20, 150)] + [(150 + k, "", "empty") for k in range(50)]
    block, seed = 8, mixing.SEED
    df = docs(spark, rows)
    sized = mixing._sized(df, "doc_id", "text", "source", seed)
    found = mixing.mix(df, shard_words=500).select("doc_id", "source", "size", "taken").collect()
    hashed = sized.withColumn("s", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).collect()
    total = Counter()
    for r in hashed:
        total[r["skey"]] += r["size"]
    targets = brute_targets({(None if k == "n" else k[1:]): v for k, v in total.items()})
    shards = {}
    for r in hashed:
        n = max(1, -(-total[r["skey"]] // 500))
        shards.setdefault((r["skey"], r["s"] % n), []).append(r)
    shards = {k: sorted(v, key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_hash"])) for k, v in shards.items() if sum(r["size"] for r in v)}
    size = {k: sum(r["size"] for r in v) for k, v in shards.items()}
    value = {k: targets[None if k[0] == "n" else k[0][1:]] * size[k] / total[k[0]] for k in shards}
    quota, blocks = dict.fromkeys(shards, 0), {k: -(-n // block) for k, n in size.items()}
    for _ in range(round(sum(value.values()) / block)):
        best = max((k for k in sorted(shards) if quota[k] < 2 * blocks[k]), key=lambda k: value[k] / (2 * quota[k] + 1))
        quota[best] += 1
    starts = {(r["skey"], r["shard"]): r["h"] for r in spark.createDataFrame(list(shards), "skey string, shard long").select("skey", "shard", F.xxhash64(F.lit(seed + 2), "skey", "shard").alias("h")).collect()}
    want = [(r["doc_id"], r["source"], 0, 0) for r in hashed if not r["size"]]
    for k, members in shards.items():
        first, run = starts[k] % blocks[k], quota[k] % blocks[k]
        chosen = {(first + b) % blocks[k] for b in range(run)}
        words = [quota[k] // blocks[k] + (w // block in chosen) for w in range(size[k])]
        at = 0
        for r in members:
            if r["size"]:
                want.append((r["doc_id"], r["source"], r["size"], sum(words[at : at + r["size"]])))
            at += r["size"]
    assert Counter(tuple(r) for r in found) == Counter(want)
    copies = Counter()
    for i, _, n, taken in want:
        copies[str(i)] += int(taken / n + 0.5) if n else 0
    for bound in (1 << 26, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr("tensorloom.llm.common.SHARED_BYTES", bound)
            assert Counter(str(r["doc_id"]) for r in mixing.mixed_documents(df, shard_words=500).collect()) == +copies


def test_shards_of_one_source_keep_to_the_target(spark):
    rows = [(k, "w " * (1 + k * 37 % 300), "s" if k % 3 else "t") for k in range(600)]
    check_mix(rows, mixing.mix(docs(spark, rows), shard_words=2000).collect())


def test_apportionment_is_by_highest_quotients(spark):
    values = [53.0, 24.0, 23.0, 11.5, 11.5, 4.0]
    cells = spark.createDataFrame([("s", k, v, 100) for k, v in enumerate(values)], "skey string, shard long, value double, most long")
    for seats in (1, 7, 10, 31):
        got = [r["quota"] for r in mixing.apportion(cells, seats).orderBy("shard").collect()]
        want = [0] * len(values)
        for _ in range(seats):
            best = max(range(len(values)), key=lambda k: (values[k] / (2 * want[k] + 1), -k))
            want[best] += 1
        assert got == want
