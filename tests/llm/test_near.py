"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_dedup import LOWER, docs

from tensorloom.llm import near_dedup


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_kept(rows):
    sets = [brute_sets(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        least[g] = min(doc, least.get(g, doc))
    return sorted(least.values())


def test_stage_drops_similar_texts(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    unique = corpus_pipeline.exact_dedup(spark, corpus_pipeline.quality_rules(spark, df, data), data).cache()
    rows = [(r["doc_id"], r["text"]) for r in unique.collect()]
    want = brute_kept(rows)
    assert len(want) < len(rows)
    found = corpus_pipeline.simhash_dedup(spark, unique, data)
    assert sorted(r["doc_id"] for r in found.collect()) == want and found.columns == df.columns


def test_copies_of_a_copy_and_tiles(spark, monkeypatch):
    base = [f"w{k}" for k in range(200)]
    chain = [(n, " ".join([f"x{n}_{k}" for k in range(5 * n)] + base[5 * n :]), "a") for n in range(12)]
    ends = [(90, None, "a"), (91, "", "a"), (92, "One two", "a"), (93, "one TWO", "a"), (94, "one two three four five six", "a")]
    rows = chain + ends
    want = brute_kept([r[:2] for r in rows])
    for tile in (256, 3):
        monkeypatch.setattr(near_dedup, "TILE", tile)
        assert sorted(r["doc_id"] for r in near_dedup.drop_similar(docs(spark, rows)).collect()) == want
    assert near_dedup.drop_similar(docs(spark, [])).count() == 0


def test_wide_fingerprints_find_what_is_similar():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    far = []
    for n in [4, 5, 8, 9, 20, 50, 200, 1000] * 40:
        both = draw(n)
        a, b = np.concatenate([both, draw(n // 8)]), np.concatenate([both, draw(n // 4 - n // 8)])
        assert near_dedup.similar(np.sort(a), np.sort(b))
        far.append(int(np.bitwise_count(near_dedup.wide_fingerprint(a) ^ near_dedup.wide_fingerprint(b)).sum()))
    assert max(far) <= near_dedup.RADIUS - 10
    assert min(int(np.bitwise_count(near_dedup.wide_fingerprint(draw(300)) ^ near_dedup.wide_fingerprint(draw(300))).sum()) for _ in range(300)) > near_dedup.RADIUS


def test_parts_of_one_candidate_component(spark, monkeypatch):
    """Groups that meet by bands but hang together by few links only: large and small parts in many tiles."""
    monkeypatch.setattr(near_dedup, "TILE", 4)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for part, at in enumerate((0, 14, 28, 42)):  # 14 of 120 words differ from part to part: near 0.6 by windows of five
        own = base[:at] + [f"p{part}_{k}" for k in range(20)] + base[at + 20 :]
        for n in range(14):
            words = list(own)
            words[int(rng.integers(60, 118))] = f"n{part}_{n}"
            rows.append((100 * part + n, " ".join(words), "a"))
    rows += [(900 + n, " ".join(base[: 110 + n]), "a") for n in range(3)]
    want = brute_kept([r[:2] for r in rows])
    assert 1 < len(want) < len(rows) / 2
    sets = [near_dedup.shingles(t) for _, t, _ in rows]
    met = [(k, m) for k in range(len(rows)) for m in range(k) if (near_dedup.band_keys(sets[k]) == near_dedup.band_keys(sets[m])).any()]
    assert len({m // 14 for k, m in met if k // 14 != m // 14})  # some parts meet that are not linked
    assert sorted(r["doc_id"] for r in near_dedup.drop_similar(docs(spark, rows)).collect()) == want


def test_texts_that_share_a_number_are_told_apart(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(n, " ".join([f"x{n}_{k}" for k in range(2 * n)] + base[2 * n :]), "a") for n in range(4)] + [(10 + n, f"other text {n} " * 3, "a") for n in range(6)] + [(30, None, "a"), (31, "", "a")]
    want = brute_kept([r[:2] for r in rows])
    for node in (lambda t: F.length(t) * 0 + 7, lambda t: F.length(t).cast("long") % 3):
        assert sorted(r["doc_id"] for r in near_dedup.drop_similar(docs(spark, rows), node=lambda t, f=node: f(t).cast("long")).collect()) == want


def test_a_third_of_all_texts_empty(spark, monkeypatch):
    """Hot texts meet what was found for them in parts, and no result changes."""
    from tensorloom.llm import common, simhash

    monkeypatch.setattr(common, "SHARED_BYTES", 0)
    rows = [(n, "", "a") for n in range(40)] + [(100 + n, f"text number {n} with words of its own {n * 7}", "a") for n in range(20)]
    assert sorted(r["doc_id"] for r in near_dedup.drop_similar(docs(spark, rows)).collect()) == brute_kept([r[:2] for r in rows])
    found = simhash.simhash_components(docs(spark, rows)).where("doc_id < 40").select("component_id").distinct().collect()
    assert [r[0] for r in found] == [0]


def test_names_with_backticks(spark):
    odd = docs(spark, [(1, "a " * 60, "s"), (2, "b c d e f " * 3, "s")]).withColumnsRenamed({"source": "s`o``u.r`ce"})
    df = odd.withColumn("x.`y", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, "").columns == df.columns, name
    from tensorloom.llm import pii, quality_rules

    named = df.withColumnsRenamed({"doc_id": "d`id", "text": "t`x"})
    assert pii.redacted(named, "d`id", "t`x").columns == named.columns and quality_rules.keep_good(named, "d`id", "t`x").columns == named.columns
    assert near_dedup.drop_similar(named, "d`id", "t`x").count() == 2
