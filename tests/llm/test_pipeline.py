"""The pipeline, stage by stage, against brute force on its own input."""

import sys

import corpus_pipeline
import public_tokenizers
from conftest import DATA
from test_dedup import LOWER, words
from test_near import brute_kept
from test_text import brute_rules
from tokenizers import Tokenizer

from tensorloom.llm import mixing


def test_stages(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = df.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "simhash_dedup", "source_mix", "bpe_encode"]

    def step(name, df):
        stages[name](spark, df, DATA).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    rated = step("quality_rules", df)
    assert rated.columns == columns
    kept = {r["doc_id"] for r in rated.collect()}
    for r in df.collect():
        n, _, symbols, _, repeated = brute_rules(r["text"])
        if n < 50 or 2 * repeated > n or 10 * symbols > n:
            assert r["doc_id"] not in kept
    unique = step("exact_dedup", rated)
    last = {}
    for r in rated.orderBy("doc_id").collect():
        last[r["text"].translate(LOWER)] = r["doc_id"]
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(last.values()) and unique.columns == columns
    apart = step("simhash_dedup", unique)
    rows = unique.collect()
    assert sorted(r["doc_id"] for r in apart.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in rows]) and apart.columns == columns
    mixed = step("source_mix", apart)
    copies = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(apart).collect() if r["size"]}
    got = [r["doc_id"] for r in mixed.collect()]
    assert sorted(got) == sorted(i for i, n in copies.items() for _ in range(n)) and mixed.columns == columns
    assert all(words(r["text"]) for r in mixed.collect())
    ids = step("bpe_encode", mixed)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in mixed.collect()}
    assert ids.count() == mixed.count() and all(r["ids"] == encoded[r["doc_id"]] and len(r["ids"]) == r["n_tokens"] for r in ids.collect())
    whole = corpus_pipeline.run(spark, DATA).collect()
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"])
    assert sorted(map(key, whole)) == sorted(map(key, ids.collect()))


def test_edge_rows_through_the_stages(spark, tmp_path):
    """Nulls in any column, empty, repeated and very long rows, clashing further columns, and no rows at all."""
    good = " ".join(f"wort{k}" for k in range(80))
    rows = [
        (1, good, "de", "a", 9, "x", "y"), (1, good, "de", "a", 9, "x", "y"), (2, good.title(), None, None, None, None, None), (None, good + " ende", "de", "a", 1, None, "y"), (3, None, "de", None, 0, "x", "y"),
        (4, "", "de", "a", 0, "x", "y"), (5, " ".join(f"lang{k}" for k in range(200_000)), "de", "b", 1, "x", "y"), (6, " ".join(f"neu{k}" for k in range(70)), "de", None, 1, "x", "y"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, _metadata string"
    for k, kept in enumerate((rows, [])):
        df = spark.createDataFrame(kept, schema)
        sizes = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DATA)
            assert name == "bpe_encode" or out.columns == df.columns
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            df = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            sizes.append([r["doc_id"] for r in df.collect()])
        if kept:
            # 2 is the larger of the copies, and like the row without identifier, which counts as the largest
            assert [sorted(map(str, s)) for s in sizes[:3]] == [["1", "1", "2", "5", "6", "None"], ["2", "5", "6", "None"], ["2", "5", "6"]]
            assert set(sizes[3]) <= {2, 5, 6} and sorted(sizes[4]) == sorted(sizes[3])
        else:
            assert sizes == [[]] * 5


def test_registered():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
