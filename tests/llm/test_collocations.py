"""Phrases against brute force on small texts, and against SQL on the table."""

import random
import re
from collections import Counter

import pytest
from conftest import same_as_sql

from tensorloom.llm import collocations, oracles
from tensorloom.llm.queries import op12_collocations

SCHEMA = "doc_id long, text string, lang string, words string, f string"


def brute(rows, least, top):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang in total:
        f = {g[1:]: n for g, n in counts.items() if g[0] == lang and n >= least}
        found = []
        for g, a in f.items():
            if len(g) < 2:
                continue
            cuts = [(2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g))]
            inside = lambda o: any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1))
            if any(len(o) > len(g) and 100 * n >= 80 * a and inside(o) for o, n in f.items()):
                continue
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_table(spark, data, duck):
    same_as_sql(op12_collocations(spark, data), duck, oracles.oracle_sql()["op12_collocations"])


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "d", "é", "😀", "x y", "|"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", "!"]) for _ in range(rng.choice([0, 1, 2, 30, 400]))), rng.choice(["en", "de", None, ""])) for _ in range(60)]
    rows += [rows[3]] * 3 + [(None, "en"), ("", None), (" \t\n.;", "fr")]
    df = spark.createDataFrame([(k, *r, "x", "y") for k, r in enumerate(rows)], SCHEMA).repartition(3)
    for least, top in ((2, 10_000), (5, 7)):
        assert found(collocations.collocations(df, least, top)) == brute(rows, least, top)


def test_filter_changes_nothing(spark, monkeypatch):
    """A filter of few bits, full of false hits, gives the same counts; so do tables beyond what is shared."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefghijklmnop") for _ in range(200)), "en") for _ in range(20)]
    df = spark.createDataFrame([(k, *r, "x", "y") for k, r in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(collocations, "FILTER_BITS", 15)
    monkeypatch.setattr(collocations, "HASH_BITS", 16)
    monkeypatch.setattr("tensorloom.llm.common.SHARED_BYTES", 0)
    assert found(collocations.collocations(df, 3)) == brute(rows, 3, 2000)


def test_windows_end_at_rare_parts(spark):
    rows = [("a b c. " * 4 + "A x b c d e f g", "en"), ("d d", None)]
    df = spark.createDataFrame([(k, *r, "x", "y") for k, r in enumerate(rows)], SCHEMA).repartition(1)
    led = {tuple(r) for r in collocations.windows(df, 3).collect()}
    assert led == {("en", "a", "b", "c", "", 4), ("en", "b", "c", "", "", 5), ("en", "c", "", "", "", 5), ("en", "a", "", "", "", 1), ("en", "", "", "", "", 5), ("und", "", "", "", "", 2)}


def test_tokens_in_parts(monkeypatch):
    """Words, pieces and hashes don't depend on where a text is cut, nor on what stands before it."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB é\t.\n\x0b😀 ") for _ in range(rng.choice([0, 3, 60]))) for _ in range(30)] + [None, "x" * 50, ""]
    import pyarrow as pa

    whole = collocations.tokens_of(pa.array(texts)[1:], collocations.Powers())
    words = [whole.text[a:b].decode() for a, b in zip(whole.start, whole.end)]
    pieces = [(d, re.findall(r"[^ \t]+", p)) for d, t in enumerate(texts[1:]) for p in re.split(r"[.,;:!?\x0a-\x0d]", (t or "").replace("B", "b"))]
    assert words == [w for _, p in pieces for w in p] and whole.doc.tolist() == [d for d, p in pieces for _ in p]
    assert whole.joined.tolist() == [k + 1 < len(p) for _, p in pieces for k in range(len(p))]
    assert len(set(zip(words, whole.hash.tolist()))) == len(set(words))
    for size in (1, 2, 7, 30):
        monkeypatch.setattr(collocations, "PART_BYTES", size)
        part = collocations.tokens_of(pa.array(texts)[1:], collocations.Powers())
        assert all((getattr(part, c) == getattr(whole, c)).all() for c in ("start", "end", "hash", "doc", "joined"))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(collocations.collocations(df)) == []


def test_long_text(spark):
    df = spark.createDataFrame([(1, "p q " * 300_000 + " " * 1_000_000, "en", "x", "y")], SCHEMA)
    got = found(collocations.collocations(df))
    assert got == brute([("p q " * 300_000, "en")], 30, 2000)
