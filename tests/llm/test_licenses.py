"""Licence scans against patterns over the words, on written and damaged texts and on the table."""

import random
import re

import pytest
from conftest import same_as_sql

from tensorloom.llm import licenses, oracles
from tensorloom.llm.license_texts import BASE, SPELLINGS, TEMPLATES
from tensorloom.llm.queries import op13_licenses

SCHEMA = "doc_id long, text string, labels string, n_words string"


def filled(parts, rng):
    """A text that a template has to accept."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(rng.choice([p, p.upper(), *SPELLINGS.get(p, [])]))
        elif isinstance(p, licenses.Optional):
            out += filled(p.parts, rng) if rng.random() < 0.5 else []
        else:
            out += list(rng.choice(p.texts)) if p.texts else [f"Name{k}" for k in range(rng.randint(p.least, p.most))]
    return out


def brute(text):
    """Words, base places, labels and score by a pattern for each template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    joined = " " + "".join(x + " " for x in w)
    hits = []
    for label, markup, spelled in licenses.all_templates():
        parts = licenses.parse(markup)
        if re.search(" " + oracles._pattern(parts, SPELLINGS if spelled else {}), joined):
            hits.append((label, licenses.strength(len([p for p in parts if isinstance(p, str)]))))
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted({h for h, _ in hits})), max((s for _, s in hits), default=0.0)


def found(df):
    return {r["doc_id"]: tuple(r[1:8]) for r in licenses.scan_licenses(df).collect()}


def check(spark, texts):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {k: brute(t) for k, t, *_ in rows}


def test_table(spark, data, duck):
    same_as_sql(op13_licenses(spark, data), duck, oracles.oracle_sql()["op13_licenses"])


@pytest.mark.parametrize("label, markup", TEMPLATES, ids=[t[0] for t in TEMPLATES])
def test_templates(label, markup):
    """Fillings are accepted where they stand; without a mandatory word they aren't, nor with a strange one between."""
    rng = random.Random(label)
    automaton, parts = licenses.Automaton([(label, markup, True)]), licenses.parse(markup)
    for _ in range(10):
        words = ["before", "it", *filled(parts, rng), "after"]
        text = "".join(w + rng.choice([" ", "\n", ", ", " -- "]) for w in words)
        n, places = automaton.places(text.lower())
        assert n == len(licenses.words_of(text)) and any(at >= 2 for _, at, _ in places)
    for k, p in enumerate(parts):
        if isinstance(p, str):
            assert not automaton.places(" ".join(filled((*parts[:k], "strange", *parts[k + 1 :]), rng)).lower())[1]
            assert not automaton.places(" ".join(filled((*parts[:k], p, "strange", *parts[k + 1 :]), rng)).lower())[1] or not isinstance((*parts, None)[k + 1], str)


def test_damaged(spark):
    rng = random.Random(1)
    texts = [None, "", " .,\n", "under the MIT license", "UNDER THE mit LICENSE, under-the-mit-license!", "Apache License, Version 2.0", "CC-BY-NC 4.0 cc by nc", "under the mit licence", "cc by", "É under the mit license ß", "\x00under\x7fthe mit license\x00"]
    for _ in range(150):
        words = [w for _ in range(rng.randint(1, 3)) for w in filled(licenses.parse(rng.choice(licenses.all_templates())[1]), rng)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 2)] = [rng.choice(["the", "license", "x", "all rights reserved"])] * rng.randint(0, 2)
        texts.append("".join(w + rng.choice([" ", "  ", "\n", ", ", "(", "  "]) for w in words))
    check(spark, texts + texts[3:6])


def test_parts(spark, monkeypatch):
    """Matches across the parts of a long text, wherever it is cut."""
    rng = random.Random(2)
    text = " ".join(" ".join(filled(licenses.parse(rng.choice(TEMPLATES)[1]), rng)) + " filler" * rng.randint(0, 5) for _ in range(40))
    whole = licenses.Automaton(licenses.all_templates()).places(text.lower())
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(licenses, "PART_CHARS", size)
        n, places = licenses.Automaton(licenses.all_templates()).places(text.lower())
        assert n == whole[0] and sorted(places) == sorted(whole[1])
    monkeypatch.setattr(licenses, "MAX_SETS", 3)
    assert sorted(licenses.Automaton(licenses.all_templates()).places(text.lower())[1]) == sorted(whole[1])


def test_spans(spark):
    df = spark.createDataFrame([(1, "This is under the MIT license. All rights reserved, under the GNU General Public License, version 3.", "x", "y")], SCHEMA)
    row = licenses.scan_licenses(df).first()
    assert row["spans"] == "mit:2:6,all-rights-reserved:6:9,gpl-3:10:17" and row["labels"] == "all-rights-reserved,gpl-3,mit"


def test_markup():
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<other>>"):
        with pytest.raises(ValueError):
            licenses.parse(bad)
    with pytest.raises(ValueError):
        licenses.Automaton([("x", "<<beginOptional>>a<<endOptional>>", False)])


def test_long_and_empty(spark):
    check(spark, ["w " * 1_500_000 + "under the mit license", "x" * 3_000_000])
    assert found(spark.createDataFrame([], SCHEMA)) == {}
