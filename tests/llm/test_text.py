"""Quality rules and model, personal data, tokens: brute force and edge cases."""

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from conftest import same_as_sql
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tensorloom.llm import bpe, oracles, pii, quality_model, quality_rules, token_counts
from tensorloom.llm.queries import op2_quality_model, op3_quality_rules, op4_pii, op6_bpe, op8_token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, failed string, found string, n_words string"
TEXTS = [
    None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x " * 3000, "a\nb\na\n\n\n \nb\r\na", "UP CASE!!", "# * $ % & | < >", "é\u00a0ü \u2003 ß\x0b\x1cq",
    "to be or not to be or not", "w1 w2 w3 w4 " * 20, "\n".join(["line of text"] * 9), "😀 😀 😀 😀", "y" * 50_000,
]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "f", "g", "h") for k, t in enumerate(texts)], SCHEMA)


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, data):
    table = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    texts = TEXTS + TEXTS[:5] + table
    got = quality_rules.apply_policy(quality_rules.rule_ledger(docs(spark, texts))).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        want = brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (r["failed"] == 0)
    assert quality_rules.rule_ledger(docs(spark, [])).count() == 0


def test_rules_oracle(spark, data, duck):
    same_as_sql(op3_quality_rules(spark, data), duck, oracles.oracle_sql()["op3_quality_rules"])


def test_policies_and_ablation(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    ledger = quality_rules.rule_ledger(df)
    rows = [r["failed"] for r in ledger.collect()]
    names = quality_rules.POLICIES["v1"]
    for r in quality_rules.ablation(ledger).collect():
        bit = 1 << names.index(r["rule"])
        assert r["n_failed"] == sum(bool(f & bit) for f in rows) and r["n_only"] == sum(f == bit for f in rows)
        assert r["n_kept_without"] == sum(not f & ~bit for f in rows) and r["n_rows"] == len(rows)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(not f for f in rows)
    good = df.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("quality = 1 AND n_chars > 1000")
    assert quality_rules.keep_good(good).count() >= 0.98 * good.count()


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, rx, ok in BASE for m in re.finditer(rx, text or "") if ok(m[0]))


def check_spans(rows, texts):
    for r, t in zip(rows, texts):
        want = brute_spans(t)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want, r["spans"])
        assert r["spans"].startswith(want)
        assert [r[f"n_{k}"] for k, *_ in BASE] == [want.count(k + ":") for k, *_ in BASE]


def test_pii_fuzz(spark):
    rng = random.Random(5)
    parts = ["a", "B", "@", ".", "-", "+", "1", "2", "0", " ", "%", "_", "(", ")", "\x01", "\x02", "é", "😀", "4111 1111 1111 1111", "192.168.1.1", "1.2.3.4.5", "a@b.c", "+1 (555) 123-4567", "255", "256", "\n", "a@b..c"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(600)] + ["a@b.c " * 1000, "+1" * 3000, "x" * 50 + "a@b.c"]
    check_spans(pii.summary(pii.find_pii(docs(spark, texts))).orderBy("doc_id").collect(), texts)
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_pii_on_the_table(spark, data):
    rows = {r["doc_id"]: r for r in op4_pii(spark, data).collect()}
    table = spark.read.parquet(f"{data}/documents.parquet").collect()
    check_spans([rows[r["doc_id"]] for r in table], [r["text"] for r in table])


def test_pii_is_linear_in_long_texts(spark):
    texts = ["a" * 200_000, "1 " * 100_000, "1." * 100_000, "a@b" + ".c" * 50_000, "@" * 100_000, "9" * 200_000]
    got = pii.summary(pii.find_pii(docs(spark, texts))).orderBy("doc_id").collect()
    assert [r["n_email"] for r in got] == [0, 0, 0, 1, 0, 0] and got[2]["n_ip"] == 25_000


def test_pii_checksums_context_and_redaction(spark):
    texts = ["pay GB82 WEST 1234 5698 7654 32 now", "pay GB82 WEST 1234 5698 7654 33 now", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "mail a@b.cd or +1 555 123 4567 x", None]
    got = pii.summary(pii.find_pii(docs(spark, texts))).orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == ["iban:4:31", "", "secret:9:49", "", "email:5:11,phone:15:30", ""]
    clean = pii.redacted(docs(spark, texts)).orderBy("doc_id")
    assert [r["text"] for r in clean.collect()][4:] == ["mail [email] or [phone] x", None] and clean.columns == docs(spark, []).columns


def test_model_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = op2_quality_model(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    test = got[got.held_out]
    assert (test.predicted == test.quality).mean() > 0.95


def test_model_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    texts = docs(spark, ["", None, "good text here", "a" * 200_000, "good text here"])
    for model in (quality_model.train(texts, labels), quality_model.train(texts, labels.where("quality = 1")), quality_model.train(texts, labels.limit(0))):
        rows = quality_model.score(texts, model).orderBy("doc_id").collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows) and rows[2]["score"] == rows[4]["score"] and rows[0]["score"] == rows[1]["score"]
    assert quality_model.score(docs(spark, []), model).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(200):
        y = k % 2
        own = rng.choice(50, 10, replace=False) + 1000 * (y + 1)
        rows.append(np.unique(np.r_[own, rng.choice(500, 20)]))
        labels.append(y)
    model = quality_model.fit(rows, np.array(labels))
    assert all((model.score(p) > 0.5) == bool(y) for p, y in zip(rows, labels))


def test_fit_against_a_plain_solver():
    """Ratios by counting, and the same dual solved by small projected gradient steps on all rows at once."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 60)
    rows = [np.unique(np.r_[rng.choice(40, 8), rng.choice(10, 3) + 40 + 10 * y]) for y in labels]
    cost = 0.5
    model = quality_model.fit(rows, labels, cost=cost, beta=1.0, epochs=2000)
    have = np.zeros((60, quality_model.PLACES), bool)
    for k, p in enumerate(rows):
        have[k, p] = True
    shares = [1.0 + have[labels == y].sum(axis=0) for y in (0, 1)]
    ratio = np.log(shares[1] / shares[1].sum()) - np.log(shares[0] / shares[0].sum())
    assert np.allclose(model.ratio, ratio, atol=1e-6)
    x = have[:, :60] * ratio[:60]
    x = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(60)]
    sign = np.where(labels > 0, 1.0, -1.0)
    most = cost * 60 / 2 / np.where(labels > 0, labels.sum(), 60 - labels.sum())
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    dual, step = np.zeros(60), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(100_000):
        dual = np.clip(dual - step * (q @ dual - 1), 0, most)
    weight = (dual * sign) @ x
    assert np.allclose([model.margin(p) for p in rows], x @ weight, atol=0.02)


def test_training_rows_are_bounded(spark, monkeypatch):
    """One row for an identifier however often it is repeated, clashing columns, and a budget of places."""
    rows = [(k, f"good words {k}" if k % 2 else f"BAD!! {k * 7}", "i", "y", 5) for k in range(40)]
    df = spark.createDataFrame(rows + [(1, "good words 1", "i", "y", 5)] * 500, "doc_id long, text string, _id string, _y string, y int")
    labels = spark.createDataFrame([(k, k % 2, "i") for k in range(40)] + [(1, 1, "i"), (2, 7, "i"), (None, 1, "i")], "doc_id long, quality int, id string")
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda rows, labels: seen.append((rows, labels)))
    quality_model.train(df, labels)
    import zlib

    wanted = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(40))
    assert len(seen[0][0]) == wanted
    quality_model.train(df, labels, fit_places=200)
    sizes = [len(p) for p in seen[0][0]]
    cut = len(seen[1][0])
    assert 0 < cut < wanted and sum(sizes[:cut]) <= 200 < sum(sizes[: cut + 1])
    quality_model.train(df.limit(0), labels)
    quality_model.train(df, labels.limit(0))
    assert [len(s[0]) for s in seen[2:]] == [0, 0]


def test_good_rows_and_redaction_of_edge_rows(spark):
    df = docs(spark, TEXTS + TEXTS + ["mail a@b.cd"] * 3)
    kept = quality_rules.keep_good(df)
    want = [t for t in TEXTS + TEXTS if (r := brute_rules(t))[0] >= 50 and 2 * r[4] <= r[0]]
    assert kept.columns == df.columns and kept.count() <= len(want)
    good = docs(spark, [" ".join(f"wort{k}" for k in range(60))] * 3)
    assert [tuple(r) for r in quality_rules.keep_good(good).orderBy("doc_id").collect()] == [tuple(r) for r in good.orderBy("doc_id").collect()]
    clean = pii.redacted(df)
    assert clean.columns == df.columns and clean.where("text = 'mail [email]'").count() == 3 and clean.where("text IS NULL").count() == 2
    for f in (quality_rules.keep_good, pii.redacted):
        assert f(docs(spark, [])).count() == 0


def test_unsupported_tokenizers_are_refused():
    good = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {}, "added_tokens": [{"content": "x", "lstrip": False}]}
    bpe.check_supported(good)
    for wrong in ({"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"model": {"ignore_merges": True}}, {"added_tokens": [{"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.check_supported(good | wrong)


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def token_texts():
    rng = random.Random(1)
    parts = list("abcdeéñ😀 \n\t'’.,!?<>|0123456789") + ["the", " the", "ing", "  ", "<|endoftext|>", "\r\n", "aaaa", "    ", "'s", "'ll", "\u3000", "ß", "中文", "한국", "\x00", "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += [c * n for c in ["a", "=", " ", "ha", "-", "abc", "!", "the", "0", "aab"] for n in (1, 2, 3, 5, 9, 17, 40, 500)]
    return texts + ["", "x1y2" * 20_000 + "a" * 50_000]


def test_bpe_equals_the_library(tokenizer):
    path, library = tokenizer
    codec = bpe.Codec(path)
    texts = token_texts()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids, listed = codec.encode(text)
        assert ids == want.ids and listed == ",".join(map(str, want.ids))
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    assert codec.encode(None) == ([], "")


def lines_run(module, f, *args):
    """How many lines of a module run while f does."""
    count = [0]

    def step(frame, event, arg):
        count[0] += event == "line"
        return step

    before = sys.gettrace()
    sys.settrace(lambda frame, event, arg: step if frame.f_code.co_filename == module.__file__ else None)
    try:
        f(*args)
    finally:
        sys.settrace(before)
    return count[0]


def test_bpe_takes_few_steps(tokenizer):
    """Counted in lines, so that the machine's speed doesn't matter: new words take few for each token, known ones none."""
    rng = random.Random(8)
    codec = bpe.Codec(tokenizer[0])
    parts = "the of and ing tion ent er on re st en le que eau é ou ment ciónes".split()
    words = ["".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(5000)]
    codec.encode(" ".join(words[:3000]))
    known, new = " ".join(words[:1000]), " ".join(words[3000:])
    n_tokens = len(codec.encode(new)[0])
    codec.kept.clear(), codec.encode(known)
    assert lines_run(bpe, codec.encode, known) < 100
    codec.kept.clear(), codec.prefixes.clear()
    assert lines_run(bpe, codec.encode, new) < 25 * n_tokens


def test_bpe_cuts_pieces_as_the_pattern_does():
    """The quicker pattern, over every character that it is used for; later ones take the general one."""
    general, plain = regex.compile(bpe.PIECES), bpe.plain_pieces()
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        text = f"a{c}b 1{c}2 {c}{c} !{c}? {c}\n {c} x'{c}s{c}'s"
        assert plain.findall(text) == general.findall(text)


def test_bpe_equals_the_library_on_new_words(tokenizer, monkeypatch):
    """Words of any script, some of them long, while kept prefixes are dropped again and again."""
    monkeypatch.setattr(bpe, "KEPT_PREFIXES", 50)
    path, library = tokenizer
    codec, rng = bpe.Codec(path), random.Random(9)
    pool = [chr(rng.choice([rng.randrange(97, 123), rng.randrange(0xC0, 0x250), rng.randrange(0x3B0, 0x600), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(400)]
    texts = ["".join(rng.choices(pool[: rng.choice([5, 40, 400])], k=rng.randrange(1, 60))) for _ in range(3000)] + [" ".join("".join(rng.choices("abcdefghiklmnoprst", k=rng.randrange(1, 45))) for _ in range(5000))]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(text)[0] == want.ids


def test_bpe_query(spark, data, tokenizer):
    _, library = tokenizer
    got = op6_bpe(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in got:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


def test_bpe_edges(spark, tokenizer):
    rows = bpe.encode_decode(docs(spark, [None, "", "a<|endoftext|>b", "a<|endoftext|>b"]), tokenizer[0], with_ids=True).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [0, 0, 3, 3] and rows[2]["ids"][1] == 50256 and rows[2]["decoded"] == "a<|endoftext|>b"
    assert bpe.encode_decode(docs(spark, []), tokenizer[0]).count() == 0


#: What a worker does with batches, and the MB by which its memory is larger after any of them.
WORKER = """
import pickle, random, re, sys
import pyarrow as pa
import tensorloom.llm.bpe
own = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
run = pickle.load(open(sys.argv[1], "rb"))
rng = random.Random(4)
texts = [" ".join("".join(rng.choices("abcdefghiklmnoprstuvw", k=7)) for _ in range(1000)) for _ in range(300)]
batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
before, most, ids = own(), 0, []
for out in run(iter([batch])):
    most = max(most, own() - before)
    ids += out.column(0).to_pylist()
assert ids == list(range(300))
print(most)
"""


def test_bpe_worker_stays_small(spark, tmp_path, monkeypatch, tokenizer):
    """Workers outlive their stage, so an executor has them beside the heap of later ones."""
    held = []
    monkeypatch.setattr(bpe, "map_batches", lambda rows, run, schema: held.append(run) or rows)
    bpe.encode_decode(docs(spark, []), tokenizer[0], with_ids=True)
    (tmp_path / "run").write_bytes(cloudpickle.dumps(held[0]))
    done = subprocess.run([sys.executable, "-c", WORKER, str(tmp_path / "run")], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 115


def brute_counts(text, ids, codec, rule):
    spans, raw, at = [], text.encode(), 0
    for i in ids:
        n = len(codec.bytes[i])
        first = len(raw[: at + 1].decode("utf-8", "ignore")) - (0 if raw[at] & 0xC0 != 0x80 and len(raw[: at + 1].decode("utf-8", "ignore").encode()) != at + 1 else 1)
        chars = [k for k, (a, b) in enumerate(char_bytes(text)) if a < at + n and b > at]
        spans.append((chars[0], chars[-1] + 1))
        at += n
    del first
    cuts = [0] + [k + 1 for k, c in enumerate(text) if c == "\n"]
    ends = cuts[1:] + [len(text)]
    out = [0.0] * len(cuts)
    for a, b in spans:
        share = [max(0, min(b, e) - max(a, s)) for s, e in zip(cuts, ends)]
        touched = [k for k, v in enumerate(share) if v]
        if rule == "start":
            out[touched[0]] += 1
        elif rule == "end":
            out[touched[-1]] += 1
        elif rule == "majority":
            out[share.index(max(share))] += 1
        else:
            for k in touched:
                out[k] += share[k] / sum(share)
    return list(zip(cuts, ends)), out


def char_bytes(text):
    at, out = 0, []
    for c in text:
        n = len(c.encode())
        out.append((at, at + n))
        at += n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    texts = ["a\n\n\nb", "x", "\n", "\n\n\n\n\n", "é\n😀 한국\n\n\t\tif x:\n", "one two\nthree  \n  four\n" * 9]
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.count_tokens(docs(spark, texts + [None, ""]), public_tokenizers.path("byte_bpe_50k.tiktoken"), rule=rule).toPandas()
    for k, t in enumerate(texts):
        mine = got[got.doc_id == k].sort_values("section")
        spans, want = brute_counts(t, codec.encode(t)[0], codec, rule)
        assert list(zip(mine.start, mine.end)) == spans and np.allclose(mine.n_tokens, want)
    assert got[got.doc_id >= len(texts)][["start", "end", "n_tokens"]].to_numpy().tolist() == [[0, 0, 0]] * 2


def test_token_counts_of_a_long_text(spark):
    text = "".join(f"line {k} of a long text\n" for k in range(60_000))
    got = token_counts.count_tokens(docs(spark, [text, text]), public_tokenizers.path("byte_bpe_50k.tiktoken")).groupBy("doc_id").agg(F.count("section").alias("s"), F.sum("n_tokens").alias("n"), F.max("end").alias("e")).collect()
    n = len(bpe.Codec(public_tokenizers.path("byte_bpe_50k.json")).encode(text)[0])
    assert [(r["s"], r["n"], r["e"]) for r in got] == [(60_001, n, len(text))] * 2


@pytest.mark.parametrize("blank", [" ", "\n", " \t", "\u2003"])
def test_token_counts_of_long_white_space(spark, blank):
    """Runs of white space of any length, equal to the library."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    codec, _ = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a" + blank * 3_000_000 + "b", blank * 1_000_000, f"x {blank * 999}y{blank * 1001}'s"):
        assert token_counts.token_ids(codec, text) == library.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, "a" + blank * 1_000_000 + "b")], "doc_id long, text string")
    assert token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).agg(F.sum("n_tokens")).first()[0] == len(token_counts.token_ids(codec, "a" + blank * 1_000_000 + "b"))


def test_token_counts_add_up(spark, data):
    got = op8_token_counts(spark, data).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r["n"] == len(codec.encode(texts[r["doc_id"]])[0]) for r in got)
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs(spark, []), "x", rule="half")
    assert token_counts.count_tokens(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
