"""WARC archives and HTML extraction."""

import hashlib
import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from conftest import same_as_sql

from tensorloom.llm import html_extract, oracles, warc
from tensorloom.llm.html_blocks import blocks
from tensorloom.llm.queries import op7_warc, op10_html

SCHEMA = "page_id long, url string, html string, sha1 string, text string"
PAGES = [
    (1, "u", "x" * 2000), (2, None, "x" * 2000), (3, "u\r\nv", None), (4, "u", "a\r\n\r\nWARC/1.1\r\n" * 200), (5, "u", "é\n\x00" * 400),
    (6, "u", "s"), (7, "u", "s"), (7, "u", "x" * 2000), (None, "u", "y" * 1500), (8, "u", "z" * 3_000_000), (9, "u", "é" * 499 + "a"), (10, "u", "é" * 499 + "a"), (11, "u", "é" * 500), (12, "u", "é" * 500),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "t") for r in rows], SCHEMA)


def brute_records(rows):
    keep = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            keep[h] = max(keep.get(h, -1), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = keep.get(h) if len(raw) >= 1000 else None
        to = None if i is None or to == i else to
        out.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", str(to)))
    return sorted(out)


def listed(df):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in df.collect())


def test_archive(spark, tmp_path):
    df, path = pages(spark, PAGES), f"{tmp_path}/archive"
    warc.write_archive(df, path)
    assert listed(warc.records(spark, path)) == brute_records(PAGES)
    stored = warc.read_warc(spark, path).where("payload IS NOT NULL AND octet_length(payload) >= 1000")
    assert stored.where("page_id NOT IN (1, 2, 7)").count() == stored.where("page_id NOT IN (1, 2, 7)").select("sha256").distinct().count()
    originals = {(r["page_id"], bytes(r["record"]).split(b"\r\n\r\n", 1)[1]) for r in warc.originals(spark, path).collect()}
    assert originals == {(i, (h or "").encode()) for i, _, h in PAGES}
    assert listed(warc.archive_round_trip(pages(spark, []))) == []


def test_digests_of_blocks_and_exact_urls(spark, tmp_path):
    """Every block has the digest that its record states, and headers/ has the URLs as they were."""
    from pathlib import Path

    rows, path = [(1, "u\r\nv", "x" * 2000), (2, "u", "x" * 2000), (3, None, "y")], f"{tmp_path}/archive"
    warc.write_archive(pages(spark, rows), path)
    kinds = []
    for file in Path(f"{path}/warc").glob("*.gz"):
        for fields, block in warc.parse(file.read_bytes()):
            assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            kinds.append(fields["WARC-Type"])
    assert sorted(kinds) == ["response", "response", "revisit"]
    assert {(r["page_id"], r["url"]) for r in spark.read.parquet(f"{path}/headers").collect()} == {(1, "u\r\nv"), (2, "u"), (3, None)}


def test_missing_payloads_raise(spark, tmp_path):
    """An archive without the response that others visit gives an error, not fewer rows."""
    import gzip
    from pathlib import Path

    path = f"{tmp_path}/archive"
    warc.write_archive(pages(spark, [(1, "u", "x" * 2000), (2, "u", "x" * 2000), (3, "u", "y")]), path)
    for file in Path(f"{path}/warc").glob("*.gz"):
        kept = [(f, block) for f, block in warc.parse(file.read_bytes()) if not (f["WARC-Type"] == "response" and len(block) == 2000)]
        lines = ["\r\n".join(["WARC/1.1", *[f"{k}: {v}" for k, v in f.items()]]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n" for f, block in kept]
        file.write_bytes(gzip.compress(b"".join(lines)))
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="differ at page 2"):
        warc.records(spark, path).collect()
    with pytest.raises(Exception, match="payload of record"):
        warc.originals(spark, path).collect()


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_hot_payloads_and_many_files(spark, tmp_path, monkeypatch, bound):
    from pathlib import Path

    from tensorloom.llm import common

    monkeypatch.setattr(common, "SHARED_BYTES", bound)
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(k, "u", None if k % 3 == 0 else "h" * 1500 if k % 3 == 1 else f"{k} " * 400) for k in range(300)] + [(k, "u", f"{k}" * 30_000) for k in range(1000, 1030)] + [(2000, "u", "b" * 5_000_000)]
    path = f"{tmp_path}/archive"
    warc.write_archive(pages(spark, rows), path)
    assert listed(warc.records(spark, path)) == brute_records(rows)
    assert max(sum(len(block) for _, block in warc.parse(f.read_bytes())) for f in Path(f"{path}/warc").glob("*.gz")) <= 5_000_000
    assert {(r["page_id"], bytes(r["record"]).split(b"\r\n\r\n", 1)[1]) for r in warc.originals(spark, path).collect()} == {(i, (h or "").encode()) for i, _, h in rows}


def test_parser_refuses_damage():
    import gzip

    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"hello\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")))


def test_op7(spark, data, duck):
    same_as_sql(op7_warc(spark, data), duck, oracles.oracle_sql()["op7_warc"])


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b<p>c<br>d <b>e</b>\n f</p>g") == ["a & b", "c d e f", "g"]
    assert texts("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>y</p> -->z") == ["z"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("5 < 6 <b") == ["5 < 6 <b"] and texts(None) == [] and texts("") == []
    assert texts("<p title='a>b'>c</p></div></p>d") == ["c", "d"]
    assert "<nav" in blocks("<nav class='topMenu x'><p>a</nav>")[0].marks and "menu" in blocks("<nav class='topMenu x'><p>a</nav>")[0].marks


@pytest.mark.parametrize("page", ["<" * 50_000, "<a " * 50_000, "<p " + 'a="' * 30_000, '<p a=">' * 5_000, "<div>" * 20_000 + "x", "<ul>x" * 20_000, "<!--" * 30_000])
def test_damaged_pages_cost_little(page):
    blocks(page)


def test_viterbi_is_the_best_labelling():
    import itertools

    rng = random.Random(3)
    names = list("abcde")
    for _ in range(50):
        w = {n: (rng.gauss(0, 1), rng.gauss(0, 1)) for n in names}
        chain = html_extract.Chain(w, ((rng.gauss(0, 1), rng.gauss(0, 1)), (rng.gauss(0, 1), rng.gauss(0, 1))), (rng.gauss(0, 1), rng.gauss(0, 1)))
        page = [rng.sample(names, 2) for _ in range(5)]

        def value(y):
            return chain.first[y[0]] + sum(w[f][k] for fs, k in zip(page, y) for f in fs) + sum(chain.step[a][b] for a, b in zip(y, y[1:]))

        assert value(chain.decode(page)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=5))))


class Reference(HTMLParser):
    """Blocks of well-formed pages by the standard library's parser; `only` keeps those inside that element."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "small", "sup"}
    HIDDEN = {"head", "script", "style", "template", "svg", "object", "select", "noscript"}

    def __init__(self, only=None):
        super().__init__(convert_charrefs=False)
        self.only, self.open, self.parts, self.blocks = only, [], [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE | self.HIDDEN and not self.hidden():
            self.flush()
        if tag not in ("meta", "link", "img", "br", "hr", "input"):
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag not in self.INLINE | self.HIDDEN and not self.hidden():
            self.flush()
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def hidden(self):
        return any(t in self.HIDDEN for t in self.open)

    def text(self, value):
        if not self.hidden() and (self.only is None or self.only in self.open):
            self.parts.append(value)

    def handle_data(self, data):
        self.text(data)

    def handle_entityref(self, name):
        found = html.unescape(f"&{name};")
        self.text(f"&{name}" if found.endswith(";") else found)

    def handle_charref(self, name):
        self.text(html.unescape(f"&#{name};"))


def by_reference(page, only=None):
    parser = Reference(only)
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.blocks


def test_blocks_against_another_parser():
    rng = random.Random(8)

    def words():
        return " ".join(rng.choice(["alpha", "beta", "&amp;", "&#233;", "&lt;b&gt;", "x", "\n", "&nbsp;c", "AT&amp;T"]) for _ in range(rng.randint(1, 6)))

    def attrs():
        return rng.choice(["", ' class="c"', " data-x='a > b'", f' title="{"q" * rng.choice([3, 9000])} > z"', " hidden=hidden"])

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return words()
        if kind < 0.45:
            return f"<{(t := rng.choice(sorted(Reference.INLINE)))}{attrs()}>{words()}</{t}>"
        if kind < 0.6:
            t = rng.choice(["svg", "object", "template", "noscript"])
            return f"<{t}{attrs()}>{words()}" + (f"<{t}>{words()}</{t}>{words()}" if t == "object" else "") + f"</{t}>"
        if kind < 0.7:
            return rng.choice(["<svg/>", "<script>if (a < b) x('</p>')</script>", "<style>p > a {}</style>", "<!-- <p>no</p> -->", "<select><option>1</option><option>2</option></select>"])
        t = rng.choice(["div", "section", "article", "blockquote", "main"])
        return f"<{t}{attrs()}>" + "".join(node(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{t}>"

    for _ in range(400):
        page = "<html><head><title>t</title></head><body>" + "".join(node(4) for _ in range(4)) + "</body></html>"
        assert texts(page) == by_reference(page), page


def test_text_that_damage_must_not_hide():
    story = "<article><p>one</p><p>two</p></article>"
    assert texts(f"<html><head><title>t</title>{story}") == ["one", "two"]
    assert texts(f"<svg/>{story}") == ["one", "two"] and texts(f"<body><select><option>x{story}") == ["one", "two"]
    assert texts(f"<object>a<object>b</object>c</object>{story}") == ["one", "two"] and texts(f"<div><noscript>a</div>{story}") == ["one", "two"]
    assert texts(f"<svg><title>x</svg>{story}") == ["one", "two"]
    assert texts("AT&<b>amp;</b>T") == ["AT&amp;T"] and texts("&lt;<i>p&gt;") == ["<p>"]


def shown(page):
    """Text of a page of words, comments and tags without attributes, by the states of the standard's tokenizer; | where a paragraph's end tag parts text."""
    out, at = [], 0
    while at < len(page):
        if page[at] != "<":
            out.append(page[at])
            at += 1
        elif page.startswith("<!--", at):
            at += 4
            state = "start"
            while at < len(page):
                c = page[at]
                at += 1
                if c == ">" and state in ("start", "start dash", "end", "bang"):
                    break
                if c == "-":
                    state = {"start": "start dash", "start dash": "end", "comment": "end dash", "end dash": "end", "end": "end", "bang": "end dash"}[state]
                elif c == "!" and state == "end":
                    state = "bang"
                else:
                    state = "comment"
        elif page.startswith("</", at) and at + 2 < len(page) and page[at + 2].isalpha():
            stop = page.index(">", at)
            out.append("|" if page[at:stop] == "</p" else "")
            at = stop + 1
        elif page.startswith("</>", at):
            at += 3
        elif page.startswith(("<!", "<?"), at) or (page.startswith("</", at) and at + 2 < len(page)):
            at = page.find(">", at) + 1 or len(page)
        elif at + 1 < len(page) and page[at + 1].isalpha():
            at = page.index(">", at) + 1
        else:
            out.append("<")
            at += 1
    return [t for p in "".join(out).split("|") if (t := " ".join(p.split()))]


def test_comments_end_where_the_standard_says():
    for comment in ("<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!---->", "<!x>", "<?x>", "</ x>", "<![CDATA[ x>"):
        assert texts(f"<article><p>a</p>{comment}<p>rest of the article</p></article>") == ["a", "rest of the article"], comment
    assert texts("<div>first words</p>second words</div>") == ["first words", "second words"]
    assert texts("<p>a<svg><![CDATA[ </svg> <p>b ]]></svg>c</p>") == ["ac"] and texts("a<!-- b") == ["a"] and texts("<p>a<!-- b > c") == ["a"]
    rng = random.Random(12)
    parts = ["<!--", "-->", "--!>", "<!-->", "<!--->", "-", "!", ">", "<b>", "</b>", "</p>", "x", " y ", "<![CDATA[", "]]>", "</3>", "</>", "<?p", "<!d", "< ", "<"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) + rng.choice(["", "z"])
        page = re.sub("<(?=[a-z]|/[a-z])(?![bp/]*[bp]>)", "< ", page)
        assert texts(page) == shown(page), page


def test_extraction(spark, data):
    rows = {r["page_id"]: r for r in op10_html(spark, data).collect()}
    table = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(rows) == len(table)
    for r in table:
        inside = "\n\n".join(by_reference(r["html"], "article"))
        assert rows[r["page_id"]]["text"] == inside and rows[r["page_id"]]["n_chars"] == len(inside) and rows[r["page_id"]]["url"] == r["url"]


def test_long_and_unmarked_pages(spark, data):
    """A page of any length is extracted whole; pages without article or main can be learned from too."""
    story = [f"Sentence {k} of a long story that goes on and on, with enough words for a paragraph." for k in range(20_000)]
    long = "<html><body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{s}</p>" for s in story) + "</article><footer>(c)</footer></body></html>"
    table = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    df = pages(spark, [*table, (-1, "u", long), (-1, "u", long), (-2, None, None)])
    rows = html_extract.extract(df, html_extract.train(df)).where("page_id < 0").collect()
    assert sorted(r["n_chars"] for r in rows) == [0] + [len("\n\n".join(story))] * 2 and html_extract.extract(df, html_extract.train(df)).columns == ["page_id", "url", "text", "n_chars"]
    bare = pages(spark, [(i, u, h.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")) for i, u, h in table])
    assert html_extract.extract(bare, html_extract.train(bare)).where("n_chars > 0").count() > 0.8 * len(table)


def test_held_out_layouts(spark, data):
    table = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect()]
    chain = html_extract.train_chain(html_extract.training_pages(table[:30]))
    good = total = 0
    for page, y in html_extract.training_pages(table[30:], 4, seed=99):
        good += sum(a == b for a, b in zip(chain.decode(page), y))
        total += len(y)
    assert good / total > 0.95


def test_extraction_edges(spark):
    empty = html_extract.train(pages(spark, []))
    rows = html_extract.extract(pages(spark, [(1, None, None), (2, "u", ""), (2, "u", "")]), empty).collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [("", 0)] * 3
    assert html_extract.extract(pages(spark, []), empty).count() == 0


def test_tags_and_quoted_values_of_any_length():
    for n in (100, 9_000, 300_000):
        assert texts(f'<div data-x="{"a" * n}<p>INSIDE</p>tail">hello</div>') == ["hello"]
    assert texts("<div " + " ".join(f'a{k}="{k}"' for k in range(1000)) + ' title="x>y">z</div>') == ["z"]


def test_hidden_elements_end_with_their_parent():
    assert texts("<p>a<svg/>b</p>") == ["ab"] and texts("<p>a<svg><path d='x'/><text>t</text></svg>b</p>") == ["ab"]
    for name in ("svg", "math", "select", "object", "canvas", "audio", "video", "template", "datalist"):
        assert texts(f"<div>a<{name}>hidden</div><p>b</p>") == ["a", "b"]
        assert texts(f"<div>a<{name}>hidden</div><p>b</p><{name}>c</{name}>d") == ["a", "b", "d"]
    assert texts("<head><title>t</title><p>a") == ["a"] and texts("<html><head><meta x>t<body>b") == ["t", "b"]


@pytest.mark.parametrize("page", ['<a x=">" ' * 40_000, "<a " * 60_000 + '">"', '<a "' * 40_000 + "'>'", "<svg>" * 20_000 + ">", "<a x='\">\"' " * 20_000])
def test_unended_tags_cost_little(page):
    start = time.process_time()
    blocks(page)
    assert time.process_time() - start < 5
