"""Main text of HTML pages by a linear-chain conditional random field.

A page becomes its sequence of leaf text blocks; a block's features are the elements
around it, the words of their classes, ids and roles, and the shape of its text. A chain
of two labels (main, other) is trained by the gradient of its log-likelihood and decoded
by Viterbi.

Labelled pages: of a bounded, hash-chosen sample of pages with an <article> or <main>,
blocks inside these are main text, and what stands in navigation, footers, forms and the
like is not. Where no page has such a mark, longer blocks outside those parts are taken
for main text.
Each is also laid out anew in random templates (other containers and class names,
sidebars, notices, adverts, forms, reader comments), so that the model does not hang on
one site's markup.
"""

from __future__ import annotations

import html
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_batches
from .html_blocks import Block, blocks

#: Pages that the model is trained on, at most.
SAMPLE_PAGES = 120
#: Characters of a page that it is trained on, at most: longer pages are extracted like any, but not learned from.
SAMPLE_CHARS = 200_000
#: Words from which a block of a page without marks counts as main text in training.
LONG_BLOCK = 12
#: Random layouts of each of them.
LAYOUTS = 12
#: Words of a block and blocks of main text that a layout made for training takes from a page.
LAYOUT_WORDS, LAYOUT_BLOCKS = 60, 25
EPOCHS = 6

# Words by which markup names its parts, in English as is usual in code.
MAIN_WORDS = "article content post entry story main body text page blog news prose document markdown read".split()
OTHER_PARTS = {
    "nav": "nav menu navigation navbar breadcrumb toc pagination pager tabs links topbar skip".split(),
    "header": "header masthead banner brand logo top site hero head".split(),
    "footer": "footer foot bottom copyright legal colophon credits".split(),
    "aside": "sidebar aside widget rail related recommended popular trending archive tags categories more secondary complementary".split(),
    "notice": "notice cookie consent gdpr privacy alert popup modal overlay dialog paywall warning toast disclaimer message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp banner marketing outbrain taboola".split(),
    "form": "form search subscribe newsletter login signup register contact input poll survey".split(),
    "comments": "comments comment reply replies discussion respond disqus reader feedback responses thread".split(),
    "share": "share social sharing follow meta byline tools print author bio timestamp".split(),
}
TAGS = {
    "nav": ("nav", "div", "ul", "header"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"),
    "notice": ("div", "section", "aside", "dialog"), "ad": ("div", "aside", "section", "ins"), "form": ("form", "div"), "comments": ("section", "div", "ol", "aside"), "share": ("div", "ul"),
}
OUTSIDE = frozenset("<nav <footer <aside <form <dialog".split()) | {w for part in OTHER_PARTS.values() for w in part} - set("top head body more text page site".split())
INSIDE, WORDED = frozenset(("<article", "<main")), frozenset(MAIN_WORDS)


def labels(page: list[Block]) -> np.ndarray | None:
    """1 for main text, as the markup says or, without marks, the length of blocks; None if no block is."""
    outside = [bool(b.marks & OUTSIDE) for b in page]
    inside = np.array([bool(b.marks & INSIDE) and not o for b, o in zip(page, outside)], int)
    if not inside.any():
        inside = np.array([2 * b.linked < len(b.text) and b.text.count(" ") + 1 >= LONG_BLOCK and not o for b, o in zip(page, outside)], int)
    return inside if inside.any() else None


def features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    dense = b.linked / (len(b.text) or 1)
    out = [w if w[0] == "<" else w.removesuffix("s") for w in b.marks]
    scope = f"scope {'A' if b.marks & INSIDE else 'M' if b.marks & WORDED else '-'}{'O' if b.marks & OUTSIDE else '-'}"
    out += [scope, f"{scope} {min(2, words // 4)}", "tag " + b.tag, f"words {min(8, words.bit_length())}", f"linked {min(3, math.ceil(3 * dense))}"]
    if b.text[-1] in ".!?…:;\"'”»":
        out.append("sentence")
    if "©" in b.text[:12]:
        out.append("copyright")
    return out


@dataclass(frozen=True)
class Chain:
    weight: dict[str, tuple[float, float]]  # of a feature for each label
    step: tuple[tuple[float, float], tuple[float, float]]  # from label to label
    first: tuple[float, float]

    def scores(self, page: list[list[str]]) -> list[tuple[float, float]]:
        out, known = [], self.weight.get
        for fs in page:
            a = b = 0.0
            for f in fs:
                if w := known(f):
                    a += w[0]
                    b += w[1]
            out.append((a, b))
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi; of equal ways the one with other first."""
        (s00, s01), (s10, s11) = self.step
        a, b = self.first
        back: list[tuple[int, int]] = []
        for k, (x, y) in enumerate(self.scores(page)):
            if k:
                from0, from1 = int(b + s10 > a + s00), int(b + s11 > a + s01)
                back.append((from0, from1))
                a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01)
            a, b = a + x, b + y
        if not page:
            return []
        out = [int(b > a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]


def train_chain(pages: list[tuple[list[list[str]], np.ndarray]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Chain:
    """Fit by adaptive gradient steps on the log-likelihood, a page at a time.

    While training, half of the pages hide each feature with chance 0.15, so that no
    single mark carries the decision.
    """
    place: dict[str, int] = {}
    rng = random.Random(seed)
    coded = [([np.array([place.setdefault(f, len(place)) for f in fs]) for fs in page], y) for page, y in pages if len(page)]
    n = len(place)
    w, g = np.zeros((n, 2)), np.full((n, 2), 1e-2)
    step, gs, first, gf = np.zeros((2, 2)), np.full((2, 2), 1e-2), np.zeros(2), np.full(2, 1e-2)
    for _ in range(epochs):
        rng.shuffle(coded)
        for page, y in coded:
            if rng.random() < 0.5:
                page = [p[[rng.random() >= 0.15 for _ in p]] for p in page]
            unary = np.array([w[p].sum(axis=0) for p in page])
            m = len(page)
            alpha, beta = np.zeros((m, 2)), np.zeros((m, 2))
            alpha[0] = unary[0] + first
            for k in range(1, m):
                alpha[k] = unary[k] + np.logaddexp(alpha[k - 1, 0] + step[0], alpha[k - 1, 1] + step[1])
            for k in range(m - 2, -1, -1):
                nxt = unary[k + 1] + beta[k + 1]
                beta[k] = np.logaddexp(step[:, 0] + nxt[0], step[:, 1] + nxt[1])
            total = np.logaddexp(*alpha[-1])
            error = np.exp(alpha + beta - total)
            error[np.arange(m), y] -= 1.0
            if m > 1:
                pair = np.exp(alpha[:-1, :, None] + step[None] + (unary[1:] + beta[1:])[:, None, :] - total).sum(axis=0)
                np.subtract.at(pair, (y[:-1], y[1:]), 1.0)
                gs += pair**2
                step -= rate * pair / np.sqrt(gs)
            gf += error[0] ** 2
            first -= rate * error[0] / np.sqrt(gf)
            ids = np.concatenate(page)
            if len(ids):
                grad = np.zeros((n, 2))
                np.add.at(grad, ids, np.repeat(error, [len(p) for p in page], axis=0))
                used = np.unique(ids)
                grad = grad[used] + decay * w[used]
                g[used] += grad**2
                w[used] -= rate * grad / np.sqrt(g[used])
    return Chain({f: tuple(w[k]) for f, k in place.items()}, tuple(map(tuple, step)), tuple(first))


def lay_out(main: list[str], other: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page in a random template, and the labels of its blocks."""
    page: list[str] = []
    marks: list[int] = []
    esc = lambda t: html.escape(t, quote=False)

    def name(words: list[str], other_word: str = "") -> str:
        kind = rng.random()
        word = rng.choice(words)
        if kind < 0.55:
            word = rng.choice([word, f"{word}-{rng.choice(['box', 'wrap', 'area', 'list', 'x1', 'inner'])}", f"site-{word}", f"{word} {other_word}".strip()])
            return f' {rng.choice(["class", "class", "id"])}="{word}"'
        return f' id="{word}" class="{rng.choice(["c1", "row", "block", word])}"' if kind < 0.7 else ""

    def part(kind: str) -> None:
        tag = rng.choice(TAGS[kind])
        attrs = name(OTHER_PARTS[kind])
        if not attrs and tag in ("div", "section", "ul", "ol", "ins", "header"):
            attrs = f' class="{rng.choice(OTHER_PARTS[kind])}"'
        page.append(f"<{tag}{attrs}>")
        long = rng.random() < 0.7 if kind == "comments" else rng.random() < 0.25
        texts = [rng.choice(main if long else other) for _ in range(rng.randint(1, 5))]
        lists = tag in ("ul", "ol") or kind in ("nav", "share") and rng.random() < 0.7
        if lists and tag not in ("ul", "ol"):
            page.append("<ul>")
        if kind == "form" and rng.random() < 0.5:
            page.append('<input type="text" name="q">')
        if rng.random() < 0.3 and not lists:
            page.append(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{esc(' '.join(texts[0].split()[:3]))}</{h}>")
            marks.append(0)
        for t in texts:
            t = " ".join(t.split()[: rng.randint(1, 4)]) if lists else t
            inner = f'<a href="/x">{esc(t)}</a>' if lists or rng.random() < 0.2 else esc(t)
            page.append(f"<li>{inner}</li>" if lists else f"<p>{inner}</p>" if rng.random() < 0.7 else f"<div>{inner}</div>")
            marks.append(0)
        if lists and tag not in ("ul", "ol"):
            page.append("</ul>")
        page.append(f"</{tag}>")

    def maybe(*kinds: str, chance: float = 0.4) -> None:
        for kind in rng.sample(kinds, len(kinds)):
            if rng.random() < chance:
                part(kind)

    page.append("<html><body>")
    wraps = rng.choice([[], ["div"], ["div", "div"]])
    page += [f"<{w}{name(['wrap', 'container', 'page', 'layout', 'outer'])}>" for w in wraps]
    maybe("nav", "header", "notice", "ad", "form", "aside")
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    attrs = name(MAIN_WORDS, rng.choice(MAIN_WORDS))
    if not attrs and tag in ("div", "section") and rng.random() < 0.5:  # else the main part has no mark at all
        attrs = f' class="{rng.choice(MAIN_WORDS)}"'
    page.append(f"<{tag}{attrs}>")
    for k, t in enumerate(main):
        kind = "h1" if k == 0 and rng.random() < 0.8 else rng.choice(["p"] * 12 + ["h2", "h3", "blockquote", "li", "div", "pre"])
        page.append(f"<ul><li>{esc(t)}</li></ul>" if kind == "li" else f"<{kind}>{esc(t)}</{kind}>")
        marks.append(1)
        if k and rng.random() < 0.06:
            part(rng.choice(["ad", "share", "aside", "notice", "form", "nav"]))
    if rng.random() < 0.25:
        part("comments")
    page.append(f"</{tag}>")
    maybe("comments", "aside", "share", "form", "ad", "nav")
    maybe("footer", chance=0.8)
    page += [f"</{w}>" for w in reversed(wraps)] + ["</body></html>"]
    return "".join(page), marks


def training_pages(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> list[tuple[list[list[str]], np.ndarray]]:
    """Features and labels of the pages as they are and in random layouts."""
    rng = random.Random(seed)
    out = []
    for page in pages:
        found = blocks(page)
        y = labels(found)
        if y is None:
            continue
        out.append(([features(b) for b in found], y))
        main = [" ".join(b.text.split()[:LAYOUT_WORDS]) for b, k in zip(found, y) if k][:LAYOUT_BLOCKS]
        other = [b.text for b, k in zip(found, y) if not k] or main
        for _ in range(layouts):
            laid, marks = lay_out(main, other, rng)
            again = blocks(laid)
            if len(again) == len(marks):
                out.append(([features(b) for b in again], np.array(marks)))
    return out


def train(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> Chain:
    """The chain for a bounded, hash-chosen sample of pages.

    Pages with <article> or <main> are sampled; if there is none, any. Null html has no
    blocks, and pages that repeat count as often as they are drawn; without any block of
    main text (an empty table) the chain knows nothing and finds no main text. Further
    columns of pages are not read.
    """
    held = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    held = held.filter(F.length("_html").between(1, SAMPLE_CHARS))
    for rows in (held.filter(F.col("_html").rlike("(?i)<(article|main)[\\s>]")), held):
        chosen = hash_sample(rows, sample, "_id", "_url").collect()  # at most `sample` pages of at most SAMPLE_CHARS
        if chosen:
            break
    return train_chain(training_pages([r["_html"] for r in chosen], layouts))


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, k in zip(found, chain.decode([features(b) for b in found])) if k)


def extract(pages: DataFrame, chain: Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text (its main blocks), n_chars.

    Null html, and pages without a main block, give an empty text. Repeated rows are
    extracted each for itself; an empty table gives an empty result; further columns of
    pages are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # a weight for each feature of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            texts = [main_text(t.as_py(), chain) for t in b.column("html")]
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    held = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(held, run, "page_id long, url string, text string, n_chars long")
