"""Licence scans: template markup compiled into token automata.

A template's words are edges of an automaton, an optional region can be passed by without
a word, a replaceable one has edges that any word takes, or a branch for each of its
texts. States are joined into sets when they are first met, so a word costs one lookup; a
template accepts where its mandatory wording stands exactly, whatever fills its regions.
The phrases of the base are templates without regions. Regions are bounded, so a match
that starts at a word ends within as many words as the longest template has.

A text is read in parts of PART_CHARS characters that overlap by that length, so memory
doesn't grow with the number of its words. A text is scanned only if it has all mandatory words of a
template. A null text is empty and has no words; an empty table gives an empty result,
repeated rows are rated alike, further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, map_batches
from .license_texts import BASE, SPELLINGS, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PART_CHARS = 1 << 20
#: Mandatory words after which a match counts half, and sets of states that a worker keeps.
HALF_WORDS, MAX_SETS = 4, 50_000

MARK = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Optional:
    parts: tuple


@dataclass(frozen=True)
class Replaceable:
    """Any `least` to `most` words, or one of the given texts."""

    least: int = 0
    most: int = 0
    texts: tuple[tuple[str, ...], ...] = ()


def parse(markup: str) -> tuple:
    """The parts of a template: words, Optional and Replaceable."""
    open_: list[list] = [[]]
    for k, piece in enumerate(MARK.split(markup)):
        if k % 2 == 0:
            open_[-1] += words_of(piece)
        elif piece == "beginOptional":
            open_.append([])
        elif piece == "endOptional":
            if len(open_) < 2:
                raise ValueError("endOptional without beginOptional")
            parts = tuple(open_.pop())
            open_[-1].append(Optional(parts))
        elif piece.startswith("var;"):
            given = dict(x.split("=", 1) for x in piece.split(";")[1:] if "=" in x)
            if "match" in given:
                open_[-1].append(Replaceable(texts=tuple(tuple(words_of(t)) for t in given["match"].split("|"))))
            else:
                least, most = map(int, given["words"].split("-"))
                open_[-1].append(Replaceable(least, most))
        else:
            raise ValueError(f"unknown markup <<{piece}>>")
    if len(open_) > 1:
        raise ValueError("beginOptional without endOptional")
    return tuple(open_[0])


def mandatory(parts: tuple) -> list[str]:
    """The words that every match has."""
    return [p for p in parts if isinstance(p, str)]


@dataclass
class States:
    """A set of states: what words lead on from it, where other words lead, and the templates that end here."""

    members: frozenset[int]
    ends: tuple[int, ...] = ()
    moves: dict[str, States | None] = field(default_factory=dict)
    other: States | None = None
    built: bool = False


class Automaton:
    """All templates in one automaton; templates: (label, markup, whether other spellings count)."""

    def __init__(self, templates: Iterable[tuple[str, str, bool]]) -> None:
        self.edges: list[dict[str, list[int]]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        self.ends: dict[int, int] = {}
        self.labels, self.mandatory, self.lengths = [], [], []
        for label, markup, spelled in templates:
            parts = parse(markup)
            first = self._state()
            self.free[0].append(first)
            last = self._chain(first, parts, SPELLINGS if spelled else {})
            if self._closed({first}) & {last}:
                raise ValueError(f"template {label!r} has no mandatory words")
            self.ends[last] = len(self.labels)
            self.labels.append(label)
            self.mandatory.append([{w, *SPELLINGS.get(w, [])} if spelled else {w} for w in mandatory(parts)])
            self.lengths.append(self._longest(parts))
        self.reach = max(self.lengths, default=1)
        self.vocabulary = set().union(*(w for e in self.edges for w in [e.keys()]))
        self.sets: dict[frozenset[int], States] = {}
        self.start = self._set({0})

    def _state(self) -> int:
        self.edges.append({})
        self.any.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _chain(self, at: int, parts: tuple, spellings: dict[str, list[str]]) -> int:
        """The state in which parts end that begin in `at`."""
        for p in parts:
            if isinstance(p, str):
                to = self._state()
                for w in [p, *spellings.get(p, [])]:
                    self.edges[at].setdefault(w, []).append(to)
            else:
                to = self._state()
                if isinstance(p, Optional):
                    self.free[at].append(to)
                    self.free[self._chain(at, p.parts, spellings)].append(to)
                elif p.texts:
                    for text in p.texts:
                        self.free[self._chain(at, text, spellings)].append(to)
                else:
                    for k in range(p.most + 1):
                        if k >= p.least:
                            self.free[at].append(to)
                        if k < p.most:
                            self.any[at].append(self._state())
                            at = self.any[at][-1]
            at = to
        return at

    def _longest(self, parts: tuple) -> int:
        size = {str: lambda p: 1, Optional: lambda p: self._longest(p.parts), Replaceable: lambda p: max([p.most, *map(len, p.texts)])}
        return sum(size[type(p)](p) for p in parts)

    def _closed(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _set(self, states: Iterable[int]) -> States | None:
        members = self._closed(states)
        if not members:
            return None
        if members not in self.sets:
            self.sets[members] = States(members, tuple(sorted(self.ends[s] for s in members if s in self.ends)))
        return self.sets[members]

    def _build(self, s: States) -> None:
        if len(self.sets) > MAX_SETS:  # sets are found anew when they are met again
            self.sets = {self.start.members: self.start}
            self.start.built = False
        free = {to for m in s.members for to in self.any[m]}
        words: dict[str, set[int]] = {}
        for m in s.members:
            for w, to in self.edges[m].items():
                words.setdefault(w, set(free)).update(to)
        s.other = self._set(free)
        s.moves = {w: self._set(to) for w, to in words.items()}
        s.built = True

    def matches_at(self, words: list[str], at: int) -> dict[int, int]:
        """{template: the end of its longest match that starts at a word}."""
        found, s, n = {}, self.start, len(words)
        while True:
            for t in s.ends:
                found[t] = at
            if at == n:
                return found
            if not s.built:
                self._build(s)
            s = s.moves.get(words[at], s.other)
            if s is None:
                return found
            at += 1

    def complete(self, seen: set[str]) -> bool:
        """Whether some template has all its mandatory words among those seen."""
        return any(all(spellings & seen for spellings in needed) for needed in self.mandatory)

    def places(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words of a lower-cased text, and (template, first word, end) of all longest matches."""
        seen: set[str] = set()
        n = 0
        for part in parts_of(text):
            n += len(part)
            seen |= self.vocabulary.intersection(part)
        if not self.complete(seen):
            return n, []
        if not self.start.built:
            self._build(self.start)
        found, before, held = [], 0, []
        for part in [*parts_of(text), None]:
            held += part or []
            upto = len(held) - (self.reach if part is not None else 0)
            for k in range(max(0, upto)):
                if held[k] in self.start.moves or self.start.other:
                    found += [(t, before + k, before + end) for t, end in self.matches_at(held, k).items()]
            if upto > 0:
                before, held = before + upto, held[upto:]
        return n, found


def parts_of(text: str) -> Iterator[list[str]]:
    """The words of a text, part by part; no word is cut."""
    at = 0
    while at < len(text):
        end = GAP.search(text, min(len(text), at + PART_CHARS))
        stop = end.start() if end else len(text)
        yield WORD.findall(text[at:stop] if at or stop < len(text) else text)
        at = stop


def strength(n_mandatory: int) -> float:
    """From 0 to 1, more the more words had to match."""
    return 1.0 - 2.0 ** (-n_mandatory / HALF_WORDS)


def all_templates(templates: Iterable[tuple[str, str]] = TEMPLATES) -> list[tuple[str, str, bool]]:
    return [*[(label, phrase, False) for phrase, label in BASE.items()], *[(label, markup, True) for label, markup in templates]]


FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"


def summary(automaton: Automaton, text: str) -> dict:
    """The columns of FOUND; spans are label:first:end, leftmost ones that don't overlap for a template."""
    n, found = automaton.places(text)
    base = [(t, at) for t, at, _ in found if t < len(BASE)]
    starts = [at for _, at in base]
    spans, done = [], {}
    for t, at, end in sorted(found, key=lambda f: (f[1], f[0])):
        if at >= done.get(t, 0):
            done[t] = end
            spans.append(f"{automaton.labels[t]}:{at}:{end}")
    named = lambda ts: ",".join(sorted({automaton.labels[t] for t in ts}))
    score = max((strength(len(automaton.mandatory[t])) for t, _, _ in found), default=0.0)
    return {
        "n_words": n, "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": named(t for t, _ in base),
        "labels": named(t for t, _, _ in found), "score": score, "spans": ",".join(spans),
    }


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Iterable[tuple[str, str]] = tuple(TEMPLATES)) -> DataFrame:
    """doc_id and FOUND for each row of docs."""
    chosen = all_templates(templates)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in FOUND.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(chosen)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        for b in batches:
            rows = [summary(automaton, t) for t in b.column("text").to_pylist()]
            columns = [pa.array([r[c] for r in rows], k) for c, k in zip(names[1:], kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)

    lowered = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.col(text)).alias("text"))
    return map_batches(lowered, run, f"doc_id {kind}, {FOUND}")
