"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a piece ends in exactly one token. An automaton over the
vocabulary, read backwards from a place, reports the tokens that end there; the one that
belongs there is the one whose pair with the last token of the prefix before it is
compatible: merging in rank order would never join their border. The tokens follow from
the back-pointers. Pieces are what the tokenizer's pattern cuts a text into, so a text
costs time in proportion to its length whatever it holds. Words share beginnings, so the
prefixes of short pieces that were needed are kept for other pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Pieces of byte-level tokenizers with use_regex (fixed value of the tokenizer files).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose encoding a worker keeps; further ones are encoded each time.
KEPT_PIECES = 1 << 17
#: Longest piece that is kept.
KEPT_LENGTH = 40
#: Prefixes of such pieces whose encoding a worker keeps; when there are so many it begins anew.
KEPT_PREFIXES = 1 << 16
#: Places, a power of two, where a worker keeps the compatibility of pairs of tokens, 8 bytes each; a later pair takes an earlier one's place.
KEPT_PAIRS = 1 << 19
#: Tokens after which a worker hands on the rows it has encoded.
BATCH_TOKENS = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others, in order, for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_pieces() -> re.Pattern:
    """PIECES for texts without characters from U+10000 on, which Python's own engine cuts in less time."""
    every = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)

    def members(kind: str) -> str:
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(kind + "+", every))

    letters, numbers, blanks = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(f" ?[{letters}]++|'(?:[stmd]|re|ve|ll)| ?[{numbers}]++| ?[^{blanks}{letters}{numbers}]++|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


def check_supported(spec: dict) -> None:
    """A ValueError for a tokenizer file whose settings the codec doesn't follow."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [
        pre.get("type") != "ByteLevel" and "pre_tokenizer",
        pre.get("add_prefix_space") and "add_prefix_space",
        not pre.get("use_regex", True) and "use_regex",
        spec.get("normalizer") and "normalizer",
        model.get("type", "BPE") != "BPE" and "model",
        *[model.get(k) and k for k in ("ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")],
        *[t.get(k) and f"added token with {k}" for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")],
    ]
    if any(wrong):
        raise ValueError(f"tokenizer settings that are not supported: {sorted({w for w in wrong if w})}")


class Kept(dict):
    """What make makes of a piece; of short ones some are kept."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]) -> None:
        self.make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.make(piece)
        if len(self) < KEPT_PIECES and len(piece) <= KEPT_LENGTH:
            self[piece] = found
        return found


class Codec:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.bytes = {i: raw[t] for t, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        #: token -> (rank of the merge that makes it, its halves); bytes have no halves
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.made.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces, self.plain, self.beyond = regex.compile(PIECES), plain_pieces(), re.compile("[\U00010000-\U0010ffff]")
        self.ends = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t not in self.special:
                self.ends.add_word(raw[t].decode("latin-1")[::-1], (len(raw[t]), i))
        self.ends.make_automaton()
        self.longest = max(map(len, raw.values()))
        #: token -> the next shorter one that ends where it ends, with its length
        self.shorter: dict[int, tuple[int, int]] = {}
        for t, i in vocab.items():
            if t not in self.special and len(raw[t]) > 1:
                self.shorter[i] = self._ending(raw[t][1:].decode("latin-1"))
        #: left token << 32 | right token << 1 | whether they are compatible, each at a place that follows from both
        self.known = array("q", [-1]) * KEPT_PAIRS
        self.alone = self._alone()
        self.whole = {b.decode("latin-1"): (i,) for i, b in self.bytes.items() if i in self.alone and i not in self.special.values()}
        #: prefix, a letter for each byte, -> its ids
        self.prefixes: dict[str, tuple[int, ...]] = {}
        self.kept = Kept(self._piece)
        self.decimals = {i: str(i) for i in self.bytes}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether rank-order merging of left's and right's bytes gives these two tokens.

        Undo the merges of both, latest first. What then faces the border is there until
        the merge just undone; an earlier merge across the border would have won. At equal
        rank the leftmost pair goes first: that is left's own merge, but not right's.
        """
        rank, made, none = self.rank, self.made, (-1, 0, 0)
        limit = len(rank) + 1  # a merge across the border of a lower rank would have won
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            a, b = made.get(left, none), made.get(right, none)
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True

    def _fits(self, left: int, token: int) -> bool | int:
        """_compatible, looked up if it is known."""
        place, pair = left * 40_503 + token & KEPT_PAIRS - 1, left << 31 | token
        held = self.known[place]
        if held >> 1 == pair:
            return held & 1
        fits = self._compatible(left, token)
        self.known[place] = pair << 1 | fits
        return fits

    def _ending(self, prefix: str) -> tuple[int, int]:
        """Length and id of the longest token that ends where prefix ends."""
        return next(self.ends.iter_long(prefix[: -self.longest - 1 : -1]))[1]

    def _prefix(self, prefix: str) -> list[int]:
        """The ids of a short prefix.

        Back from its end, the longest token that ends at a place and then the one before
        it are tried first; where one doesn't fit, shorter ones are.
        """
        known, out, at = self.known, [], 0
        for _, (length, token) in reversed(list(self.ends.iter_long(prefix[::-1]))):
            at += length
            if out:
                held = known[out[-1] * 40_503 + token & KEPT_PAIRS - 1]
                fits = held & 1 if held >> 1 == out[-1] << 31 | token else self._fits(out[-1], token)
            else:
                fits = token in self.alone
            if fits:
                out.append(token)
            else:
                out = self._shorter(prefix[:at], token)
        return out

    def _shorter(self, prefix: str, token: int) -> list[int]:
        """The ids of a short prefix whose last token is shorter than this one."""
        found = self.prefixes.get(prefix)
        while found is None:
            length, token = self.shorter[token]
            head = prefix[:-length]
            before = self.prefixes.get(head)
            if before is None:
                before = self.prefixes[head] = tuple(self._prefix(head))
            if self._fits(before[-1], token):
                found = self.prefixes[prefix] = (*before, token)
        return list(found)

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece, given with a letter for each byte, of any length."""
        if (whole := self.whole.get(piece)) is not None:
            return list(whole)
        last, size = [], []
        for end in range(len(piece)):
            length, token = self._ending(piece[max(0, end + 1 - self.longest) : end + 1])
            while token not in self.alone if length > end else not self._fits(last[end - length], token):
                length, token = self.shorter[token]
            last.append(token)
            size.append(length)
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that isn't kept."""
        letters = piece.encode().decode("latin-1")
        if len(letters) > KEPT_LENGTH:
            return tuple(self.encode_piece(letters))
        if len(self.prefixes) >= KEPT_PREFIXES:
            self.prefixes.clear()
        return tuple(self._prefix(letters))

    def _alone(self) -> set[int]:
        """Tokens that their own bytes are encoded as: both halves are, and rank order lets them meet."""
        out = {i for i in self.bytes if i not in self.made}
        for i, (r, a, b) in sorted(self.made.items(), key=lambda x: x[1][0]):
            del self.rank[a, b]
            if a in out and b in out and self._compatible(a, b):
                out.add(i)
            self.rank[a, b] = r
        return out

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """The ids of a text (null is empty), and the same as decimals joined by commas."""
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                ids.append(self.special[part])
                continue
            pieces = self.pieces if self.beyond.search(part) else self.plain
            ids += chain.from_iterable(map(self.kept.__getitem__, pieces.findall(part)))
        return ids, ",".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of a file, made once in each worker."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    Null texts count as empty and have no tokens. Strings of special tokens in a text
    become their ids. Rows are handled each for itself, so repeated rows repeat; an empty
    table gives an empty result; further columns of docs are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            # rows go on as soon as they hold enough tokens, so a worker never has the ids of a whole batch
            first, held, rows = 0, 0, []
            for k, t in enumerate(b.column("text"), 1):
                ids, listed = c.encode(t.as_py())
                text = c.decode(ids)
                rows.append((len(ids), sha(listed), sha(text), *((ids, text) if with_ids else ())))
                held += len(ids)
                if held >= BATCH_TOKENS or k == b.num_rows:
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(rows)), *columns], names)
                    first, held, rows = k, 0, []
            pa.default_memory_pool().release_unused()  # a worker stays after its stage

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(held, run, schema)
