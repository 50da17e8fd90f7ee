"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole. The byte widths of its tokens give the span of
characters of each, and an interval join of these spans with the spans of the sections
(sorted search within the document) counts every token for a section. A token that
crosses a boundary goes by an explicit rule:

start     to the section that holds its first character
end       to the section that holds its last character
majority  to the section that holds most of its characters, of equals the first
split     to each section by its share of the token's characters (fractional counts)
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES
from .common import map_batches

RULES = ("start", "end", "majority", "split")


@lru_cache(2)
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file and the byte width of each of its tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        width[k] = len(token)
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), width


#: Runs of white space (the characters that Unicode calls so) that are encoded by themselves: the pattern's look-ahead is recursive in their length.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def token_ids(codec: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text with runs of white space of any length.

    A run is a piece of its own, without its last character if text follows, as the
    pattern has it; so cutting there changes no token.
    """
    ids, at = [], 0
    for run in LONG_BLANK.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += codec.encode_ordinary(text[at : run.start()])
        ids += codec._encode_single_piece(text[run.start() : stop].encode())
        at = stop
    return ids + codec.encode_ordinary(text[at:])


def attribute(text: str, widths: np.ndarray, separator: str = "\n", rule: str = "start") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) in code points and the token count of each section of a text.

    Sections end with their separator; the last one is what follows the last separator,
    also if that is nothing. So the sections cover the text, and an empty text is one
    empty section.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80) - 1  # code point of each byte
    n = int(place[-1]) + 1 if len(place) else 0
    cuts, at, step = [0], text.find(separator), len(separator)
    while at >= 0:
        cuts.append(at + step)
        at = text.find(separator, at + step)
    starts = np.array(cuts)
    ends = np.r_[starts[1:], n]
    counts = np.zeros(len(starts))
    if len(widths):
        last_byte = np.cumsum(widths)
        first, last = place[last_byte - widths], place[last_byte - 1]
        a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
        if rule in ("start", "end"):
            counts += np.bincount(a if rule == "start" else b, minlength=len(starts))
        else:
            counts += np.bincount(a[a == b], minlength=len(starts))
            for k in np.flatnonzero(a != b):
                s = np.arange(a[k], b[k] + 1)
                share = np.minimum(ends[s], last[k] + 1) - np.maximum(starts[s], first[k])
                if rule == "majority":
                    counts[s[share.argmax()]] += 1
                else:
                    counts[s] += share / share.sum()
    return starts, ends, counts


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "start") -> DataFrame:
    """One row per section of each row of docs: doc_id, section (from 0), start, end, n_tokens.

    The counts of a document add up to its tokens. Null and empty texts have one empty
    section without tokens. Repeated rows are counted each for itself; an empty table
    gives an empty result; further columns of docs are not read.
    """
    if rule not in RULES or not separator:
        raise ValueError(f"rule must be one of {RULES} and the separator not empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, width = encoding(path)
        for b in batches:
            found = []
            for t in b.column("text"):
                text = t.as_py() or ""
                ids = np.array(token_ids(codec, text), np.int64)
                found.append(attribute(text, width[ids] if len(ids) else ids, separator, rule))
            if found:
                sizes = [len(x[0]) for x in found]
                rows = np.repeat(np.arange(len(found)), sizes)
                section = np.concatenate([np.arange(s) for s in sizes])
                starts, ends, counts = (np.concatenate(x) for x in zip(*found))
                columns = [b.column("doc_id").take(pa.array(rows)), pa.array(section, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(counts, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "n_tokens"])

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = map_batches(held, run, "doc_id long, section long, start long, end long, n_tokens double")
    return counted if rule == "split" else counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))
