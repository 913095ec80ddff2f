"""Token counts of greedy word pieces by a linear longest-match automaton, without building pieces.

The vocabulary is a trie with two roots: one for a word's first piece, one for pieces that continue it. Each node has
a failure link and the number of tokens that are settled when it is followed, both worked out once, breadth first. A
word is then read letter by letter; the count grows by the numbers met on failures.

The vocabulary comes from a byte-level BPE file: tokens that begin a word (with the letter for a space) and all single
letters are first pieces, the others continue words. Tokens that aren't whole UTF-8 letters are left out. Words are
runs of anything but white space, with each punctuation mark a word of its own; a word that the vocabulary cannot
spell is one unknown token.

Defined results: null and empty texts count nothing. Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_automaton import byte_letters

CACHE_ENTRIES = 500_000
#: Letters of a cached piece, each of which can be a word, and pieces summed at once: the packed sums stay under 2**21.
LONGEST, PART = 1000, 2000


class CountAutomaton:
    """A trie over first pieces and continuing pieces with failure links and popped-token counts."""

    FIRST, NEXT = 0, 1

    def __init__(self, first: Iterable[str], following: Iterable[str]):
        self.arcs: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((self.FIRST, first), (self.NEXT, following)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.arcs[at].get(c)
                    if to is None:
                        to = len(self.arcs)
                        self.arcs.append({})
                        ends.append(False)
                        self.arcs[at][c] = to
                    at = to
                ends[at] = True
        self.fail = [-1] * len(self.arcs)
        self.pops = [0] * len(self.arcs)
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        arcs, fail, pops = self.arcs, self.fail, self.pops
        todo = deque([self.FIRST, self.NEXT])
        while todo:
            u = todo.popleft()
            for c, v in arcs[u].items():
                if ends[v]:
                    fail[v], pops[v] = self.NEXT, 1  # the whole string is a token: settle it
                else:
                    z, settled = fail[u], pops[u]
                    while z >= 0 and c not in arcs[z]:
                        settled += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = arcs[z][c], settled
                todo.append(v)

    def count(self, word: str) -> int:
        """Tokens of the greedy longest-match pieces of a word, or -1 if they can't spell it."""
        arcs, fail, pops = self.arcs, self.fail, self.pops
        at, n = self.FIRST, 0
        for c in word:
            to = arcs[at].get(c)
            while to is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = arcs[at].get(c)
            at = to
        while at != self.NEXT:  # settle what is left
            n += pops[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """First pieces and continuing pieces from a byte-level BPE file."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    first, following = set(), set()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    for token in vocab:
        try:
            text = bytes(byte_of[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text.startswith(" ") and text.strip():
            first.add(text[1:])
        elif text.strip() == text and text:
            following.add(text)
    return sorted(first | {x for x in following if len(x) == 1}), sorted(following)


@lru_cache(2)
def automaton(path: str) -> CountAutomaton:
    return CountAutomaton(*vocabulary(path))


@lru_cache(65536)
def is_mark(c: str) -> bool:
    """Punctuation: printable ASCII that is neither letter nor digit, or a Unicode category P."""
    return ("!" <= c <= "~" and not c.isalnum()) or unicodedata.category(c)[0] == "P"


def words_of(piece: str) -> list[str]:
    """A piece without white space, split at punctuation marks, which are words themselves."""
    if piece.isalnum():
        return [piece]
    out, start = [], 0
    for i, c in enumerate(piece):
        if is_mark(c):
            out += [piece[start:i], c]
            start = i + 1
    return [x for x in [*out, piece[start:]] if x]


class Counter:
    """Counts of whole texts, with a bounded cache of pieces between white space."""

    def __init__(self, path: str):
        self.automaton, self.cache = automaton(path), {}

    def _piece(self, piece: str) -> int:
        """Words, tokens and unknown words, packed in one integer."""
        found = [self.automaton.count(w) for w in words_of(piece)]
        return len(found) | sum(max(x, 1) for x in found) << 42 | sum(x < 0 for x in found) << 21

    def count(self, text: str | None) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        if text:
            cache = self.cache
            pieces = text.split()
            for at in range(0, len(pieces), PART):
                part = pieces[at : at + PART]
                try:
                    total = sum(map(cache.__getitem__, part))
                except KeyError:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    for p in part:
                        if p not in cache:
                            cache[p] = self._piece(p) if len(p) <= LONGEST else None
                    total = sum(x for p in part if (x := cache[p]) is not None)
                    for p in part:
                        if cache[p] is None:  # very long pieces are counted apart
                            x = self._piece_long(p)
                            words, tokens, unknown = words + x[0], tokens + x[1], unknown + x[2]
                    for p in [p for p in set(part) if cache[p] is None]:
                        del cache[p]
                words, unknown, tokens = words + (total & 0x1FFFFF), unknown + (total >> 21 & 0x1FFFFF), tokens + (total >> 42)
        return words, tokens, unknown

    def _piece_long(self, piece: str) -> tuple[int, int, int]:
        found = [self.automaton.count(w) for w in words_of(piece)]
        return len(found), sum(max(x, 1) for x in found), sum(x < 0 for x in found)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, rows: int = 512) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each row of ``docs`` (doc_id, text), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                found = np.array([count(x) for x in batch.column(1).slice(at, rows).to_pylist()], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), *(pa.array(found[:, i]) for i in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
