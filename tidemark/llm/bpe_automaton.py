"""BPE encoding and decoding by a deterministic tokenization automaton.

The merges of a word-level BPE are compiled, in order, into a deterministic automaton over token labels that accepts
exactly the correct token sequences of words. It starts as one state with a loop for each base symbol. The gadget of
a merge (a, b) -> ab takes the state that all arcs labelled a lead to (a copy of it, if other labels lead there too),
removes its arc b, and gives each state that has an arc a an arc ab to where b led. All arcs of one label lead to one
state, so the table is a bit for each state and label, and a state for each label.

A pre-split word has one path through the automaton that spells it. It is found by table look-ups, longest label
first, going back from positions without a way on. Decoding emits the labels of the arcs taken.

The vocabulary file holds lower-casing, NFC and white-space normalisation and a split into words; pieces of text
between white space are encoded once and kept in a bounded cache of each Python worker.

Defined results: a null text is an empty one; an empty text has no ids and decodes to an empty text. The strings of
special tokens in a text become those tokens. Letters that are newer than this Python's Unicode tables are told apart
by the tokenizers library, and the automaton still encodes the words. Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's cache of encoded pieces, after which it starts anew. It bounds memory and never changes results.
CACHE_ENTRIES = 300_000
_SPLIT_WHITE = regex.compile(r"\p{White_Space}+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space; the vocabulary's normaliser doesn't
#: Fixed value: how the vocabulary splits text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """The compiled automaton: label of each token, the state its arcs lead to, and which states have such an arc."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix, self.labels = suffix, {i: t for t, i in vocab.items()}
        self.size = max(self.labels) + 1
        left = {a for a, _ in merges}
        self.width = self.size // 8 + 1
        arcs = np.zeros((len(left) + 16, self.width), np.uint8)  # [state, labels in bits]
        target = np.zeros(self.size, np.int64)
        leads = [1 + len(vocab)]  # labels that lead to each state; the start state is never free
        made = {a + b for a, b in merges}
        for t, i in vocab.items():
            if t not in made:
                arcs[0, i >> 3] |= 1 << (i & 7)  # the loops of the first state
        for a, b in merges:
            if len(leads) == len(arcs):
                arcs = np.vstack([arcs, np.zeros((len(arcs) // 4 + 1, self.width), np.uint8)])
            self._gadget(arcs, target, leads, vocab[a], vocab[b], vocab[a + b])
        self.arcs, self.target, self.n_states = arcs[: len(leads)].tobytes(), target.tolist(), len(leads)
        tokens = [(t, i) for t, i in vocab.items()]
        self.last = {t[: -len(suffix)]: i for t, i in tokens if t.endswith(suffix)}
        self.inner = {t: i for t, i in tokens if not t.endswith(suffix)}
        self.reach: dict[str, int] = {}  # the longest token that begins with three given letters
        for t in [*self.last, *self.inner]:
            if len(t) > 2:
                self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))

    @staticmethod
    def _gadget(arcs: np.ndarray, target: np.ndarray, leads: list[int], a: int, b: int, ab: int) -> None:
        old, n = int(target[a]), len(leads)
        (byte_a, bit_a), (byte_b, bit_b), (byte, bit) = divmod(a, 8), divmod(b, 8), divmod(ab, 8)
        if arcs[old, byte_b] >> bit_b & 1:
            after = old if a == b else int(target[b])
            arcs[:n, byte] |= (arcs[:n, byte_a] >> bit_a & 1) << bit
            target[ab] = after
            leads[after] += 1
        state = old
        if old == 0 or leads[old] > 1:
            state = n
            leads.append(1)
            leads[old] -= 1
            arcs[state] = arcs[old]
            target[a] = state
        arcs[state, byte_b] &= ~(1 << bit_b) & 255
        if a == b:
            arcs[state, byte] &= ~(1 << bit) & 255  # of a, a, a the first two become one

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word in byte letters: the labels of its one path."""
        n, inner, last, arcs, width, target, reach = len(word), self.inner, self.last, self.arcs, self.width, self.target, self.reach
        ids: list[int] = []
        ends, states, dead = [0], [0], set()
        stop = min(n, reach.get(word[:3], 2))
        while True:
            at, state = ends[-1], states[-1]
            row = state * width
            while stop > at:
                token = last.get(word[at:]) if stop == n else inner.get(word[at:stop])
                if token is not None and arcs[row + (token >> 3)] >> (token & 7) & 1 and stop not in dead:
                    break
                stop -= 1
            else:
                dead.add(at)
                if not ids:
                    raise ValueError(f"no path spells {word!r}")
                ids.pop()
                ends.pop()
                states.pop()
                stop = at - 1
                continue
            ids.append(token)
            if stop == n:
                return ids
            ends.append(stop)
            states.append(target[token])
            stop = min(n, stop + reach.get(word[stop : stop + 3], 2))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, parted by spaces, as the vocabulary (which has no decoder) gives them."""
        return " ".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Whole texts: special tokens, normalisation, words, the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.automaton.labels |= {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.path, self._library = path, None
        self.assigned: set[str] = set()  # characters met that this Python's Unicode tables hold
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self._letters = byte_letters()

    def _piece(self, piece: str) -> bytes:
        out = []
        for w in [piece] if piece.isalpha() else WORDS.findall(piece):
            ids = self.words.get(w)
            if ids is None:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                letters = self._letters
                spelt = w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode("utf-8", "surrogatepass")])
                found = self.automaton.encode_word(spelt)
                ids = self.words[w] = pack(f"<{len(found)}I", *found)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _newer(self, text: str) -> list[bytes]:
        """A text with characters that are unassigned here: normalised and split as the vocabulary file says by its library."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        found = [self.automaton.encode_word(w) for w, _ in words]
        return [pack(f"<{len(x)}I", *x) for x in found]

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii() and (unmet := set(text) - self.assigned):
            newer = {c for c in unmet if unicodedata.category(c) == "Cn"}
            self.assigned |= unmet - newer
            if newer:
                return self._newer(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()  # letter by letter: no final sigma
        pieces = _SPLIT_WHITE.split(text) if _SEPARATORS.search(text) else text.split()
        cache = self.cache
        out = list(map(cache.get, pieces))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    p = pieces[i]
                    x = cache.get(p)
                    if x is None:
                        if len(cache) >= CACHE_ENTRIES:
                            cache.clear()
                        x = cache[p] = self._piece(p)
                    out[i] = x
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        out = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, compiled once in each process."""
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, rows: int = 128) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded (text) of each row of ``docs`` (doc_id, text).

    ``rows`` is how many texts are held at a time as Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids = [enc.encode(x) for x in batch.column(1).slice(at, rows).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
