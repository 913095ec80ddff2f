"""Exact statistics of one text each, computed in Arrow batches; the classifier and the rules share them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:?\"'()-"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
WINDOW = 8

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_digits", "n_bangs", "n_stops", "n_letter_bytes", "n_same_word", "n_links",
]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _without(raw: bytes, drop: bytes) -> int:
    """How many bytes of ``raw`` are among ``drop``."""
    return len(raw) - len(raw.translate(None, drop))


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; only ever compared within one text."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words (given by their hashes) in a window of ``window`` words found twice or more, the first one included.

    Windows with equal hashes are compared word by word (by the words' hashes), so that only two words of one text
    with one 64-bit hash could be taken for each other.
    """
    m = len(h) - window + 1
    if m < 2:
        return 0
    key = h[:m].copy()
    for k in range(1, window):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key += h[k : m + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    same[same] = np.logical_and.reduce([h[left + k] == h[right + k] for k in range(window)])
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS; a null text has none of anything. Words are runs of anything but ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    h = hashed(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - _without(raw, SPACE),
        _without(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(h),
        _without(raw, UPPER),
        _without(raw, DIGITS),
        _without(raw, b"!"),
        _without(raw, STOPS),
        _without(raw, LETTERS),
        int((h[1:] == h[:-1]).sum()),
        _without(raw, b"@/=_\\{}[]+~^`"),
    )


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for at in range(0, max(1, batch.num_rows), 512):  # a few texts at a time as Python strings
            ids = batch.column(0).slice(at, 512)
            found = np.array([counts_of(x) for x in texts.slice(at, 512).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])


def text_stats(docs: DataFrame) -> DataFrame:
    """One row of counts for each row of ``docs`` (doc_id, text), without a shuffle. Null and empty texts get zeros."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, STATS_SCHEMA)


def where_counts(docs: DataFrame, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text's COUNTS (a row of the matrix given to ``keep``) are to be kept, columns as they are.

    Texts become Python strings 512 at a time, and the JVM holds no rows back while Python judges them.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts = np.array([counts_of(x) for x in part.column(at).to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield part.filter(pa.array(keep(counts)))

    return docs.mapInArrow(run, docs.schema)


FEATURES = ["word_length", "symbols", "bangs", "upper", "digits", "stops", "letters", "same_word", "links"]
#: Pseudo-counts: so many words of ordinary prose are added to each text, which keeps rates of very short texts apart from extremes.
PRIOR_WORDS = 12.0


def features(c: np.ndarray) -> np.ndarray:
    """Transformed statistics (FEATURES) from rows of COUNTS: logs and roots of smoothed rates a word or a character.

    Repetition is left out: the rules of the reference counts judge it, and good texts may repeat a passage.
    """
    c = np.asarray(c, float).reshape(-1, len(COUNTS))
    words, chars, symbols, _, _, upper, digits, bangs, stops, letters, same, links = c.T
    w, ch = words + PRIOR_WORDS, chars + 5 * PRIOR_WORDS
    rate = lambda x: np.log1p(20 * x / w)
    return np.column_stack([
        np.log(ch / w), rate(symbols), rate(bangs), np.sqrt((upper + 0.15 * PRIOR_WORDS) / ch), rate(digits),
        np.log1p(5 * (stops + 0.18 * PRIOR_WORDS) / w), (letters + 5 * PRIOR_WORDS) / ch, rate(same), rate(links),
    ])
