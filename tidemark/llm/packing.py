"""Best-fit packing of tokenized documents into sequences of a fixed capacity, in bulk-synchronous supersteps.

Documents are tokenized and cut into pieces of at most the capacity, of which all but a document's first are full. A
superstep takes the pieces of one range of lengths, from the longest range down, and all gaps that are left in sequences
and could hold one of them. Spark deals both evenly to parts by their numbers and sorts each part: gaps first, then
pieces from the longest to the shortest. A sweep over the part gives each piece its successor among the gaps, the
smallest that holds it; of pieces with one successor, the one that ranks first in the sort gets it, and the gap goes back
with what is left of it. Pieces without a successor open sequences. The gaps are written to the shared folder and dealt
anew in the next superstep, so a gap that one part leaves can be filled by any later one.

Within a part this is best-fit decreasing. A part holds about ``part_rows`` rows whatever the number of documents; parts
differ from best-fit decreasing over everything only in sequences that one opens while another has a gap left.

Defined results: a null text is an empty one and is one piece that holds only the closing id. Repeated rows are packed
each. An empty table gives no pieces. Further columns of ``docs`` are ignored; those of the pieces are carried through,
whatever their names, but for sequence_id and offset.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from functools import lru_cache, reduce
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_automaton import byte_letters
from tidemark.llm.common import Scratch, fresh, materialise

#: Fixed value: how the byte-level vocabulary splits text. Its end is `|\s+(?!\S)|\s+`, which is one character of white space wherever ``_simple`` holds.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_WHITE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_TRIPLE = tuple(x + y for x in _DOUBLE for y in " \n")


def _simple(text: str) -> bool:
    """Whether all white space is runs of one or two spaces and line ends, and of one at the end of the text."""
    if any(x in text for x in _WHITE):
        return False
    if not any(x in text for x in _DOUBLE):
        return True
    return text[-2:] not in _DOUBLE and not any(x in text for x in _TRIPLE)


class Tokenizer:
    """Ids of whole texts as the tokenizers library gives them; it keeps nothing of the texts.

    Texts are encoded by tiktoken with the same vocabulary, a call for each, which is several times faster and gives the
    same ids (the tests compare them); texts with odd white space or special tokens, by the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        spec = json.loads(self.library.to_str())
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.plain = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.special) or not _simple(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain(text)
        return pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    return Tokenizer(path)


def tokenize(docs: DataFrame, path: str, capacity: int = 2048, closing_id: int = 0, rows: int = 128) -> DataFrame:
    """doc_id, piece, start, length and ids (binary: little-endian unsigned 32-bit) of each piece of each document."""
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out: list[tuple] = []
                for doc_id, text in zip(batch.column(0).slice(at, rows).to_pylist(), batch.column(1).slice(at, rows).to_pylist(), strict=True):
                    ids = encode(text) + closing
                    n = len(ids) // 4
                    start, end = 0, n % capacity or capacity
                    piece = 0
                    while start < n:
                        end = min(end, n)
                        out.append((doc_id, piece, start, end - start, ids[4 * start : 4 * end]))
                        start, end, piece = end, end + capacity, piece + 1
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def sweep(gaps: list[tuple[int, int]], pieces: Iterator[tuple[int, int]], capacity: int, first_sequence: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Best-fit of ``pieces`` (row, length) in the order given: (row, sequence, offset) of each, and the gaps after it.

    ``gaps`` are (sequence, size); sequences are opened from ``first_sequence`` on.
    """
    held: dict[int, list[int]] = {}  # size -> sequences
    for sequence, size in gaps:
        held.setdefault(size, []).append(sequence)
    sizes = sorted(held)
    placed, opened = [], first_sequence
    for row, length in pieces:
        at = bisect.bisect_left(sizes, length)
        if at < len(sizes):
            size = sizes[at]
            sequence = held[size].pop()
            if not held[size]:
                del held[size], sizes[at]
        else:
            size, sequence, opened = capacity, opened, opened + 1
        placed.append((row, sequence, capacity - size))
        rest = size - length
        if rest:
            if rest not in held:
                held[rest] = []
                bisect.insort(sizes, rest)
            held[rest].append(sequence)
    return placed, [(sequence, size) for size, found in held.items() for sequence in found]


def _superstep(pieces: DataFrame, gaps: DataFrame, capacity: int, parts: int, step: int) -> DataFrame:
    """A row for each of ``pieces`` (id, size), with gap false, its sequence and offset, and one for each gap (id, size) left."""
    rows = gaps.select(F.lit(True).alias("gap"), "id", "size").unionByName(pieces.select(F.lit(False).alias("gap"), "id", "size"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", F.desc("gap"), F.desc("size"), "id")

    def swept(part: int, gaps: list[tuple[int, int]], pieces: list[tuple[int, int]]) -> pa.RecordBatch:
        placed, left = sweep(gaps, iter(pieces), capacity, (step << 56) + (part << 32))
        found = np.array([(0, *x) for x in placed] + [(1, sequence, sequence, size) for sequence, size in left], np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0] == 1), *(pa.array(found[:, k]) for k in (1, 2, 3))], ["gap", "id", "sequence_id", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gaps, pieces = None, [], []
        for batch in batches:
            for gap, i, size, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield swept(now, gaps, pieces)
                    now, gaps, pieces = part, [], []
                (gaps if gap else pieces).append((i, size))
        if now is not None:
            yield swept(now, gaps, pieces)

    return rows.select("gap", "id", "size", "part").mapInArrow(run, "gap boolean, id long, sequence_id long, value long")


def best_fit(pieces: DataFrame, capacity: int = 2048, part_rows: int = 50_000) -> DataFrame:
    """``pieces`` (length, from 1 to ``capacity``, and any further columns) with sequence_id and offset.

    ``pieces`` are written once, with a number for each row. ``part_rows`` is about how many pieces and gaps a task sweeps.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = fresh("row", *names)
    pieces = materialise(pieces.select(*(F.col(f"`{c}`") for c in names), F.monotonically_increasing_id().alias(row)), "pack-pieces")
    sizes = pieces.select(F.col(row).alias("id"), F.col("length").cast("long").alias("size"))
    scratch = Scratch(spark, "pack")
    bounds = sorted({capacity, capacity // 4, capacity // 16, capacity // 64, 0}, reverse=True)
    level = F.lit(0)
    for k, low in enumerate(bounds[1:]):
        level = F.when(F.col("size") <= bounds[k], k).otherwise(level)
    counts = {r.level: r.n for r in sizes.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    gaps, n_gaps, placed = spark.createDataFrame([], "id long, size long"), 0, []
    for k, low in enumerate(bounds[1:]):
        if counts.get(k, 0):
            parts = -(-(counts[k] + n_gaps) // part_rows)
            taken = sizes.where((F.col("size") > low) & (F.col("size") <= bounds[k]))
            done = scratch.table(_superstep(taken, gaps.where(F.col("size") > low), capacity, parts, k), "superstep")
            placed.append(done.where("not gap").select(F.col("id").alias(row), "sequence_id", F.col("value").alias("offset")))
            gaps = gaps.where(F.col("size") <= low).unionByName(done.where("gap").select("id", F.col("value").alias("size")))
            n_gaps = gaps.count() if low else 0
    if not placed:
        return pieces.select(*(F.col(f"`{c}`") for c in names), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = scratch.result(reduce(DataFrame.unionByName, placed))
    return pieces.join(places, row).select(*(F.col(f"`{c}`") for c in names), "sequence_id", "offset")
