"""Near-duplicates by order MinHash over runs of five words, verified by banded alignment.

Each sketch takes the few smallest hashes among a text's occurrence-labelled shingles and keeps them in text order, so
that equal sketches speak for equal content in equal order. Texts with equal words are one class from the start, and
only its smallest doc_id is compared. A bucket holds the texts that share a sketch; any two of them are compared, unless
they are in one class already or their lengths rule the similarity out:

* first every text with its buckets' centre: the text whose sketches are shared most often, which is the same for most
  buckets of a group of copies. So a group is joined by as many comparisons as it has texts;
* then the texts that were left over, those outside their centre's class, with the texts of that class;
* then the texts left over with each other. Those of buckets whose rest is more than a block meet by their rarest
  shingles: with all shingles in one order, from rare to frequent, two texts whose Jaccard similarity is t have one in
  common among the first (1 - t) n + 1 of each. So the texts of a hot bucket, which have only a common passage in common,
  don't all meet, and no pair that is alike is passed over.

Each step deals a group's texts to blocks of a bounded number of shingles and compares pairs of blocks in tasks of their
own. In a task all overlaps of a text with a block are counted at once; those that suffice are verified exactly: equal
occurrence-labelled shingles are aligned in order, within the band that the threshold allows, and the similarity is
aligned / (shingles of both - aligned), which is at most their Jaccard similarity. A task gives back only links that join
classes, fewer than it has texts. Classes are the connected components of verified links.

In a group of near copies the second step asks the texts left over for all others, so its work grows with the product of
the two counts. It is spread over block pairs, and nothing is cut off.

Defined results: null and empty texts, and those of white space only, are classes of their own. Texts of under five
words are linked to equal ones only. Rows that repeat a doc_id share its class; if their texts differ, both texts link
it. A row without a doc_id has no class. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components, merge_classes

SHINGLE = 5
SKETCHES, ORDERED = 24, 3
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**63, SKETCHES, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, SKETCHES, np.int64).astype(np.uint64)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _C1
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words in text order, and the same labelled by their occurrence number."""
    n = len(words) - SHINGLE + 1
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    plain = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        plain = _mix(plain * _C2 + h[k : k + n])
    order = np.argsort(plain, kind="stable")
    new = np.ones(n, bool)
    new[1:] = plain[order[1:]] != plain[order[:-1]]
    if new.all():
        return plain, plain
    at = np.arange(n)
    number = np.empty(n, np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return plain, _mix(plain + number * _C2)


def _labelled(text: str) -> np.ndarray:
    """The labelled shingles of a text, none of one of under five words."""
    words = text.encode("utf-8", "surrogatepass").split()
    return shingles(words)[1] if len(words) >= SHINGLE else np.empty(0, np.uint64)


def sketch(plain: np.ndarray, labelled: np.ndarray) -> list[int]:
    """For each hash function: a 64-bit digest of it and the shingles with the smallest labelled hashes, in text order."""
    n = len(plain)
    take = min(ORDERED, n)
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, 2_000_000 // n)  # bounds memory for very long texts
    for at in range(0, SKETCHES, step):
        h = labelled[None, :] * _MUL[at : at + step, None] + _ADD[at : at + step, None]
        h ^= h >> np.uint64(31)
        h *= _C1
        first = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1)
        key = np.arange(at, at + len(h), dtype=np.uint64)
        for k in range(take):
            key = _mix(key * _C2 + plain[first[:, k]])
        out[at : at + step] = key
    return out.view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two texts from their labelled shingles: the longest in-order alignment within the band, or 0 below the threshold."""
    n, m = len(a), len(b)
    if min(n, m) < threshold * max(n, m) or not n:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = len(i)
    if common < threshold * (n + m - common):
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    band = int((1 / threshold - 1) * min(n, m)) + 1  # so many shingles at most are without a partner
    j = j[np.abs(i - j) <= band]
    if len(j) > 1 and (j[1:] < j[:-1]).any():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        common = len(tails)
    else:
        common = len(j)
    s = common / (n + m - common)
    return s if s >= threshold else 0.0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            digests, sizes, keys = [], [], []
            for text in batch.column(1).slice(at, 256).to_pylist():
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(max(0, len(words) - SHINGLE + 1))
                keys.append(sketch(*shingles(words)) if len(words) >= SHINGLE else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "keys"])


def single_below(threshold: float, lost: float = 1 / 50_000) -> int:
    """Of pairs at the threshold whose shorter text has so many shingles or more, all but ``lost`` share two sketches.

    A figure about the sketches only: no pair is passed over for sharing one.
    """

    def misses(p: float) -> float:
        return (1 - p) ** SKETCHES + SKETCHES * p * (1 - p) ** (SKETCHES - 1)

    last = 0
    for n in range(1, 1000):
        p = threshold**ORDERED
        for m in range(n, int(n / threshold + 1e-9) + 1):  # the longer text
            both = next(a for a in range(n + 1) if a >= threshold * (n + m - a) - 1e-9)
            p = min(p, comb(both, ORDERED) / max(1, comb(n + m - both, ORDERED)))
        if misses(p) > lost:
            last = n
    return last + 1


def links_of_tile(sides: np.ndarray | None, classes: np.ndarray, texts: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows that link classes: between the sides 0 and 1, or among all rows if there are no sides.

    ``texts`` are labelled shingles. Pairs that are in one class, by ``classes`` or by links found before, are passed over.
    """
    within = sides is None
    n = np.array([len(t) for t in texts])
    order = np.argsort(n, kind="stable")
    own = np.unique(classes, return_inverse=True)[1].tolist()
    parent = list(range(len(own)))

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    loop, rest = (order, order) if within else (order[sides[order] == 0], order[sides[order] == 1])
    if len(loop) > len(rest):
        loop, rest = rest, loop
    _, token, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    at = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(count), np.int32)
    shared = [t[count[t] > 1] for t in (token[at[r] : at[r + 1]] for r in rest)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in shared])]).astype(np.int64)
    flat = np.concatenate(shared)
    rest_n = n[rest]
    found = []
    for place, r in enumerate(loop):
        low, high = np.searchsorted(rest_n, [threshold * n[r] - 1e-9, n[r] / threshold + 1e-9])
        low = max(low, place + 1) if within else low
        if low >= high:
            continue
        mine = token[at[r] : at[r + 1]]
        mark[mine] = 1
        seen = np.concatenate([[0], np.cumsum(mark[flat[ends[low] : ends[high]]])])
        both = np.diff(seen[ends[low : high + 1] - ends[low]])
        mark[mine] = 0
        enough = np.flatnonzero(both >= threshold * (n[r] + rest_n[low:high] - both) - 1e-9)
        for q in rest[low + enough[np.argsort(-both[enough], kind="stable")]].tolist():
            a, b = find(own[r]), find(own[q])
            if a != b and aligned(texts[r], texts[q], threshold):
                parent[max(a, b)] = min(a, b)
                found.append((int(r), q))
    return found


def _tiles(rows: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """A row for each block pair that each text is compared in: group, i, k, side (null within a block), doc_id, class.

    ``rows``: group, other (whether the text is to meet only those for which it isn't true, or null: all of the
    group), doc_id, n, class. Groups with a single class, or with one kind of texts only, have nothing to find.
    """
    blocks = lambda w: F.ceil(F.coalesce(w, F.lit(0)) / block)
    weight = lambda other: blocks(F.sum(F.when(F.col("other") == other, F.col("n"))))
    sizes = rows.groupBy("group").agg(weight(False).alias("p"), weight(True).alias("q"), blocks(F.sum("n")).alias("all"), F.count("other").alias("sided"), F.min("class").alias("low"), F.max("class").alias("high"))
    sizes = scratch.table(sizes.where("low < high and (sided = 0 or p > 0 and q > 0)").select("group", "p", "q", "all"), "sizes")
    both = rows.join(sizes, "group")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("other").isNull(), F.col("all")).when(F.col("other"), F.col("q")).otherwise(F.col("p")))
    met = F.when(F.col("other").isNull(), F.col("all")).when(F.col("other"), F.col("p")).otherwise(F.col("q"))
    dealt = both.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)))
    i = F.when(F.col("other").isNull(), F.least("own", "met")).when(F.col("other"), F.col("met")).otherwise(F.col("own"))
    k = F.when(F.col("other").isNull(), F.greatest("own", "met")).when(F.col("other"), F.col("own")).otherwise(F.col("met"))
    side = F.coalesce("other", F.col("own") > F.col("met")).cast("int")
    within = F.col("other").isNull() & (F.col("own") == F.col("met"))
    return dealt.select("group", i.alias("i"), k.alias("k"), F.when(~within, side).alias("side"), "doc_id", "class")


def _compare(rows: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float, block: int) -> DataFrame:
    """Links (a, b) between classes of the texts of ``rows``, see ``_tiles``."""

    def ended(rows: list[tuple]) -> list[tuple[int, int]]:
        sides = None if rows[0][4] is None else np.array([r[4] for r in rows])
        if sides is not None and not 0 < sides.sum() < len(rows):  # chance left a block empty
            return []
        found = links_of_tile(sides, np.array([r[5] for r in rows]), [r[6] for r in rows], threshold)
        return [(rows[a][3], rows[b][3]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of one tile
        for batch in batches:
            links: list[tuple[int, int]] = []
            for at in range(0, batch.num_rows, 256):
                for *row, text in zip(*(x.slice(at, 256).to_pylist() for x in batch.columns), strict=True):
                    if rows and rows[-1][:3] != tuple(row[:3]):
                        links += ended(rows)
                        rows = []
                    rows.append((*row, _labelled(text)))
            yield _links(links)
        if rows:
            yield _links(ended(rows))

    tiles = _tiles(rows, scratch, block).join(texts, "doc_id")
    tiles = tiles.repartition("group", "i", "k").sortWithinPartitions("group", "i", "k")
    return tiles.select("group", "i", "k", "doc_id", "side", "class", "text").mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _centred(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """key, doc_id, n, size and centre for each text in each bucket of two or more."""
    spread = sketches.select("doc_id", "n", F.explode("keys").alias("key"))
    buckets = scratch.table(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = spread.join(buckets, "key").withColumn("weight", F.sum("size").over(Window.partitionBy("doc_id")))
    members = scratch.table(members, "members")
    centre = F.min(F.struct((-F.col("weight")).alias("w"), "doc_id"))["doc_id"]
    centres = scratch.table(members.groupBy("key").agg(centre.alias("centre")), "centres")
    return members.drop("weight").join(centres, "key")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, own, texts = (batch.column(k).slice(at, 256) for k in range(3))
            tokens = [_labelled(text) for text in texts.to_pylist()]
            n = np.array([len(t) for t in tokens])
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            columns = [ids.take(rows), own.take(rows), pa.array(np.repeat(n, n)), pa.array(np.concatenate(tokens).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "n", "token"])


def _by_rare_shingles(asked: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Groups of the texts of ``asked`` (doc_id, class) in which any two with a Jaccard similarity of ``threshold`` meet.

    A group holds the texts with a shingle among their rarest ones, so many that texts without a common one among them
    are less alike. Shingles of one text only take up places but make no group; of groups with the same texts (by their
    number and two 64-bit hashes) one is taken.
    """
    rows = texts.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("own"), "text")
    spread = rows.mapInArrow(_spread, "doc_id long, own long, n long, token long")
    common = scratch.table(spread.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1"), "common-shingles")
    text = Window.partitionBy("doc_id", "own")
    placed = spread.join(common, "token").withColumn("alone", F.col("n") - F.count("*").over(text))
    placed = placed.withColumn("place", F.col("alone") + F.row_number().over(text.orderBy("texts", "token")))
    rare = placed.where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    members = rare.groupBy("token", "doc_id").agg(F.max("n").alias("n")).join(asked.select("doc_id", "class").distinct(), "doc_id")
    members = scratch.table(members, "rare-shingles")
    which = [F.bit_xor(F.xxhash64(F.lit(k), "doc_id")).alias(f"h{k}") for k in range(2)]
    groups = members.groupBy("token").agg(F.count("*").alias("size"), *which, F.min("class").alias("low"), F.max("class").alias("high"))
    groups = scratch.table(groups.where("low < high").groupBy("size", "h0", "h1").agg(F.min("token").alias("token")).select("token"), "rare-groups")
    return members.join(groups, "token").select(F.xxhash64(F.lit("rare"), "token").alias("group"), "doc_id", "n", "class")


def _left_over(marked: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float, block: int) -> DataFrame:
    """Groups of texts outside their centre's class: all of a centre's, or those of large buckets with a rare shingle in common."""
    left = marked.where("not core")
    weights = left.groupBy("key").agg(F.sum("n").alias("w"), F.min("class").alias("low"), F.max("class").alias("high"))
    weights = scratch.table(weights.where("low < high").select("key", (F.col("w") > block).alias("large")), "left-weights")
    left = left.join(weights, "key")
    group = F.xxhash64(F.lit("left"), "centre")
    out = left.where("not large").select(group.alias("group"), "doc_id", "n", "class").distinct()
    if not weights.where("large").isEmpty():
        asked = scratch.table(left.where("large").select("doc_id", "class").distinct(), "left-large")
        out = out.union(_by_rare_shingles(asked, texts, scratch, threshold))
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, block: int = 1 << 19) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (doc_id = class_id) of each row of ``docs`` (doc_id, text).

    With the 24 sketches of 3 shingles, two texts of similarity 0.8 share a given sketch with probability 0.5; that they
    share none has a probability of 1 in 30 millions, and for more similar texts far less. ``block`` bounds a task: it
    holds two blocks of about so many shingles each. It decides how a group is dealt and which buckets' texts left over
    meet by their rarest shingles; no pair is passed over by it.
    """
    scratch = Scratch(docs.sparkSession, "order-minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = scratch.table(docs.mapInArrow(_sketches, "doc_id long, digest binary, n long, keys array<long>"), "sketches")
    firsts = scratch.table(every.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id")), "firsts")
    alike = every.select("doc_id", "digest").join(firsts, "digest").select("doc_id", "first_id")
    first = every.where("keys is not null").join(firsts, "digest").where("doc_id = first_id").dropDuplicates(["digest"])

    crowd = scratch.table(_centred(first.select("doc_id", "n", "keys"), scratch), "crowd")
    asked = crowd.select("doc_id").distinct()
    texts = docs.join(scratch.table(asked, "asked"), "doc_id", "left_semi").where(F.length("text") > 0)
    texts = scratch.table(texts.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h"), "texts")

    star = crowd.select(F.xxhash64("centre").alias("group"), "centre", "doc_id", "n").distinct()
    star = star.select("group", (F.col("doc_id") == F.col("centre")).alias("other"), "doc_id", "n", F.col("doc_id").alias("class"))
    links = scratch.table(_compare(star, texts, scratch, threshold, block), "links")
    classes = connected_components(links, scratch)

    side = lambda x: classes.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    marked = crowd.where("size > 2").join(side("doc_id"), "doc_id", "left").join(side("centre"), "centre", "left")
    own = F.coalesce("of_doc_id", "doc_id")
    marked = scratch.table(marked.select("key", "centre", "doc_id", "n", own.alias("class"), (own == F.coalesce("of_centre", "centre")).alias("core")), "marked")
    beside = marked.where("not core or doc_id <> centre").select(F.xxhash64("centre").alias("group"), F.col("core").alias("other"), "doc_id", "n", "class").distinct()
    rest = _left_over(marked, texts, scratch, threshold, block).select("group", F.lit(None).cast("boolean").alias("other"), "doc_id", "n", "class")
    more = scratch.table(_compare(beside.union(rest), texts, scratch, threshold, block), "more-links")
    classes = merge_classes(classes, _apart(more, classes), scratch)
    return scratch.result(_with_copies(every, alike, classes, scratch))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (a, b) of the ends of ``pairs`` (a, b) that aren't in one class."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("component").alias(f"class_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select(*(F.coalesce(f"class_{x}", x).alias(x) for x in "ab")).where("a <> b")


def _with_copies(every: DataFrame, alike: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The result for all rows: equal texts are in the class of their first; a doc_id with several texts links their classes."""
    own = alike.join(classes.withColumnRenamed("id", "first_id"), "first_id", "left").select("doc_id", F.coalesce("component", "first_id").alias("class"))
    ids = scratch.table(own.groupBy("doc_id").agg(F.min("class").alias("class_id"), F.max("class").alias("high")), "ids")
    if not ids.where("class_id < high").isEmpty():
        links = own.join(ids.where("class_id < high"), "doc_id").where("class <> class_id").select(F.col("class_id").alias("a"), F.col("class").alias("b"))
        merged = connected_components(links, scratch).select(F.col("id").alias("class_id"), "component")
        ids = ids.join(merged, "class_id", "left").select("doc_id", F.coalesce("component", "class_id").alias("class_id"))
    class_id = F.coalesce("class_id", "doc_id")
    return every.select("doc_id").join(ids.select("doc_id", "class_id"), "doc_id", "left").select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
