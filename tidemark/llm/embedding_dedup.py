"""Embedding near-duplicates: every vector against every other by cosine, in PCA-ordered tiles.

Equal vectors are collapsed first. The others are rotated to the principal axes of a bounded sample and dealt to tiles
by a tree of cuts along the leading axes; tiles whose boxes lie too far apart for the cosine are never compared. Within
a pair of tiles, products over the leading axes come first; Cauchy-Schwarz on the norms of the rest bounds what may
follow, and a pair is dropped once it cannot reach the threshold. What is left is compared in full in double precision.
The rotation only decides how soon pairs are dropped, never the result.

Tiles are written once, a file each, and a task reads one tile and some of those within reach; vectors are shuffled once
and never copied. A task gives back one row for each of its vectors: a count of links and its group within the tiles. So
even where a group links everyone with everyone, no list of pairs arises. The driver holds a box for each tile.

Defined results: null and empty vectors, and those with null or non-finite components or without a length, link with
nothing. So do vectors of different lengths with each other. Rows that repeat a vec_id are different vectors when
counting links and one in components. A row without a vec_id links with nothing and has no component. Further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, as_uri
from tidemark.llm.components import connected_components

BLOCK = 1024
PAIRS = 50_000
#: How many of the leading axes tiles are cut along and their boxes hold.
AXES = 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def principal_axes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes (columns) of unit vectors, the one of most spread first, and their mean squares."""
    values, axes = np.linalg.eigh(sample.T @ sample / max(1, len(sample)))
    centred = sample - sample.mean(0)
    spread = ((centred @ axes) ** 2).mean(0)
    order = np.argsort(-spread)
    return axes[:, order], np.maximum(values[order], 0)


def leading(energy: np.ndarray, threshold: float) -> int:
    """How many axes to begin with: until an ordinary pair's bound is under the threshold by 3.5 standard deviations."""
    total = max(energy.sum(), 1e-12)
    for k in range(8, len(energy), 8):
        done = energy[:k] / total
        if threshold - (1 - done.sum()) >= 3.5 * math.sqrt((done**2).sum()):
            return k
    return len(energy)


class Links:
    """Counts of links and groups of the rows of two tiles."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.counts, i, self.weights[j])
        np.add.at(self.counts, j, self.weights[i])
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def compare(x: np.ndarray, split: int, weights: np.ndarray, axes: np.ndarray, k: int, threshold: float) -> Links:
    """Links between the first ``split`` rows of ``x`` and the others or, if there are no others, among them all."""
    alone = split == len(x)
    links = Links(weights)
    unit = _unit(x)
    turned = unit @ axes
    rest = np.sqrt(np.maximum(1 - (turned[:, :k] ** 2).sum(1), 0))
    lead = np.column_stack([turned[:, :k], rest]).astype(np.float32)  # one product gives the bound
    k2 = min(len(axes), 2 * k)
    rest2 = np.sqrt(np.maximum(1 - (turned[:, :k2] ** 2).sum(1), 0))
    others = 0 if alone else split
    for at in range(0, split, BLOCK):
        first = at if alone else others
        rows, columns = np.nonzero(lead[at : min(at + BLOCK, split)] @ lead[first:].T >= threshold - 1e-4)
        rows, columns = rows + at, columns + first
        if alone:
            rows, columns = rows[columns > rows], columns[columns > rows]
        for part in range(0, len(rows), PAIRS):
            i, j = rows[part : part + PAIRS], columns[part : part + PAIRS]
            if k2 < len(axes):
                bound = np.einsum("ij,ij->i", turned[i, :k2], turned[j, :k2]) + rest2[i] * rest2[j]
                i, j = i[bound >= threshold - 1e-9], j[bound >= threshold - 1e-9]
            cosine = np.einsum("ij,ij->i", unit[i], unit[j])
            found = cosine >= threshold
            if found.any():
                links.add(i[found], j[found])
    return links


@dataclass(frozen=True)
class Cuts:
    """A complete binary tree of cuts: node k's children are 2k + 1 and 2k + 2; the leaves are tiles, from 0 on."""

    axis: np.ndarray
    at: np.ndarray
    depth: int

    def tiles(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - (2**self.depth - 1)


def cuts_of(x: np.ndarray, depth: int) -> Cuts:
    """Cuts of a sample, each along the axis on which its node spreads most: in a wide gap near the middle, else at the median."""
    axis, at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    rows = {0: x}
    for node in range(2**depth - 1):
        here = rows.pop(node)
        if len(here):
            axis[node] = int(np.argmax(here.max(0) - here.min(0)))
            v = np.sort(here[:, axis[node]])
            low = len(v) // 5
            gaps = np.diff(v[low : len(v) - low])
            wide = int(np.argmax(gaps)) if len(gaps) else 0
            at[node] = v[low + wide + 1] if len(gaps) and gaps[wide] > 0.1 * (v[-1] - v[0]) else v[len(v) // 2]
        right = here[:, axis[node]] >= at[node]
        rows[2 * node + 1], rows[2 * node + 2] = here[~right], here[right]
    return Cuts(axis, at, depth)


def within_reach(low: np.ndarray, high: np.ndarray, reach: float) -> list[np.ndarray]:
    """For each box: the boxes from itself on that are no further away than ``reach``."""
    out = []
    for t in range(len(low)):
        apart = np.maximum(0, np.maximum(low[t:] - high[t], low[t] - high[t:]))
        out.append(t + np.flatnonzero((apart**2).sum(1) <= reach * reach))
    return out


def _linked(reps: DataFrame, dim: int, n: int, threshold: float, tile_rows: int, sample_rows: int, together: int, scratch: Scratch) -> DataFrame:
    """cid, links and root of the representatives (cid, copies, embedding) of one dimension, a row for each tile pair."""
    sample = reps.select(F.xxhash64("cid").alias("h"), "embedding").orderBy("h").limit(sample_rows).select("embedding").toArrow()
    unit = _unit(_vectors(sample.column(0), dim))
    axes, energy = principal_axes(unit)
    k = leading(energy, threshold)
    lead = axes[:, : min(AXES, dim)]
    cuts = cuts_of(unit @ lead, max(0, math.ceil(math.log2(n / tile_rows))))
    kind = reps.schema["embedding"].dataType.simpleString()
    reps = reps.select("cid", "copies", "embedding")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_vectors(batch.column(2), dim)) @ lead
                cut = cuts.tiles(x)
                for c in np.unique(cut):
                    here = x[cut == c]
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([len(here)]), pa.array([here.min(0).tolist()]), pa.array([here.max(0).tolist()])], ["cut", "n", "low", "high"])

    boxes = reps.mapInArrow(dealt, "cut long, n long, low array<double>, high array<double>")
    each = lambda f, c: [f(F.col(c)[i]).alias(f"{c}{i}") for i in range(lead.shape[1])]
    boxes = boxes.groupBy("cut").agg(F.sum("n").alias("n"), *each(F.min, "low"), *each(F.max, "high")).orderBy("cut").collect()
    # tiles that come out too large are split by a hash
    parts_of, start_of = np.ones(2**cuts.depth, np.int64), np.zeros(2**cuts.depth, np.int64)
    low, high = [], []
    may_lack = set()  # the hash may leave a part of a tile without a row
    for r in boxes:
        parts_of[r.cut], start_of[r.cut] = max(1, -(-r.n // (2 * tile_rows))), len(low)
        if parts_of[r.cut] > 1:
            may_lack.update(range(len(low), len(low) + int(parts_of[r.cut])))
        low += [r[2 : 2 + lead.shape[1]]] * int(parts_of[r.cut])
        high += [r[2 + lead.shape[1] :]] * int(parts_of[r.cut])
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    near = within_reach(np.array(low), np.array(high), reach)

    def to_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
                cut = cuts.tiles(_unit(_vectors(batch.column(2), dim)) @ lead)
                spread = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start_of[cut] + spread % parts_of[cut])], ["cid", "copies", "embedding", "tile"])

    folder = f"{scratch.path}/tiles-{dim}"
    placed = reps.mapInArrow(to_tiles, f"cid long, copies long, embedding {kind}, tile long")
    placed.repartition(len(low), "tile").write.partitionBy("tile").parquet(folder)
    folder = as_uri(folder)
    work = [(t, u[at : at + together].tolist()) for t, u in enumerate(near) for at in range(0, len(u), together)]
    work = reps.sparkSession.createDataFrame(work, "t long, us array<long>").repartition(len(work), "t", "us")

    def read(tile: int) -> list[pa.Table]:
        store, name = fs.FileSystem.from_uri(f"{folder}/tile={tile}")
        found = store.get_file_info(fs.FileSelector(name, allow_not_found=tile in may_lack))
        return [pq.ParquetFile(store.open_input_file(x.path)).read(["cid", "copies", "embedding"]) for x in found if x.path.endswith(".parquet")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = read(t)
                for u in us:
                    other = [] if u == t else read(u)
                    if not own or u != t and not other:
                        continue
                    both = pa.concat_tables(own + other)
                    ids = both.column("cid").to_numpy()
                    links = compare(_vectors(both.column("embedding"), dim), sum(map(len, own)), both.column("copies").to_numpy(), axes, k, threshold)
                    some = np.flatnonzero(links.counts)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links.counts[some]), pa.array(ids[links.root[some]])], ["cid", "links", "root"])

    return work.mapInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile_rows: int = 8192, sample_rows: int = 8192, together: int = 4) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding).

    ``tile_rows`` bounds a task: it holds two tiles, each of up to twice as many rows, and compares one with up to
    ``together`` others in turn. ``sample_rows`` is how many vectors (those with the smallest hash) the rotation and the
    cuts are fitted on.
    """
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e)
    hashed = vectors.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding")})
    slim = scratch.table(hashed.select("vec_id", "fine", "h1", "h2"), "keys")
    classes = slim.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    reps = hashed.where("fine").join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["cid"])
    reps = scratch.table(reps.select("cid", "copies", "embedding", F.size("embedding").alias("dim")), "reps")
    found = [_linked(reps.where(F.col("dim") == r.dim), r.dim, r["count"], threshold, tile_rows, sample_rows, together, scratch) for r in reps.groupBy("dim").count().collect()]  # a row for each length of vector
    if not found:
        return scratch.result(slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
    found = scratch.table(reduce(DataFrame.union, found), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    own = scratch.table(slim.where("fine").join(classes, ["h1", "h2"]).select("vec_id", "cid").distinct(), "ids")
    several = own.groupBy("vec_id").agg(F.min("cid").alias("a"), F.max("cid").alias("high")).where("a < high").select("vec_id", "a")
    same_id = own.join(several, "vec_id").select("a", F.col("cid").alias("b"))
    component = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).union(same_id), scratch)
    known = classes.join(links, "cid", "left").join(component.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = scratch.table(known.select("h1", "h2", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = scratch.table(known.join(least, "component").select("h1", "h2", "component_id", "n"), "labelled")
    out = slim.join(known, ["h1", "h2"], "left")
    component_id = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("fine"), F.col("n")).otherwise(0).cast("long")
    return scratch.result(out.select("vec_id", n_links.alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept")))
