"""Near-duplicate embeddings by collision counting on one-dimensional projections.

Every vector is scaled to length one and projected on many random directions. Sorted by one projection, the
vectors that lie in a window around a query collide with it; two vectors at the wanted cosine collide in each
projection with a known probability, so the number of collisions over all projections is binomial. The least
count that such a pair misses with a probability of ``MISS`` at most is the calibrated threshold; pairs that
reach it are verified by their cosine in double precision.

Equal vectors of a label are one node from the start. A label is cut into blocks along its first projection,
and tasks compare pairs of blocks; what leaves a task is a number of links and a connection per vector, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import common
from .graph import components

PROJECTIONS = 64
#: Half the window, in standard deviations of the projected difference of a pair at the wanted cosine.
REACH = 1.5
#: The probability of missing a pair that just has the wanted cosine.
MISS = 1e-9
#: Vectors of a block.
BLOCK = 4096


def least_collisions(projections: int = PROJECTIONS, reach: float = REACH, miss: float = MISS) -> int:
    """The greatest count that a pair at the wanted cosine falls short of with probability ``miss`` at most."""
    p = math.erf(reach / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


@lru_cache(16)
def directions(dimension: int, projections: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed + dimension).standard_normal((dimension, projections))


def window(cosine: float, reach: float = REACH) -> float:
    """Half the width of the window: the projected difference is normal with the pair's distance as deviation."""
    return reach * math.sqrt(2 - 2 * cosine)


def cosine_pairs(left: np.ndarray, right: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into left, into right) with at least this cosine, by collision counts; ``same``: only i < j."""
    scale = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = scale(left), scale(right)
    axes, half = directions(left.shape[1]), window(cosine)
    pa_, pb = a @ axes, b @ axes
    counts = np.zeros((len(a), len(b)), np.uint8)
    for j in range(axes.shape[1]):
        order = np.argsort(pb[:, j], kind="stable")
        along = pb[order, j]
        low, high = np.searchsorted(along, pa_[:, j] - half), np.searchsorted(along, pa_[:, j] + half, "right")
        for i, (x, y) in enumerate(zip(low.tolist(), high.tolist())):
            counts[i, order[x:y]] += 1
    i, j = np.nonzero(counts >= least_collisions())
    if same:
        i, j = i[i < j], j[i < j]
    dots = np.einsum("nd,nd->n", left[i], right[j])
    norms = np.linalg.norm(left, axis=1)[i] * np.linalg.norm(right, axis=1)[j]
    good = dots / norms >= cosine
    return i[good], j[good]


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n points the least point that the pairs (i, j) connect it with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _nodes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, node, label, dim, vec, first, norm): node is null where the vector or the label can't link; ``first`` is the
    vector's place along a first direction of length ``norm``."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, label)}

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, dim, raw, first, norm = [], [], [], [], []
            for v, of in zip(batch.column("vec").to_pylist(), batch.column("label").to_pylist()):
                x = np.array([np.nan if y is None else y for y in v], np.float64) if v else np.empty(0)
                if of is None or not len(x) or not np.isfinite(x).all() or not x.any() or not np.isfinite(x @ x) or not x @ x:
                    for column in (node, dim, raw, first, norm):
                        column.append(None)
                    continue
                data = (x + 0.0).tobytes()  # -0.0 counts as 0.0
                node.append(xxhash.xxh3_128_digest(f"{of}:".encode() + data))
                dim.append(len(x))
                raw.append(data)
                axis = directions(len(x), 1)[:, 0]
                first.append(float(x @ axis / np.linalg.norm(x)))
                norm.append(float(np.linalg.norm(axis)))
            yield pa.record_batch([batch.column("key"), batch.column("label"), pa.array(node, pa.binary()), pa.array(dim, pa.int32()),
                                   pa.array(raw, pa.binary()), pa.array(first, pa.float64()), pa.array(norm, pa.float64())],
                                  ["key", "label", "node", "dim", "vec", "first", "norm"])

    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("vec"), F.col(label).alias("label")).mapInArrow(
        named, f"key {kinds[key]}, label {kinds[label]}, node binary, dim int, vec binary, first double, norm double")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) per row, linking rows of equal labels with at least this cosine.

    A vector that is missing, empty, zero or has missing or non-finite components, or whose label is missing, links
    with nothing and is its own component. Vectors of different lengths don't link. Equal vectors link like any
    other; repeated rows count as rows. ``component_id`` is the least key of the component (rows without a key lend
    none); ``kept`` says that the row's key is it. Other columns are ignored; an empty table gives an empty table.
    """
    rows = materialise(_nodes(vectors, key, vector, label), "vectors")
    nodes = (rows.where("node is not null").groupBy("node", "label", "dim")
             .agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.min("first").alias("first"), F.min("norm").alias("norm"), F.first("vec").alias("vec")))
    nodes = materialise(nodes, "nodes")

    # Blocks of a label: equal counts along the first projection, by a histogram of fixed resolution.
    group = ["label", "dim"]
    cell = nodes.withColumn("cell", F.floor((F.col("first") + 8) * 4096).cast("long"))
    running = Window.partitionBy(*group).orderBy("cell")
    cells = cell.groupBy(*group, "cell").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(running) - F.col("n"))
    cells = cells.withColumn("block", F.floor(F.col("before") / block).cast("long"))
    # A crowded cell is cut by hash, so no block grows beyond twice the size.
    cells = cells.withColumn("cuts", F.ceil(F.col("n") / block).cast("long"))
    placed = (cell.join(cells.select(*group, "cell", "block", "cuts"), [*group, "cell"])
              .withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts"))))
    placed = materialise(placed.select(*group, "block", "cut", "node", "first", "norm", "copies", "vec"), "blocks")
    spans = placed.groupBy(*group, "block", "cut").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.max("norm").alias("norm"))
    # Blocks that are apart by more than any linked pair can be along the first direction are not compared.
    right = spans.select(*group, *(F.col(c).alias(f"other_{c}") for c in ("block", "cut", "low", "high")))
    gap = F.greatest(F.col("other_low") - F.col("high"), F.col("low") - F.col("other_high"))
    pairs = (spans.join(right, group)
             .where((F.struct("block", "cut") <= F.struct("other_block", "other_cut")) & (gap <= F.col("norm") * math.sqrt(2 - 2 * cosine) + 1e-9)))
    pairs = materialise(pairs.select(*group, "block", "cut", "other_block", "other_cut"), "pairs")
    names = ["block", "cut", "other_block", "other_cut"]
    lefts = placed.join(pairs, [*group, "block", "cut"]).select(*group, *names, F.lit(0).alias("side"), "node", "copies", "vec")
    rights = (placed.withColumnsRenamed({"block": "other_block", "cut": "other_cut"}).join(pairs.where("block < other_block or cut < other_cut"), [*group, "other_block", "other_cut"])
              .select(*group, *names, F.lit(1).alias("side"), "node", "copies", "vec"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.grouped(batches, [*group, *names]):
            side = table.column("side").to_numpy()
            dim = table.column("dim")[0].as_py()
            part = [table.filter(pa.array(side == s)) for s in (0, 1)]
            x = [np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(-1, dim) for t in part]
            ids = [t.column("node").to_pylist() for t in part]
            same = not len(x[1])
            i, j = cosine_pairs(x[0], x[0] if same else x[1], cosine, same)
            if not same:
                j = j + len(ids[0])
            node = ids[0] + ids[1]
            copies = np.concatenate([t.column("copies").to_numpy() for t in part])
            # Of the pairs only sums and connections leave: a row per node, with its links' number and one node that it hangs on.
            linked = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            some = np.flatnonzero(linked)
            root = connected(len(node), i, j)
            yield pa.record_batch([pa.array([node[k] for k in some.tolist()], pa.binary()), pa.array([node[k] for k in root[some].tolist()], pa.binary()),
                                   pa.array(linked[some].astype(np.int64))], ["a", "b", "linked"])

    links = materialise(lefts.unionByName(rights).repartition(*group, *names).sortWithinPartitions(*group, *names, "side")
                        .mapInArrow(compare, "a binary, b binary, linked long"), "links")
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    named = nodes.select("node", "least", "copies").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written first, so that the join by root is of two plain shuffles, which Spark splits where one component is large.
    roots = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = named.join(roots, "root").join(degree, "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = rows.select("key", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
