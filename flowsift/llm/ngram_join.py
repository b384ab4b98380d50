"""Jaccard self-join of documents on word n-grams by trees of count vectors.

A document is the set of its distinct n-grams. Hashing the n-grams into groups makes it a point whose
coordinates are the groups' counts, and the overlap of two documents is at most the sum of their coordinates'
minima. Equivalently, two documents that link lie within L1 distance ``r`` of each other, where ``r`` follows
from their sizes.

* Routing. Boxes of whole vectors overlap too much to tell tasks apart, so the groups are dealt into more than
  ``r`` bands: two linked documents differ in at most ``r`` bands and so have equal counts in another. The
  address of a leaf is (size class, band, counts in the band). Documents that meet at the addresses of a few must meet at
  as many of them as the bound on differing bands demands, and are then tested by the summed minima of their
  whole vectors; documents at a crowded address are joined by a star, never by pairs. What
  is connected so forms families, outside of which no link can exist. Passages that many documents share would
  make one family of all of them, so bands are taken over the rarer n-grams, which differ no more than the whole
  sets do. Documents whose rarer n-grams fill too few bands are routed by finer bands of these as well, and by all
  their n-grams only if even those are too few.
* Inside a family (or a chunk of one of bounded size) an R-tree is packed over the count vectors. A query
  passes a node only if the sum of minima with the node's upper corner allows enough overlap, then each point,
  and what survives is verified on the n-grams themselves. Points that are already connected are skipped.
* Families of several chunks share a hub, the document at the most crowded addresses. What the chunks leave
  outside the hub's component is then compared with all chunks of its family.

Equal sets are one node from the start, so copies cost nothing further.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import intermediates, materialise
from . import common
from .graph import components

#: N-grams of a chunk: what one task compares in memory (8 bytes each).
CHUNK = 1 << 20
#: Points of an R-tree leaf.
LEAF = 32
#: Documents at an address whose pairs are tested one by one.
FEW = 8
#: How many times as many bands the finer ones are, and the first number of their kinds; a text that Spark can hold has
#: fewer than 2^31 n-grams and so a size class below 57.
FINER, FINER_KIND = 8, 140
#: Cells of the table that tells frequent n-grams from rare ones, whatever the corpus; it goes out in pages.
CELLS, PAGE = 1 << 23, 1 << 16
_K = np.uint64(0x9E3779B97F4A7C15)
#: Bits of an address that tell its kind.
_KIND = np.uint64(255)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text, sorted; a shorter text is one n-gram, one without words none."""
    code, at, words = common.words_of(texts, lower=True)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[code]
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            n, w = b - a, min(width, b - a)
            if not n:
                out.append(np.empty(0, np.uint64))
                continue
            grams = np.full(n - w + 1, w, np.uint64)
            for i in range(w):
                grams = common.mix(grams * _K + hashed[a + i:b - w + 1 + i])
            out.append(np.unique(grams))
    return out


def node_of(grams: np.ndarray) -> bytes:
    """A 128-bit name of the set; its first six bytes serve as the short name in routing."""
    with np.errstate(over="ignore"):
        return (np.add.reduce(common.mix(grams)).tobytes() + np.add.reduce(common.mix(grams ^ _K)).tobytes()
                + np.uint32(len(grams)).tobytes())


def short(node: bytes) -> int:
    return int.from_bytes(node[:6], "little")


def narrow(numbers: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


class Rule:
    """When sets link: 100 * overlap >= percent * union, all in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(self.bounds[-1] * 3 // 2 + 1)
        self.lower = np.array(self.bounds)

    def needed(self, a, b):
        """The least overlap of sets of sizes a and b that links them."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(size class, most differing bands, bands) of the classes where a set of this size can be the lesser or greater."""
        at, out = int(np.searchsorted(self.lower, size, "right")) - 1, []
        while not out or 100 * size >= self.percent * self.bounds[at]:
            most = 2 * (self.bounds[at + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            out.append((at, most, most + 2 + most // 6))
            at += 1
        return out

    def addresses(self, grams: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The leaves of the routing level, a hash of each band's counts, and how many of a leaf's kind two linked sets share.

        A set gives all bands that hold one of its rare n-grams. If these are more than the bands in which a
        partner can differ, one of them is shared with every partner; all but the bands that differ are. If they are not
        more, the set also gives ``FINER`` times as many bands of them, of which the same holds among the sets that give these.
        If even those are not more, it gives bands over all its n-grams too, empty ones included where needed, and meets there
        every partner of that kind. The last eight bits of an address tell its kind: size class, whether bands are fine and
        whether all n-grams count. The numbers end at 255.
        """
        rare = grams if frequent is None else grams[~frequent[cell_of(grams)]]
        out, least = [], []
        for size_class, most, bands in self.bands(len(grams)):
            for number, name in ((bands, 2 * size_class), (FINER * bands, FINER_KIND + 2 * size_class)):
                counts, full = _bands(rare, number)
                out.append(_address(counts, full, name))
                least.append(np.full(len(full), min(255, max(1, len(full) - most)), np.uint8))
                if len(full) > most:
                    break
            else:
                counts, full = _bands(grams, bands)
                use = full if len(full) > most else np.arange(bands)
                out.append(_address(counts, use, 2 * size_class + 1))
                least.append(np.full(len(use), min(255, max(1, len(use) - most)), np.uint8))
        return np.concatenate(out), np.concatenate(least)


def cell_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(40)).astype(np.int64) % CELLS


def _bands(grams: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """A random linear hash of each band's group counts, and the bands that hold anything.

    A band has 2^32 groups: with few, bands of different n-grams had equal counts by chance, as often as the square of the documents.
    """
    band = ((grams >> np.uint64(20)) % np.uint64(bands)).astype(np.int64)
    counts = np.zeros(bands, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(counts, band, common.mix((grams & np.uint64(0xFFFFFFFF)) + np.uint64(1)))
    return counts, np.flatnonzero(np.bincount(band, minlength=bands))


def _address(counts: np.ndarray, use: np.ndarray, name: int) -> np.ndarray:
    return common.mix(counts[use] ^ common.mix(use.astype(np.uint64) + np.uint64(name << 40))) & ~_KIND | np.uint64(name)


def frequent_cells(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """Cells of hashed n-grams that hold clearly more than the usual number, as packed bits (1 MB).

    Every document counts. Which cells these are decides where documents are routed, never which ones link.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint16)
        for block in common.blocks(batches, "text"):
            sets = shingle_sets(common.texts_of(block.column("text")), width)
            cells, times = np.unique(cell_of(np.concatenate(sets)), return_counts=True)
            counts[cells] = np.minimum(counts[cells].astype(np.int64) + times, 65535)
        pages = [(p, zlib.compress(counts[p * PAGE:(p + 1) * PAGE].astype("<u2").tobytes(), 1)) for p in range(CELLS // PAGE)]
        yield pa.record_batch([pa.array([p for p, _ in pages], pa.int32()), pa.array([c for _, c in pages], pa.binary())], ["page", "counts"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, data in zip(batch.column("page").to_pylist(), batch.column("counts").to_pylist()):
                totals[page] = totals.get(page, 0) + np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64)
        rows = []
        for page, counts in totals.items():
            usual = float(np.median(counts))
            rows.append((page, np.packbits(counts > usual + 5 * np.sqrt(usual + 1) + 10).tobytes()))
        yield pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["page", "bits"])

    pages = docs.select(F.col(text).alias("text")).mapInArrow(count, "page int, counts binary").repartition("page").mapInArrow(judge, "page int, bits binary")
    out = np.zeros(CELLS // 8, np.uint8)
    for r in pages.collect():  # one row per page
        out[r.page * PAGE // 8:(r.page + 1) * PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def meetings(keys: np.ndarray, nodes: np.ndarray, least: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What the addresses say, as edges (a, b, kind, times, needed), and the (key, node, least) triples that a later meeting needs.

    At an address of at most ``FEW`` nodes every two of them are an edge of the address's kind. How often they need to meet
    follows from both ends: all bands that hold anything are given by both, so the greater number holds; where a set
    may give empty bands as well, the lesser one. A larger address gives a star around its least node, which counts
    untested and has kind -1; one node more than ``FEW`` of it go on, so that it is known for a large one.
    """
    order = np.lexsort((nodes, keys))
    keys, nodes, least = keys[order], nodes[order], least[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, least = keys[fresh], nodes[fresh], least[fresh]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(keys)))
    found = []
    for k in range(2, FEW + 1):
        at = first[size == k]
        kind = (keys[at] & _KIND).astype(np.int64)
        for i in range(k):
            for j in range(i + 1, k):
                x, y = least[at + i].astype(np.int64), least[at + j].astype(np.int64)
                found.append((nodes[at + j], nodes[at + i], kind, np.where(kind % 2 == 0, np.maximum(x, y), np.minimum(x, y))))
    large = np.repeat(size > FEW, size) & ~new
    hub = nodes[np.repeat(first, size)]
    found.append((nodes[large], hub[large], np.full(int(large.sum()), -1), np.ones(int(large.sum()), np.int64)))
    a, b, kind, needed = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(4))
    order = np.lexsort((kind, b, a))
    a, b, kind, needed = a[order], b[order], kind[order], needed[order]
    start = np.ones(len(a), bool)
    start[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])
    times = np.diff(np.append(np.flatnonzero(start), len(a)))
    go = np.arange(len(keys)) - np.repeat(first, size) <= FEW
    return [a[start], b[start], kind[start], times, needed[start]], [keys[go], nodes[go], least[go]]


def sketch_of(grams: np.ndarray) -> bytes:
    """Group counts of the set, one byte each; at least a group for every four n-grams, so that counts stay telling."""
    groups = 1 << max(6, (len(grams) // 4).bit_length())
    while True:
        counts = np.bincount((grams >> np.uint64(44)).astype(np.int64) % groups, minlength=groups)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


def may_link(a: bytes, b: bytes, rule: Rule) -> bool:
    """Whether the sum of minima of two sketches allows enough overlap; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(-1, len(y)).sum(0)
    return int(np.minimum(x, y).sum()) >= rule.needed(int(x.sum()), int(y.sum()))


def _route(docs: DataFrame, rule: Rule, width: int, key: str, text: str) -> DataFrame:
    """Documents as (key, node, short, n, sketch), and edges (a, b, kind, w, needed) between short names that share an address."""
    session, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * parts
    frequent = session.sparkContext.broadcast(frequent_cells(docs, width, text))
    schema = f"what int, bucket int, key {kind}, node binary, n long, p binary, q binary, w binary, c binary"
    columns = ["what", "bucket", "key", "node", "n", "p", "q", "w", "c"]

    def rows(what, bucket, key_col, node=None, n=None, p=None, q=None, w=None, c=None):
        k = len(bucket)
        return pa.record_batch([pa.array([what] * k, pa.int32()), pa.array(bucket, pa.int32()), key_col,
                                pa.array(node or [None] * k, pa.binary()), pa.array(n or [None] * k, pa.int64()),
                                *(pa.array(x or [None] * k, pa.binary()) for x in (p, q, w, c))], columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(frequent.value).astype(bool)
        for block in common.blocks(batches, "text"):
            sets = shingle_sets(common.texts_of(block.column("text")), width)
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield rows(0, [i % buckets for i in range(len(sets))], block.column("key"), nodes, [len(s) for s in sets],
                       [sketch_of(s) if len(s) else None for s in sets])
            there = {n: s for n, s in zip(nodes, sets) if n}  # copies within the block count once
            if not there:
                continue
            each = [rule.addresses(s, hot) for s in there.values()]
            ids = np.repeat(np.array([short(n) for n in there], np.int64), [len(x) for x, _ in each])
            edge, (keys, ids, least) = meetings(np.concatenate([x for x, _ in each]), ids, np.concatenate([x for _, x in each]))
            nothing, only = block.column("key").type, edge[2] < 0  # the others meet again
            if only.any():
                yield rows(1, [int(edge[0][0] % buckets)], pa.nulls(1, nothing), p=[edge[0][only].tobytes()], q=[edge[1][only].tobytes()],
                           w=[edge[3][only].tobytes()])
            bucket = ((keys >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            kinds = (keys & _KIND).astype(np.uint8)
            order = np.lexsort((least, kinds, bucket))
            keys, ids, bucket, least, kinds = keys[order], ids[order], bucket[order], least[order], kinds[order]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
            # A bucket's share takes the same 13 bytes an address at any number of buckets: 40 bits of it, as the bucket tells
            # more of them and addresses that are taken for equal only add pairs to test, the node, the kind and the least.
            spans = list(zip(cuts, cuts[1:]))
            yield rows(2, bucket[cuts[:-1]].tolist(), pa.nulls(len(spans), nothing), p=[narrow(keys[x:y] >> np.uint64(24), 5) for x, y in spans],
                       q=[narrow(ids[x:y], 6) for x, y in spans], w=[kinds[x:y].tobytes() for x, y in spans], c=[least[x:y].tobytes() for x, y in spans])

    out_names = ["key", "node", "short", "n", "sketch", "a", "b", "kind", "w", "needed"]

    def edges(key_type, *columns):
        k = len(columns[0])
        return pa.record_batch([pa.nulls(k, key_type), pa.nulls(k, pa.binary()), *(pa.nulls(k, pa.int64()),) * 2, pa.nulls(k, pa.binary()),
                                *map(pa.array, columns)], out_names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, least, key_type = [], [], [], pa.null()
        for batch in batches:
            key_type = batch.column("key").type
            what = batch.column("what").to_numpy(zero_copy_only=False)
            docs_ = batch.filter(pa.array(what == 0))
            k, nodes = docs_.num_rows, docs_.column("node")
            brief = pa.array([short(n) if n else None for n in nodes.to_pylist()], pa.int64())
            yield pa.record_batch([docs_.column("key"), nodes, brief, docs_.column("n"), docs_.column("p"), *(pa.nulls(k, pa.int64()),) * 5], out_names)
            for row in zip(*(batch.filter(pa.array(what == 1)).column(c).to_pylist() for c in "pqw")):
                a, b, w = (np.frombuffer(x, np.int64) for x in row)
                yield edges(key_type, a, b, np.full(len(a), -1), w, np.ones(len(a), np.int64))
            for bucket, p, q, w, c in zip(*(batch.filter(pa.array(what == 2)).column(c).to_pylist() for c in ("bucket", *"pqwc"))):
                keys.append(wide(p, 5) << np.uint64(24) | np.uint64((bucket & 0xFFFF) << 8) | np.frombuffer(w, np.uint8))
                ids.append(wide(q, 6).astype(np.int64))
                least.append(np.frombuffer(c, np.uint8))
        if keys:
            yield edges(key_type, *meetings(np.concatenate(keys), np.concatenate(ids), np.concatenate(least))[0])

    return materialise(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(deal, schema)
                       .repartition(parts, "bucket").mapInArrow(meet, f"key {kind}, node binary, short long, n long, sketch binary, a long, b long, kind long, w long, needed long"), "routed")


def _tested(routed: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b, w) that count: certain ones, and those whose sketches allow a link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [may_link(x, y, rule) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            yield batch.select(["a", "b", "w"]).filter(pa.array(good, pa.bool_()))

    # A pair counts as often as it meets at addresses of one kind; where that is too seldom for every kind, it has no link or
    # both its ends are in the star of a crowded address. Only then are the sketches fetched.
    met = routed.where("a is not null").groupBy("a", "b", "kind").agg(F.sum("w").alias("w"), F.max("needed").alias("needed"))
    edges = materialise(met.where("kind < 0 or w >= needed").groupBy("a", "b").agg(F.sum("w").alias("w"), F.min("kind").alias("kind")), "pairs")
    sketches = routed.where("node is not null").select("short", "sketch").distinct()  # of every node, should two share a name
    todo = materialise(edges.where("kind >= 0"), "tested")
    ends = materialise(todo.select(F.explode(F.array("a", "b")).alias("end")).distinct(), "ends")
    sketches = materialise(sketches.join(ends, F.col("end") == F.col("short"), "left_semi"), "sketches")
    pairs = (todo.join(sketches.select(F.col("short").alias("a"), F.col("sketch").alias("sa")), "a")
             .join(sketches.select(F.col("short").alias("b"), F.col("sketch").alias("sb")), "b"))
    return materialise(edges.where("kind < 0").select("a", "b", "w").union(
        pairs.select("a", "b", "w", "sa", "sb").mapInArrow(test, "a long, b long, w long")), "edges", outer=True)


class Tree:
    """R-tree over count vectors, packed by size: leaves of ``LEAF`` points with their upper corner."""

    def __init__(self, sets: list[np.ndarray], groups: int):
        self.groups = groups
        self.size = np.array([len(s) for s in sets], np.int64)
        self.points = np.stack([self.point(s) for s in sets])
        # Sort-tile packing: by size into slabs, within a slab by the count of the first half of the groups.
        slab = np.empty(len(sets), np.int64)
        slab[np.argsort(self.size, kind="stable")] = np.arange(len(sets)) // (LEAF * 16)
        self.order = np.lexsort((self.points[:, : groups // 2].sum(1), slab))
        starts = np.arange(0, len(sets), LEAF)
        self.corner = np.maximum.reduceat(self.points[self.order], starts)
        self.least = np.minimum.reduceat(self.size[self.order], starts)
        self.most = np.maximum.reduceat(self.size[self.order], starts)

    def point(self, grams: np.ndarray) -> np.ndarray:
        return np.bincount((grams >> np.uint64(44)).astype(np.int64) % self.groups, minlength=self.groups).astype(np.int32)

    def near(self, point: np.ndarray, size: int, rule: Rule) -> np.ndarray:
        """Points that may have enough overlap with the query."""
        fits = (100 * self.most >= rule.percent * size) & (100 * size >= rule.percent * self.least)
        leaves = np.flatnonzero(fits)
        bound = np.minimum(self.corner[leaves], point).sum(1)
        leaves = leaves[bound >= rule.needed(size, self.least[leaves])]
        if not len(leaves):
            return leaves
        at = self.order[np.concatenate([np.arange(x * LEAF, min((x + 1) * LEAF, len(self.order))) for x in leaves.tolist()])]
        other = self.size[at]
        return at[np.minimum(self.points[at], point).sum(1) >= rule.needed(size, other)]


def groups_for(sets: list[np.ndarray]) -> int:
    """Groups per vector: more for larger sets, so that counts stay telling."""
    return 1 << min(9, max(5, int(np.median([len(s) for s in sets])).bit_length() - 1))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def chunk_links(sets: list[np.ndarray], rule: Rule, queries: list[int] | None = None, group: list | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected in the chunk: every component's spanning edges.

    ``queries`` restricts the left ends; ``group`` names points that are connected already.
    """
    tree, union = Tree(sets, groups_for(sets)), Union(len(sets))
    seen: dict = {}
    for i, g in enumerate(group or []):
        if g is not None:
            union.link(seen.setdefault(g, i), i)
    # Central points first: their links join most others, whose pairs then need no test.
    middle = tree.points / np.maximum(tree.size, 1)[:, None]
    todo = list(range(len(sets))) if queries is None else queries
    todo.sort(key=dict(enumerate(np.abs(middle - middle.mean(0)).sum(1).tolist())).__getitem__)
    links = []
    for i in todo:
        for j in tree.near(tree.points[i], len(sets[i]), rule).tolist():
            if union.top(i) != union.top(j) and overlap(sets[i], sets[j]) >= rule.needed(len(sets[i]), len(sets[j])):
                union.link(i, j)
                links.append((i, j))
    return links


def _sets_of(docs: DataFrame, members: DataFrame, width: int, text: str) -> DataFrame:
    """(short, node, packed) of the documents whose set is a member, each set once per task.

    The compressed text goes out, as it is less than half of the n-grams, which its readers make again. A filter of fixed size thins the documents out before the join, which settles what is a member.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(common.membership(members, "short"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = common.Memo(lambda _: True, 1 << 20)
        for block in common.blocks(batches, "text"):
            out, texts = [], common.texts_of(block.column("text"))
            for i, grams in enumerate(shingle_sets(texts, width)):
                if len(grams):
                    node = node_of(grams)
                    if node not in seen and common.may_hold(bitmap.value, np.array([short(node)]))[0]:
                        seen[node]
                        out.append((short(node), node, zlib.compress(texts[i].as_buffer())))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                                  ["short", "node", "packed"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(sets, "short long, node binary, packed binary")
    return found.join(members, "short")


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    return shingle_sets(pa.array([zlib.decompress(packed)], pa.binary()).cast(pa.string()), width)[0]


def _compare(rows: DataFrame, by: list[str], rule: Rule, width: int) -> DataFrame:
    """Links (a, b) within the groups of ``by``; rows with ``asks`` are compared with all, others only with those."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.grouped(batches, by):
            held: dict[bytes, tuple] = {}
            for node, packed, asks, group in zip(*(table.column(c).to_pylist() for c in ("node", "packed", "asks", "comp"))):
                if node not in held or asks:
                    held[node] = (packed, asks, group)
            nodes = list(held)
            links = chunk_links([_unpacked(p, width) for p, _, _ in held.values()], rule,
                                [i for i, (_, asks, _) in enumerate(held.values()) if asks], [c for _, _, c in held.values()])
            yield pa.record_batch([pa.array([nodes[i] for i, _ in links], pa.binary()), pa.array([nodes[j] for _, j in links], pa.binary())], ["a", "b"])

    return (rows.select(*by, "node", "packed", "asks", "comp").repartition(*by).sortWithinPartitions(*by)
            .mapInArrow(compare, "a binary, b binary"))


def links_of(docs: DataFrame, routed: DataFrame, rule: Rule, width: int, text: str, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between nodes that connect whatever the rule connects."""
    with intermediates(docs.sparkSession):
        edges = _tested(routed, rule)
    family = components(edges.select("a", "b"))
    sizes = routed.where("node is not null").groupBy("node", "short").agg(F.max("n").alias("n"))
    weight = edges.groupBy(F.col("a").alias("short")).agg(F.sum("w").alias("w"))
    members = (family.select(F.col("node").alias("short"), F.col("root").alias("family"))
               .join(sizes.groupBy("short").agg(F.sum("n").alias("n")), "short").join(weight, "short", "left"))
    members = materialise(members, "members")
    families = members.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / chunk)).cast("long").alias("chunks"),
                                             F.expr("max_by(short, struct(coalesce(w, 0), short))").alias("hub"))
    placed = materialise(members.join(families, "family").select(
        "short", "family", "chunks", F.expr("short = hub").alias("central"),
        F.expr("pmod(xxhash64(short), chunks)").alias("chunk")), "placed")
    # The hub stands in every chunk of its family.
    everywhere = placed.select("short", "family", F.explode(
        F.when(F.col("central"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))).alias("chunk"))
    none = F.lit(None).cast("binary").alias("comp")
    inner = _sets_of(docs, everywhere, width, text).withColumn("asks", F.lit(True)).withColumn("comp", none)
    links = materialise(_compare(inner, ["family", "chunk"], rule, width), "links")
    several = placed.where("chunks > 1")
    if several.isEmpty():
        return links

    # Of families in several chunks: what isn't in the hub's component meets every other chunk.
    joined = components(links).select("node", F.col("root").alias("comp"))
    state = materialise(several.join(sizes.select("node", "short"), "short").join(joined, "node", "left").select(
        "short", "node", "family", "chunks", "chunk", "central", F.coalesce("comp", "node").alias("comp")), "states")
    main = state.where("central").groupBy("family").agg(F.min("comp").alias("main"))
    state = state.join(main, "family").withColumn("outside", F.col("comp") != F.col("main"))
    askers = state.where("outside")
    sets = materialise(_sets_of(docs, state.join(askers.select("family").distinct(), "family", "left_semi").drop("node"), width, text), "sets")
    # A task compares one chunk of a family with one chunk's outsiders.
    left = (sets.where("outside").withColumn("ask", F.col("chunk")).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
            .select("family", "chunk", "ask", "node", "packed", F.lit(True).alias("asks"), "comp"))
    asked = askers.groupBy("family").agg(F.collect_set("chunk").alias("asking"))  # at most ``chunks`` numbers
    right = (sets.join(asked, "family").withColumn("ask", F.explode("asking"))
             .select("family", "chunk", "ask", "node", "packed", F.lit(False).alias("asks"), "comp"))
    return links.union(materialise(_compare(left.unionByName(right), ["family", "chunk", "ask"], rule, width), "outside"))


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                   chunk: int = CHUNK) -> DataFrame:
    """(key, n_shingles, component_id) per row: groups connected by Jaccard similarity of ``percent`` or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer words than ``width`` is one
    n-gram; a missing, empty or blank text has none, links with nothing and is its own component.
    ``component_id`` is the least key of the component; rows without a key take part but lend no name, so it is
    null only where no row of the component has a key. Links are not counted: pairs within what is connected already
    are not verified. Repeated rows give repeated rows. Other columns are
    ignored. An empty table gives an empty table.
    """
    rule = Rule(percent)
    routed = _route(docs, rule, width, key, text)
    links = links_of(docs, routed, rule, width, text, chunk)
    rows = routed.where("n is not null").select("key", "node", "n")
    least = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("least"))
    named = least.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written first, so that the join by root is of two plain shuffles, which Spark splits where one component is large.
    roots = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = named.join(roots, "root").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
