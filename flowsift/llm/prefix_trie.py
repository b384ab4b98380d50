"""The trie of conversation prefixes, where each conversation is a base's head and its own suffix.

Texts are read once and leave a turn reference each: the turn's digest and size. Fingerprints of turn sequences form a
monoid: fp(xy) = fp(x) * B^|y| + fp(y) modulo the prime 2^127 - 1. A conversation therefore gives the fingerprints of
its first turns (heads) and of its own turns behind its head (tails), and every prefix of a rebuilt conversation is a
product of one of the base's heads and one of the own tails. No rebuilt conversation is put together.

Nodes are the groups of equal (depth, fingerprint). A group is sound if its turn references agree and so do its
parents; as that holds level by level, equal fingerprints then mean equal sequences. If a group fails, all is done
again with another B.

Sums over subtrees need no walk: sorted by their paths of fingerprints, the conversations below a node stand side by
side, so a node is a range of places and its sum a difference of running sums, plus what begins at its first place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import common

PRIME = (1 << 127) - 1
#: Conversations in a row that share a base: the first of each hundred.
BLOCK = 100
#: The longest head that is taken from a base.
HEAD = 5
#: Places that one window sums up.
_SPAN = 1 << 16
#: Multipliers tried one after the other, as parts of a hashed name.
SEEDS = range(8)


def crc_head(conv: int) -> int:
    """How many turns come from the base: 0 to ``HEAD``."""
    return zlib.crc32(str(conv).encode()) % (HEAD + 1)


def multiplier(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(b"turns %d" % seed).digest()[:16], "big") % PRIME


def products(digests: list[bytes], base: int) -> list[int]:
    """Fingerprints of all prefixes of a turn sequence, the empty one first."""
    out = [0]
    for d in digests:
        out.append((out[-1] * base + int.from_bytes(d[:16], "big")) % PRIME)
    return out


def _name(depth: int, print_: int) -> bytes:
    """A node's key; keys of one depth sort together, the root is first."""
    return depth.to_bytes(4, "big") + print_.to_bytes(16, "big")


def turn_references(turns: DataFrame) -> DataFrame:
    """(conv, turn, digest, size) of every turn that has a conversation: a digest of role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).alias("size"))


def _own(references: DataFrame, base: int, head: Callable[[int], int]) -> DataFrame:
    """(conv, h, heads, tails, digests, sizes): a row per conversation; 52 bytes a turn are what a task holds of it.

    ``heads`` are the fingerprints of the first turns, ``tails`` those of what follows the own head.
    """
    names = ["conv", "h", "heads", "tails", "digests", "sizes"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.grouped(batches, ["conv"]):
            conv, digests = table.column("conv")[0].as_py(), table.column("digest").to_pylist()
            h = head(conv)
            heads, tails = products(digests[:HEAD], base), products(digests[h:], base)
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([h], pa.int32()), pa.array([[x.to_bytes(16, "big") for x in heads]], pa.list_(pa.binary())),
                                   pa.array([[x.to_bytes(16, "big") for x in tails]], pa.list_(pa.binary())), pa.array([digests], pa.list_(pa.binary())),
                                   pa.array([table.column("size").to_pylist()], pa.list_(pa.int32()))], names)

    return (references.repartition("conv").sortWithinPartitions("conv", "turn", "digest")
            .mapInArrow(fold, "conv long, h int, heads array<binary>, tails array<binary>, digests array<binary>, sizes array<int>"))


def _paths(own: DataFrame, base: int, block: int) -> DataFrame:
    """(conv, path, digests, sizes, from_base): the node of every prefix of the rebuilt conversation, the root first.

    ``digests`` and ``sizes`` belong to the last turns of path[1:]; the first ``from_base`` of them are the base's.
    """
    first = own.select(F.col("conv").alias("of"), F.col("heads").alias("b_heads"), F.slice("digests", 1, HEAD).alias("b_digests"), F.slice("sizes", 1, HEAD).alias("b_sizes"))
    names = ["conv", "path", "digests", "sizes", "from_base"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [1]
        for batch in batches:
            out = []
            for conv, h, tails, digests, sizes, b_heads, b_digests, b_sizes in zip(*(batch.column(c).to_pylist() for c in (
                    "conv", "h", "tails", "digests", "sizes", "b_heads", "b_digests", "b_sizes"))):
                taken = min(h, len(b_digests or ()))
                path = [_name(d, int.from_bytes(x, "big")) for d, x in enumerate((b_heads or [bytes(16)])[:taken + 1])]
                start = int.from_bytes(path[-1][4:], "big")
                while len(powers) < len(tails):
                    powers.append(powers[-1] * base % PRIME)
                path += [_name(taken + i, (start * powers[i] + int.from_bytes(tails[i], "big")) % PRIME) for i in range(1, len(tails))]
                out.append((conv, path, (b_digests or [])[:taken] + digests[h:], (b_sizes or [])[:taken] + sizes[h:], taken))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.binary())), pa.array(columns[2], pa.list_(pa.binary())),
                                   pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.int32())], names)

    joined = own.join(first, F.col("of") == F.col("conv") - F.col("conv") % block, "left").drop("heads", "of")
    return joined.mapInArrow(combine, "conv long, path array<binary>, digests array<binary>, sizes array<int>, from_base int")


def _nodes(placed: DataFrame) -> DataFrame:
    """(node, parent, depth, conv, n_convs, first, last, size, turn_conv, turn_no, sound) per node."""
    step = F.expr("transform(sequence(0, size(path) - 1), i -> struct(path[i] as node, if(i > 0, path[i - 1], null) as parent, i as depth,"
                  " if(i > 0, digests[i - 1], null) as digest, if(i > 0, sizes[i - 1], 0) as size))")
    rows = placed.select("conv", "place", "h", "from_base", "base", F.explode(step).alias("s")).select("conv", "place", "h", "from_base", "base", "s.*")
    # Where the last turn stands: among the base's first turns, or behind the own head.
    inherited = F.col("depth") <= F.col("from_base")
    turn = F.struct("conv", F.when(inherited, F.col("base")).otherwise(F.col("conv")).alias("of"),
                    F.when(inherited, F.col("depth") - 1).otherwise(F.col("h") + F.col("depth") - 1 - F.col("from_base")).alias("no"))
    return rows.groupBy("node", "depth").agg(
        F.min("parent").alias("parent"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("place").alias("first"), F.max("place").alias("last"),
        F.max("size").alias("size"), F.min(turn).alias("turn"),
        (F.min("digest").eqNullSafe(F.max("digest")) & F.min("parent").eqNullSafe(F.max("parent"))).alias("sound")
    ).select("node", "parent", "depth", "conv", "n_convs", "first", "last", "size", F.col("turn.of").alias("turn_conv"), F.col("turn.no").alias("turn_no"), "sound")


def _endings(placed: DataFrame) -> DataFrame:
    """(node, ends): a digest of the ids of the conversations that end at a node, in order.

    The ids stream through the digest one by one, so a node at which a third of all conversations end costs no memory.
    """
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
                if node != last:
                    if state:
                        out.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.record_batch([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["node", "ends"])
        if state:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends"])

    return (placed.select(F.element_at("path", -1).alias("node"), "conv").repartition("node").sortWithinPartitions("node", "conv")
            .mapInArrow(stream, "node binary, ends string"))


def _running(placed: DataFrame, begun: DataFrame, columns: list[str]) -> DataFrame:
    """(place, columns...): sums of ``begun`` over all places up to each one."""
    all_ = placed.select("place").join(begun, "place", "left").select("place", F.expr(f"place div {_SPAN}").alias("span"), *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))
    spans = all_.groupBy("span").agg(*(F.sum(c).alias(c) for c in columns))
    # One row per 65,536 conversations.
    ahead = spans.select(F.col("span").alias("s"), *((F.sum(c).over(Window.orderBy("span")) - F.col(c)).alias(f"{c}_ahead") for c in columns))
    inside = Window.partitionBy("span").orderBy("place")
    return all_.join(ahead, F.col("s") == F.col("span")).select("place", *((F.sum(c).over(inside) + F.col(f"{c}_ahead")).alias(c) for c in columns))


def prefix_trie(turns: DataFrame, head: Callable[[int], int] = crc_head, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv, turn_no.

    ``turns`` has (conv_id, turn, role, text); other columns are ignored. Conversation c is rebuilt from the first
    ``head(c)`` (at most ``HEAD``) turns of conversation c - c % ``block`` and its own later turns. Turns are ordered by
    ``turn``, missing first; turns of one number by a digest of role and text. A missing role or text is empty,
    and equal to an empty one. Turns without a conversation are left out; repeated rows are turns of their own. Every
    conversation is a member of the root, also if nothing is left of it. ``turn_conv`` and ``turn_no`` (from 0) say where
    the node's last turn stands. An empty table has no nodes, not even a root.
    """
    references = materialise(turn_references(turns), "turns")
    for seed in SEEDS:
        base = multiplier(seed)
        own = materialise(_own(references, base, head), "own")
        paths = _paths(own, base, block).join(own.select("conv", "h"), "conv").withColumn("base", F.col("conv") - F.col("conv") % block)
        placed = common.numbered(paths, ["path", "conv"], stem="paths")
        nodes = materialise(_nodes(placed), "nodes")
        if nodes.where("not sound").isEmpty():
            break
    else:
        raise RuntimeError("fingerprints collide with every multiplier")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("n_children"))
    told = nodes.join(children, F.col("p") == F.col("node"), "left").drop("p").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = told.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    # Nodes that begin at the same place lie on one conversation's path.
    below = Window.partitionBy("first").orderBy(F.desc("depth"))
    told = materialise(told.withColumn("saved_here", F.sum("saved").over(below)).withColumn("leaves_here", F.sum("leaf").over(below)), "told")
    begun = told.groupBy(F.col("first").alias("place")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    sums = materialise(_running(placed, begun, ["saved", "leaf"]), "sums")
    at_first = sums.select(F.col("place").alias("first"), F.col("saved").alias("saved_a"), F.col("leaf").alias("leaf_a"))
    at_last = sums.select(F.col("place").alias("last"), F.col("saved").alias("saved_b"), F.col("leaf").alias("leaf_b"))
    whole = told.join(at_first, "first").join(at_last, "last")
    # The root may have most nodes as children; its name needs no join.
    root = nodes.where("depth = 0").first()
    parents = nodes.where("depth > 0").select(F.col("node").alias("p"), F.col("conv").alias("parent_conv"))
    whole = (whole.join(parents, F.col("p") == F.when(F.col("depth") > 1, F.col("parent")), "left")
             .join(_endings(placed), "node", "left"))
    return whole.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == 1, F.lit(root["conv"] if root else None)).otherwise(F.col("parent_conv")).cast("long").alias("parent_conv_id"),
        "n_convs", F.col("n_children").cast("long").alias("n_children"), (F.col("leaves_here") + F.col("leaf_b") - F.col("leaf_a")).cast("long").alias("n_leaves"),
        (F.col("saved_here") + F.col("saved_b") - F.col("saved_a")).cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.col("turn_conv"), F.col("turn_no").cast("long").alias("turn_no"))
