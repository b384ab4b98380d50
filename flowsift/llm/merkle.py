"""A Merkle manifest of a table: one tree per source, one over their roots, and a proof for every row by pointer jumping.

* Leaves are numbered per source in the order of their ids (``common.numbered``: sorted by range, no source in one
  task). Every ``ARITY`` neighbours become their parent, level by level; each level is a table a third of the last.
* A node's pointer names its parent, with the siblings on the way as a segment. A self-join of the pointers of level
  l with those of level l + d doubles the distance from d to 2d and concatenates the segments; after about
  log2(height) joins every leaf has reached the root. Only levels that later jumps start from are joined.
* A source's root points nowhere; its segment is its own path through the tree of roots, so one join by
  source suffices, of one row each.

Digests travel as 32 bytes; they are hashed as lower-case hex text. Everything is DataFrame functions but the numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import common

#: Neighbours that share a parent.
ARITY = 3
#: Columns of ``documents`` that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENT = "array<struct<l: binary, r: binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields: each ``-`` if missing, else its length in bytes, a colon and its value."""
    def one(value: Column) -> Column:
        said = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))

    return _hash(F.concat(*map(one, fields)))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables of runs (tree, up, kids), one per level; a run alone in its tree that holds one node holds the tree's root.

    ``leaves`` has (tree, place, digest, load); only leaves have a load. A run has ``ARITY`` kids at most.
    """
    tables, nodes = [], leaves
    while True:
        kid = F.struct("place", "digest", *(["load"] if "load" in nodes.columns else []))
        tables.append(materialise(nodes.groupBy("tree", F.expr(f"place div {ARITY}").alias("up"))
                                  .agg(F.sort_array(F.collect_list(kid)).alias("kids")), "level"))
        runs = tables[-1].where(~_lone())
        if runs.isEmpty():
            return tables
        nodes = runs.select("tree", F.col("up").alias("place"), _hash(F.concat_ws("", F.transform("kids", lambda k: _hex(k["digest"])))).alias("digest"))


def _lone() -> Column:
    return (F.col("up") == 0) & (F.size("kids") == 1)


def _roots(tables: list[DataFrame]) -> DataFrame:
    """(tree, digest): the root of each tree."""
    found = [t.where(_lone()).select("tree", F.col("kids")[0]["digest"].alias("digest")) for t in tables]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _pointers(table: DataFrame, tops: DataFrame | None) -> DataFrame:
    """(tree, place, load, up, path, top): a node's parent, null for a root, and the siblings it needs on the way there.

    ``top`` is the digest of the tree's root, known at roots only. ``tops`` (tree, path) leads on from the roots.
    """
    def beside(i: Column, left: bool) -> Column:
        side = F.slice("kids", F.lit(1), i) if left else F.slice("kids", i + 2, F.lit(ARITY))
        return F.aggregate(side, F.lit(b""), lambda acc, k: F.concat(acc, k["digest"]))

    nodes = table.select("tree", "up", "kids", _lone().alias("alone"), F.posexplode("kids").alias("i", "kid"))
    segment = F.array(F.struct(beside(F.col("i"), True).alias("l"), beside(F.col("i"), False).alias("r")))
    load = "kid.load" if "load" in table.schema["kids"].dataType.elementType.names else F.lit(None)
    nodes = nodes.select("tree", F.col("kid.place").alias("place"), (F.col(load) if isinstance(load, str) else load).alias("load"),
                         F.when(~F.col("alone"), F.col("up")).alias("up"), F.when(~F.col("alone"), segment).alias("path"),
                         F.when(F.col("alone"), F.col("kid.digest")).alias("top"))
    on_root = F.lit(None).cast(_SEGMENT)
    if tops is not None:
        roots = nodes.where("up is null").join(tops.select(F.col("tree").alias("of"), F.col("path").alias("on")), F.col("tree").eqNullSafe(F.col("of")), "left")
        nodes = nodes.where("up is not null").withColumn("on", on_root).union(roots.drop("of"))
    else:
        nodes = nodes.withColumn("on", on_root)
    return nodes.select("tree", "place", "load", "up", F.coalesce("path", "on", F.array().cast(_SEGMENT)).alias("path"), "top")


def _jump(near: DataFrame, far: DataFrame) -> DataFrame:
    """Pointers of ``near`` followed by the pointers they end at: twice the distance, the segments one after the other."""
    far = far.select(F.col("tree").alias("t"), F.col("place").alias("p"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("top").alias("top2"))
    return (near.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("p")), "left")
            .select("tree", "place", "load", F.col("up2").alias("up"), F.concat("path", F.coalesce("path2", F.array().cast(_SEGMENT))).alias("path"),
                    F.coalesce("top", "top2").alias("top")))


def _paths(tables: list[DataFrame], tops: DataFrame | None = None) -> DataFrame:
    """The leaves' pointers once they have reached their roots: (tree, load, path, top)."""
    at = {level: _pointers(t, tops) for level, t in enumerate(tables)}
    distance = 1
    while distance < len(tables):
        at = {level: _jump(at[level], at[level + distance]) if level + distance in at else at[level]
              for level in at if level % (2 * distance) == 0}
        distance *= 2
    return at[0].select("tree", "load", "path", "top")


def manifest(rows: DataFrame, tree: str, order: str, leaf: Column, carry: list[str]) -> DataFrame:
    """(carry..., leaf, path, subroot, root) for every row: ``path`` holds the siblings (l, r) of each level up to the root.

    Per value of ``tree`` (a missing one is a value, and the first) leaves ascend by ``order``, missing first, then by
    digest, so that repeated rows are leaves side by side. The roots of the trees, in the order of ``tree``, are the
    leaves of the last tree. A tree of one leaf is that leaf. An empty table gives no rows.
    """
    slim = rows.select(F.col(tree).alias("tree"), F.col(order).alias("by"), leaf.alias("digest"), F.struct(*carry).alias("load"))
    leaves = common.numbered(slim, ["tree", "by", "digest"], "tree", "place", "leaves")
    tables = _levels(leaves.select("tree", "place", "digest", F.struct("digest", "load").alias("load")))
    roots = _roots(tables).select(F.lit("").alias("all"), F.col("tree").alias("of"), "digest")
    upper = _levels(common.numbered(roots, ["all", "of"], "all", "place", "roots")
                    .select(F.col("all").alias("tree"), "place", "digest", F.col("of").alias("load")))
    root = _roots(upper).first()  # one row, none for an empty table
    tops = _paths(upper).select(F.col("load").alias("tree"), "path")
    return _paths(tables, tops).select(*(F.col("load.load")[c].alias(c) for c in carry), F.col("load.digest").alias("leaf"), "path",
                                       F.col("top").alias("subroot"), F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.unhex(F.aggregate(path, _hex(leaf), lambda acc, s: F.sha2(F.concat(_hex(s["l"]), acc, _hex(s["r"])), 256)))


def proofs(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, tree: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Leaf, subroot, root and digest of the proof per row, and what the proof says of a copy whose text is ``tampered``.

    Every row is a leaf, a missing text or id included (``-`` in the leaf). Repeated rows give repeated leaves, columns
    other than ``fields`` are ignored, and an empty table gives an empty table.
    """
    copy = leaf_of(*(tampered if f == text else F.col(f) for f in fields))
    rows = docs.select(F.col(key).alias("key"), F.col(tree).alias("in"), leaf_of(*map(F.col, fields)).alias("own"), copy.alias("copy"))
    found = manifest(rows, "in", "key", F.col("own"), ["key", "copy"]).withColumn("fold", folded(F.col("copy")))
    return found.select(F.col("key").alias(key), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
                        F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(_hex(s["l"]), _hex(s["r"])))), 256).alias("proof_sha256"),
                        _hex(F.col("fold")).alias("folded_root"), (F.col("fold") == F.col("root")).alias("verified"))


def without_breaks(key: str = "doc_id", text: str = "text") -> Column:
    """The text, without its line feeds where 2 divides the checksum of the id in decimals; rows without an id are left alone."""
    return F.when(F.crc32(F.col(key).cast("string")) % 2 == 0, F.translate(text, "\n", "")).otherwise(F.col(text))
