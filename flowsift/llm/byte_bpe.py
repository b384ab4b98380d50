"""Byte-level BPE over a global shuffle of distinct words, and decoding by the token-byte table.

Words are what lies between safe spaces (see ``common.expand``): one or a few pre-tokens, never a part of one.
They are exploded with their positions, put together per block of documents first: a block sends each of its
distinct words once, to the task of the word's bucket, and keeps the positions as numbers of its words. Each
distinct word is encoded once there; its ids travel back to the block, where documents are put together by
position. A word in a third of all places is thus still one entry per block, and neither shuffle holds texts.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes of a block: what one task holds when it puts documents together.
BLOCK = 16 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def packed(items: list[bytes]) -> bytes:
    """A list of byte strings as one compressed string."""
    sizes = np.fromiter(map(len, items), "<u4", len(items))
    return zlib.compress(np.uint32(len(items)).tobytes() + sizes.tobytes() + b"".join(items), 1)


def checksum(raw: bytes, sizes) -> int:
    """Of the words in a row and where they end."""
    return zlib.crc32(np.fromiter(sizes, "<u4").tobytes(), zlib.crc32(raw))


def unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    """(sizes, all items in a row)."""
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n:]


def varints(x: np.ndarray) -> bytes:
    """Numbers below 2^21 in one to three bytes, seven bits each; frequent words have small numbers."""
    width = 1 + (x >= 1 << 7) + (x >= 1 << 14)
    end = np.cumsum(width)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(3):
        has = width > i
        out[(end - width)[has] + i] = (x[has] >> (7 * i) & 127) | np.where(width[has] > i + 1, 128, 0)
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    start = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(raw) else np.empty(0, np.int64)
    shift = 7 * (np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw)))))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, start) if len(raw) else start


def _block(texts: pa.Array, find) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word numbers of all texts, offsets per text, the distinct words): the most frequent word has number 0."""
    places: dict[str, int] = {}
    one = lambda unit: (places.setdefault(unit, len(places)),)
    flat, at = common.expand(texts, one, lambda u: (places.setdefault(" " + u, len(places)),),
                             lambda text: [places.setdefault(w, len(places)) for w in find(text)])
    order = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")
    number = np.empty(len(places), np.int64)
    number[order] = np.arange(len(places))
    words = list(places)
    return number[flat] if len(flat) else flat.astype(np.int64), at, [words[i].encode() for i in order.tolist()]


def _blocks(docs: DataFrame, key: str, text: str, pattern: str, buckets: int, send_words: bool) -> DataFrame:
    """One of the two things a block sends: its words, by bucket; or its documents as word numbers.

    Both come from the same scan and the same code, so names of blocks and numbers of words agree. Where the scan does not give
    the same rows twice, the checksums of each bucket's words, which go with the numbers, tell.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, part = regex.compile(pattern).findall, TaskContext.get().partitionId()
        for made, block in enumerate(common.blocks(batches, "text", BLOCK)):
            flat, at, words = _block(common.texts_of(block.column("text")), find)
            bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
            name, n = (part << 32) + made, block.num_rows
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
            lists = [[words[i] for i in order[a:b].tolist()] for a, b in zip(cuts, cuts[1:])]
            if send_words:
                yield pa.record_batch([pa.array([name] * len(lists), pa.int64()), pa.array(bucket[order[cuts[:-1]]], pa.int32()), pa.array(map(packed, lists), pa.binary())],
                                      ["block", "bucket", "words"])
            else:
                wide = len(words) >= 1 << 21
                raw = [flat[a:b].astype("<u4").tobytes() if wide else varints(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.record_batch([
                    pa.array([name] * (n + 1), pa.int64()), pa.array([0] + [2] * n, pa.int32()), pa.array([-1] + [int(wide)] * n, pa.int32()),
                    pa.concat_arrays([pa.nulls(1, block.column("key").type), block.column("key")]),
                    pa.array([zlib.compress(np.uint32(len(lists)).tobytes() + np.array([checksum(b"".join(x), map(len, x)) for x in lists], "<u4").tobytes()
                                            + bucket.astype("<u4").tobytes(), 1)] + [zlib.compress(x, 1) for x in raw], pa.binary())],
                    ["block", "what", "bucket", "key", "data"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        cut, "block long, bucket int, words binary" if send_words else f"block long, what int, bucket int, key {kind}, data binary")


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): each document's token ids as little-endian unsigned 32-bit numbers.

    Every match of ``pattern`` is encoded on its own by the ranks in the file at ``path``; special strings are
    plain text. A missing text counts as empty: no ids. Rows are independent (repeated rows, missing keys);
    other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
        ids, last = {}, None
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != last:
                    ids, last = common.Memo(lambda w: np.array(bpe.encode_ordinary(w.decode()), "<u4").tobytes(), 1 << 21), bucket
                sizes, raw = unpacked(data)
                ends = np.cumsum(sizes).tolist()
                out.append(np.uint32(checksum(raw, sizes)).tobytes() + packed([ids[raw[a:b]] for a, b in zip([0, *ends], ends)]))
            yield pa.record_batch([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "data"])

    coded = (_blocks(docs, key, text, pattern, buckets, True).repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(distinct, "block long, bucket int, data binary"))
    both = (_blocks(docs, key, text, pattern, buckets, False)
            .unionByName(coded.select("block", F.lit(1).alias("what"), "bucket", F.lit(None).cast(kind).alias("key"), "data")))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, owner, sums, held, table = None, None, None, {}, None
        for batch in batches:
            keys, out = [], []
            for i, (name, what, bucket, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "what", "bucket", "data")))):
                if name != block:
                    block, owner, held, table = name, None, {}, None
                if what == 0:
                    raw = np.frombuffer(zlib.decompress(data), "<u4")
                    owner, sums = raw[1 + raw[0]:], raw[1:1 + raw[0]]
                elif what == 1:
                    held[bucket] = data
                else:
                    if table is None:
                        if owner is None or [int.from_bytes(held[b][:4], "little") for b in sorted(held)] != sums.tolist():
                            raise RuntimeError("two scans of the documents gave different rows: write the table before encoding it")
                        table = _table(owner, {b: x[4:] for b, x in held.items()})
                        held = {}
                    flat, at, sizes = table
                    raw = zlib.decompress(data)
                    p = np.frombuffer(raw, "<u4").astype(np.int64) if bucket else from_varints(raw)
                    keys.append(i)
                    out.append(flat[common.ranges(at[p], sizes[p])].tobytes())
            yield pa.record_batch([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(out, pa.binary())], ["key", "ids"])

    out = (both.repartition("block").sortWithinPartitions("block", "what", "bucket")
           .mapInArrow(together, f"key {kind}, ids binary"))
    return out.withColumnRenamed("key", key)


def _table(owner: np.ndarray, held: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, where each word's ids begin, how many they are): a bucket's words lie in the order of their numbers."""
    sizes, starts, ids, before = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), [], 0
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order].astype(np.int64), prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        n, raw = unpacked(held[int(owner[order[a]])])
        at = order[a:b]
        sizes[at] = n // 4
        starts[at] = before + np.cumsum(n // 4) - n // 4
        ids.append(np.frombuffer(raw, "<u4"))
        before += len(ids[-1])
    return np.concatenate(ids) if ids else np.empty(0, "<u4"), starts, sizes


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, bytes): joins every id with the table of token bytes, which the rank file bounds.

    The table is broadcast (one entry per rank). Missing ids decode to empty bytes; an id without an entry
    is an error.
    """
    kind = encoded.schema[key].dataType.simpleString()
    back = encoded.sparkSession.sparkContext.broadcast({v: k for k, v in ranks_of(path).items()})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = back.value
        dense = [table.get(i) for i in range(max(table, default=-1) + 1)]
        for batch in batches:
            for block in common.blocks([batch], "ids"):
                out = [b"".join(map(dense.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in block.column("ids").to_pylist()]
                yield pa.record_batch([block.column("key"), block.column("ids"), pa.array(out, pa.binary())], ["key", "ids", "bytes"])

    out = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(joined, f"key {kind}, ids binary, bytes binary")
    return out.withColumnRenamed("key", key)
