"""Removal of long repeated word sequences, found by recompression.

Recompression shortens a text in rounds: maximal runs of a symbol become one symbol, then the alphabet is dealt into a
left and a right half and every pair of a left symbol before a right one becomes one symbol. Names are hashes of
what they replace, so that all tasks give equal runs and pairs the same name. Each symbol knows its reach, the words
that suffice to make it: any text that holds these words holds the symbol there. Equal substrings thus share
all symbols whose reach lies within them.

Spark rounds over blocks of documents (``_asked``: a block sends each distinct name once, to the task of the
name's bucket, and gets a bit back):

1. Names of the symbols. A name that no other document has proves all windows around its reach to be unique. Documents
   without other windows are done; in ordinary text that is most of it.
2. Names of segments: what is left is cut at the symbols; a segment is all windows that begin within one symbol, named by
   its words. If a document with a smaller id has the segment, all its windows go.
3. Names of single windows, for segments that no document with a smaller id has. Each distinct segment is held by
   its least document here, so copies cost nothing in this round and every window still has its least document.

The proof in round 1 leaves windows in that need not be, never out; rounds 2 and 3 decide by 96-bit names of the words.
Texts are written once with the numbers of their blocks; later rounds carry on only what is undecided.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import intermediates, materialise
from . import common

#: Words of a window.
WINDOW = 50
#: Rounds of recompression; each leaves about three quarters of the symbols, so a symbol has some four words in the end.
ROUNDS = 5
#: Symbols of more words are left as they are, so that no reach outgrows a window by one unlucky pair.
LONGEST = 8
#: Text bytes of a block, and of a row that holds texts of it.
BLOCK, CHUNK = 8 << 20, 64 << 10
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Odd multipliers of the two word hashes.
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_FAR = 1 << 40
_NO_ID = (1 << 63) - 1
_DONE = 0xFFFFFFFF


def recompress(words: np.ndarray, at: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> tuple[np.ndarray, ...]:
    """(names, starts, from, to, document) of the symbols after ``rounds`` rounds over documents [at[i], at[i + 1]) of hashed words.

    A symbol's reach is words [from, to); what depends on the beginning or end of a document reaches beyond it.
    """
    name, start = words.copy(), np.arange(len(words), dtype=np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    low, high, length = start.copy(), start + 1, np.ones(len(words), np.int64)
    with np.errstate(over="ignore"):
        for turn in range(rounds):
            if len(name) < 2:
                break
            # Runs. A run's ends show only by its neighbours, so these are in its reach.
            active = length <= longest
            begins = np.ones(len(name), bool)
            begins[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | ~active[1:]
            first = np.flatnonzero(begins)
            times = np.diff(np.append(first, len(name)))
            left, right = _beside(low, high, doc)
            own, last = active[first], first + times - 1
            low = np.where(own, np.minimum(np.minimum.reduceat(low, first), left[first]), low[first])
            high = np.where(own, np.maximum(np.maximum.reduceat(high, first), right[last]), high[first])
            name = np.where(times > 1, common.mix(name[first] * _K1 + times.astype(np.uint64) * _K2), name[first])
            length, start, doc = np.add.reduceat(length, first), start[first], doc[first]
            # Pairs. Two symbols tell that they merge; that one stays alone shows by the neighbour it could have merged with.
            active = length <= longest
            side = common.mix(name + np.uint64(turn + 1) * _K2) >> np.uint64(63) == 1
            joins = np.zeros(len(name), bool)
            joins[:-1] = active[:-1] & active[1:] & side[:-1] & ~side[1:] & (doc[1:] == doc[:-1])
            joined = np.zeros(len(name), bool)
            joined[1:] = joins[:-1]
            left, right = _beside(low, high, doc)
            alone = active & ~joins & ~joined
            low, high = np.where(alone & ~side, np.minimum(low, left), low), np.where(alone & side, np.maximum(high, right), high)
            i = np.flatnonzero(joins)
            name[i] = common.mix(name[i] * _K1 ^ common.mix(name[i + 1] + _K2))
            low[i], high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
            length[i] += length[i + 1]
            keep = ~joined
            name, start, low, high, length, doc = (x[keep] for x in (name, start, low, high, length, doc))
    return name, start, low, high, doc


def _beside(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left neighbour's ``low`` and the right one's ``high``; beyond a document everything is needed."""
    left, right, edge = np.full(len(low), -_FAR), np.full(len(high), _FAR), doc[1:] != doc[:-1]
    left[1:], right[:-1] = np.where(edge, -_FAR, low[:-1]), np.where(edge, _FAR, high[1:])
    return left, right


class Block:
    """The hashed words of some documents and the names of any stretch of them."""

    def __init__(self, texts: pa.Array):
        code, self.at, distinct = common.words_of(texts)
        self.words = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[code]
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []

    def stretches(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of words [start, end) each, equal for equal words wherever they stand."""
        n, out = len(self.words), []
        with np.errstate(over="ignore"):
            if not self.sums:
                for i, base in enumerate(_BASES):
                    power = np.cumprod(np.full(n + 1, base, np.uint64))
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix(self.words + np.uint64(i)) * power[:-1])))
                    back = np.cumprod(np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64))
                    self.sums.append((total, back))
            for total, back in self.sums:
                out.append(common.mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _K1))
        return out[0], out[1]

    def symbols(self, window: int) -> tuple[np.ndarray, ...]:
        """(names, from, to, document) of the symbols that can prove anything, and where all symbols begin."""
        name, start, low, high, doc = recompress(self.words, self.at)
        use = (low >= 0) & (high <= len(self.words)) & (high - low <= window) & (np.diff(self.at) >= window)[doc]
        return name[use], low[use], high[use], doc[use], start


def _dealt(bucket: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order by bucket, then keys, and where each bucket begins in it, with the end."""
    order = np.lexsort((*keys[::-1], bucket))
    return order, np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()


def shared_names(block: Block, window: int, buckets: int) -> tuple[list[tuple[int, bytes, bytes]], np.ndarray, tuple[np.ndarray, ...]]:
    """Messages (bucket, names, in several documents), each symbol's place in the answer, and the symbols."""
    symbols = block.symbols(window)
    name, doc = symbols[0], symbols[3]
    distinct, which = np.unique(name, return_inverse=True)
    least, most = np.full(len(distinct), _FAR), np.full(len(distinct), -1)
    np.minimum.at(least, which, doc)
    np.maximum.at(most, which, doc)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order, cuts = _dealt(bucket, distinct)
    short = (distinct[order] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    several = (most > least)[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = [(int(bucket[order[a]]), short[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for a, b in zip(cuts, cuts[1:])]
    return out, place[which], symbols


def least_names(block: Block, start: np.ndarray, end: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[list[tuple[int, bytes, bytes]], np.ndarray]:
    """Messages (bucket, names, least ids) for stretches of words, and each stretch's place in the answer.

    A stretch that a document of the block with a smaller id has needs no answer: its place is ``_DONE``.
    """
    one, two = block.stretches(start, end)
    order = np.lexsort((ids, two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    first = order[fresh]
    group = np.cumsum(fresh) - 1
    bucket = (two[first] % np.uint64(buckets)).astype(np.int64)
    dealt, cuts = _dealt(bucket, one[first])
    rank = np.empty(len(dealt), np.int64)
    rank[dealt] = np.arange(len(dealt))
    place = np.empty(len(order), np.int64)
    place[order] = np.where(ids[order] > ids[first][group], _DONE, rank[group])
    sent = first[dealt]
    high = (two[sent] >> np.uint64(32)).astype("<u4")
    return [(int(bucket[dealt[a]]), one[sent[a:b]].astype("<u8").tobytes() + high[a:b].tobytes(), zstandard.ZstdCompressor(level=1).compress(ids[sent[a:b]].astype("<i8").tobytes()))
            for a, b in zip(cuts, cuts[1:])], place


def _are_shared(names: list[bytes], several: list[bytes]) -> list[bytes]:
    """For each message, which of its names another message has too, or one document besides."""
    sizes = [len(n) // 5 for n in names]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 5)
    marked = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8))[:n] for s, n in zip(several, sizes)])
    _, which, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    twice = (times + np.bincount(which, marked, len(times)) > 1)[which]
    return [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(sizes)[:-1])]


def _are_later(names: list[bytes], ids: list[bytes]) -> list[bytes]:
    """For each message, which of its stretches a document with a smaller id than here has."""
    sizes = [len(n) // 12 for n in names]
    one = np.concatenate([np.frombuffer(n, "<u8", k) for n, k in zip(names, sizes)])
    two = np.concatenate([np.frombuffer(n, "<u4", k, 8 * k) for n, k in zip(names, sizes)])
    own = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(i), "<i8") for i in ids])
    order = np.lexsort((own, two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    later = np.empty(len(order), bool)
    later[order] = own[order] > own[order[fresh]][np.cumsum(fresh) - 1]
    return [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(sizes)[:-1])]


# Rows of the rounds' tables. TEXTS: some texts of a block, with what is known of them; ASK: a message; DONE: a result.
_ANSWER, _TEXTS, _ASK, _RESULT = range(4)
_SCHEMA = "kind int, block long, no long, keys array<long>, data binary, extra binary, n_words long, n_removed long, sha string"
_NAMES = ["kind", "block", "no", "keys", "data", "extra", "n_words", "n_removed", "sha"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _packed(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(texts) + 1}Q", len(texts), *map(len, texts)) + b"".join(texts))


def _unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<Q", raw)
    out, at = [], 8 + 8 * n
    for size in struct.unpack_from(f"<{n}Q", raw, 8):
        out.append(raw[at:at + size])
        at += size
    return out


def _text_rows(block: int, keys: list, texts: list[bytes], known: list[bytes] | None = None) -> Iterator[tuple]:
    """The texts of a block in rows of some 64 KB, in order; ``known`` is what is known of each text."""
    start, held = 0, 0
    for i, text in enumerate([*texts, None]):
        if i > start and (text is None or held + len(text) > CHUNK):
            yield (_TEXTS, block, start, keys[start:i], _packed(texts[start:i]), _packed(known[start:i]) if known else None, None, None, None)
            start, held = i, 0
        held += len(text or b"")


def _ranges(decided: np.ndarray, open_: np.ndarray) -> bytes:
    """What is known of a document: ranges (start, end) that go, ranges (start, end, place in the answer) still open.

    Starts and ends as steps and lengths, which compress well: most are 1.
    """
    parts = [struct.pack("<Q", decided.shape[1])]
    for table in (decided, open_):
        parts += [np.diff(table[0], prepend=0).astype("<i4").tobytes(), (table[1] - table[0]).astype("<u4").tobytes()]
    return b"".join([*parts, open_[2].astype("<u4").tobytes()])


def _from_ranges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (k,) = struct.unpack_from("<Q", data)
    n = (len(data) - 8 - 8 * k) // 12
    decided, steps = np.frombuffer(data, "<i4", 2 * k, 8).astype(np.int64).reshape(2, k), np.frombuffer(data, "<i4", 2 * n, 8 + 8 * k).astype(np.int64).reshape(2, n)
    start, begin = np.cumsum(decided[0]), np.cumsum(steps[0])
    return np.array([start, start + decided[1]]), np.array([begin, begin + steps[1], np.frombuffer(data, "<u4", n, 8 + 8 * k + 8 * n).astype(np.int64)])


def _read_rows(table: pa.Table) -> tuple[np.ndarray, list, list[bytes], list[bytes]]:
    """(answers, keys, texts, what is known of each) of a block's rows, which lie in order."""
    bits, keys, texts, known = [], [], [], []
    for kind, keys_, data, extra, n in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "data", "extra", "n_words"))):
        if kind == _ANSWER:
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8))[:n])
            continue
        keys += keys_
        texts += _unpacked(data)
        if extra:
            known += _unpacked(extra)
    return (np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)), keys, texts, known


def _ids(keys: list) -> np.ndarray:
    """Ids as numbers; a row without an id stands behind all others."""
    return np.array([_NO_ID if k is None else k for k in keys], np.int64)


def _result(block: int, key, text: bytes, removed: np.ndarray | None = None) -> tuple:
    """What is left of a text whose words ``removed`` go."""
    words = text.split()  # bytes split at \\x20 and \\x09-\\x0D
    n = 0
    if removed is not None:
        n = int(removed.sum())
        edges = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=1, append=1)).tolist()
        words_ = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
    else:
        words_ = words
    return (_RESULT, block, 0, [key], None, None, len(words), n, hashlib.sha256(b" ".join(words_)).hexdigest())


def _covered(n: int, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words windows cover that begin in [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _messages(block: int, messages: list[tuple[int, bytes, bytes]]) -> Iterator[tuple]:
    for bucket, names, more in messages:
        yield (_ASK, block, bucket, None, names, more, None, None, None)


def _asked(table: DataFrame, answer: Callable, width: int) -> DataFrame:
    """The table's texts with the answers to its messages before them, block by block."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, ["no"]):
            names = group.column("data").to_pylist()
            bits = answer(names, group.column("extra").to_pylist())
            yield _batch([(_ANSWER, block, no, None, data, None, len(n) // width, None, None)
                          for block, no, data, n in zip(group.column("block").to_pylist(), group.column("no").to_pylist(), bits, names)])

    messages = table.where(F.col("kind") == _ASK).select("block", "no", "data", "extra")
    answers = messages.repartition("no").sortWithinPartitions("no").mapInArrow(reply, _SCHEMA)
    return (table.where(F.col("kind") == _TEXTS).unionByName(answers).repartition("block").sortWithinPartitions("block", "kind", "no"))


def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) per row: words go that a window covers which a document with a smaller id has too.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are; a missing, empty or blank text has none, and a text of fewer than
    ``window`` words no window. Windows are judged on the input. ``key`` holds whole numbers; rows without one
    stand behind all others and don't repeat each other, and neither do rows of one id. Repeated windows within a
    document stay. Repeated rows give repeated rows, other columns are ignored, an empty table gives an empty table.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for made, batch in enumerate(common.blocks(batches, "text", BLOCK)):
            texts, name = common.texts_of(batch.column("text")), (part << 32) + made
            yield _batch(list(_text_rows(name, batch.column("key").to_pylist(), texts.cast(pa.binary()).to_pylist())))
            yield _batch(list(_messages(name, shared_names(Block(texts), window, buckets)[0])))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.grouped(batches, ["block"]):
            name = table.column("block")[0].as_py()
            answers, keys, texts, _ = _read_rows(table)
            block = Block(pa.array(texts, pa.binary()).cast(pa.string()))
            _, place, (_, low, high, doc, cuts) = shared_names(block, window, buckets)
            n = len(block.words)
            windows = np.zeros(n + 1, bool)  # where a window begins
            sizes = np.diff(block.at)
            long = np.flatnonzero(sizes >= window)
            windows[common.ranges(block.at[long], sizes[long] - window + 1)] = True
            lone = ~answers[place]
            steps = np.zeros(n + 2, np.int64)
            np.add.at(steps, np.maximum(high[lone] - window, block.at[doc[lone]]), 1)
            np.add.at(steps, low[lone] + 1, -1)
            windows &= np.cumsum(steps[:-1]) <= 0
            # Segments: windows in a row, cut where a symbol begins.
            fresh = np.zeros(n + 1, bool)
            fresh[cuts] = True
            open_ = windows & (fresh | ~np.concatenate(([False], windows[:-1])))
            start = np.flatnonzero(open_)
            stop = windows[:-1] & (fresh[1:] | ~windows[1:])
            end = np.flatnonzero(stop) + 1
            owner = np.searchsorted(block.at, start, "right") - 1
            messages, where = least_names(block, start, end + window - 1, _ids(keys)[owner], buckets)
            yield from _onward(name, keys, texts, block, owner, (start, end, where), messages)

    def _onward(name, keys, texts, block, owner, columns, messages, decided=None):
        """Results of the documents without open columns; the others with their columns, relative to the document."""
        counts = np.bincount(owner, minlength=len(keys))
        at = common.offsets_of(counts)
        done, left = [], []
        for i in range(len(keys)):
            if counts[i]:
                rows = slice(at[i], at[i + 1])
                mine = np.concatenate([columns[0][rows] - block.at[i], columns[1][rows] - block.at[i], columns[2][rows]])
                before = decided[i] if decided else np.empty((2, 0), np.int64)
                left.append((i, _ranges(before, mine.reshape(3, -1))))
            else:
                removed = None
                if decided and decided[i].shape[1]:
                    removed = _covered(int(block.at[i + 1] - block.at[i]), decided[i][0], decided[i][1], window)
                done.append(_result(name, keys[i], texts[i], removed))
        yield _batch(done)
        yield _batch(list(_text_rows(name, [keys[i] for i, _ in left], [texts[i] for i, _ in left], [k for _, k in left])))
        yield _batch(list(_messages(name, messages)))

    def _judged(table: pa.Table):
        """(block name, keys, texts, ranges that go, ranges that stay open) with the answers at hand."""
        answers, keys, texts, known = _read_rows(table)
        gone, still = [], []
        for before, (start, end, where) in map(_from_ranges, known):
            later = where == _DONE
            later[~later] = answers[where[~later]]
            gone.append(np.concatenate([before, [start[later], end[later]]], axis=1))
            still.append(np.array([start[~later], end[~later]]))
        return table.column("block")[0].as_py(), keys, texts, gone, still

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.grouped(batches, ["block"]):
            name, keys, texts, gone, still = _judged(table)
            if not keys:
                continue
            block = Block(pa.array(texts, pa.binary()).cast(pa.string()))
            starts = [common.ranges(s, e - s) + block.at[i] for i, (s, e) in enumerate(still)]
            owner = np.repeat(np.arange(len(keys)), list(map(len, starts)))
            start = np.concatenate(starts)
            messages, where = least_names(block, start, start + window, _ids(keys)[owner], buckets)
            yield from _onward(name, keys, texts, block, owner, (start, start + 1, where), messages, gone)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.grouped(batches, ["block"]):
            name, keys, texts, gone, _ = _judged(table)
            yield _batch([_result(name, k, t, _covered(len(t.split()), *g, window)) for k, t, g in zip(keys, texts, gone)])

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    done = F.col("kind") == _RESULT
    # Each round's table goes when the next is written.
    with intermediates(docs.sparkSession):
        with intermediates(docs.sparkSession):
            first = materialise(slim.mapInArrow(cut, _SCHEMA), "blocks")
            second = materialise(_asked(first, _are_shared, 5).mapInArrow(prove, _SCHEMA), "segments", outer=True)
        third = materialise(_asked(second, _are_later, 12).mapInArrow(narrow, _SCHEMA), "windows", outer=True)
        early = materialise(second.where(done).unionByName(third.where(done)), "results", outer=True)
    out = early.unionByName(_asked(third, _are_later, 12).mapInArrow(remove, _SCHEMA))
    return out.select(F.col("keys")[0].alias(key), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))
