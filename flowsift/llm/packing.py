"""Packing of tokenised documents into fixed windows, planned by non-negative least squares.

1. One pass encodes every document, cuts its full windows off and keeps the tail (shorter than a window).
2. The histogram of tail lengths (at most ``window`` bins) goes to the driver. Shallow combinations - two
   or three lengths that fill a window exactly - are the columns of a non-negative least squares problem
   whose solution says how often each combination is used; it is rounded down to what the histogram allows.
3. Residual tails are packed greedily: laid end to end by length and cut at the window's ends.

A tail's place follows from its rank among the tails of its length, so nothing is sorted: a task numbers its
own tails while it encodes, and one small table of counts per task gives the offsets.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import common

WINDOW = 1024
PIECES = ("key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")


def combinations(counts: np.ndarray, window: int, strides: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128, 256)) -> list[tuple[int, ...]]:
    """Length combinations of two or three parts that fill the window, over lengths that occur."""
    there = counts > 0
    found = {(a, window - a) for a in np.flatnonzero(there[: window // 2 + 1]).tolist() if a and there[window - a]}
    # Triples: the two shorter parts differ from a third of the rest by a power of two.
    for a in np.flatnonzero(there).tolist():
        rest = window - a
        for s in (0, *strides):
            b = rest // 2 - s
            if b > 0 and there[b] and there[rest - b]:
                found.add(tuple(sorted((a, b, rest - b))))
    return sorted(found)


def solve(counts: np.ndarray, window: int = WINDOW, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used: least squares under x >= 0, rounded to whole and feasible numbers.

    Multiplicative updates keep the solution non-negative: x <- x * (A'h) / (A'Ax). The matrix has one row
    per length and three entries per column at most, so a round costs as much as there are entries.
    """
    combos = combinations(counts, window)
    if not combos:
        return []
    cols = np.concatenate([np.full(len(c), i) for i, c in enumerate(combos)])
    rows = np.concatenate([np.array(c) for c in combos])
    weight = 1.0 / np.sqrt(np.maximum(counts, 1))  # relative errors: frequent lengths don't drown the rare ones
    goal = np.bincount(cols, (counts * weight * weight)[rows], len(combos))
    x = np.full(len(combos), counts.sum() / (2.0 * len(combos)) + 1e-9)
    for _ in range(rounds):
        fit = np.bincount(rows, x[cols], len(counts)) * weight * weight
        x *= goal / np.maximum(np.bincount(cols, fit[rows], len(combos)), 1e-12)
    left, plan = counts.copy(), []
    for step in (np.floor(x).astype(np.int64), None):  # the rounded solution, then what is left, whole again
        for i in np.argsort(-x, kind="stable").tolist():
            need = np.bincount(np.array(combos[i]), minlength=len(counts))
            most = int((left[need > 0] // need[need > 0]).min())
            n = min(most, int(step[i])) if step is not None else most
            if n > 0:
                left -= n * need
                plan.append((combos[i], n))
    return plan


class Layout:
    """Where the r-th tail of a length goes: slots of combinations first, then the residual stream."""

    def __init__(self, counts: np.ndarray, window: int):
        self.window = window
        plan = solve(counts, window)
        slots: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window)]  # first rank, n, first sequence, offset
        used = np.zeros(window, np.int64)
        self.sequences = 0
        for parts, n in plan:
            at = 0
            for part in parts:
                slots[part].append((int(used[part]), n, self.sequences, at))
                used[part] += n
                at += part
            self.sequences += n
        self.used = used
        self.slots = [np.array(s, np.int64).reshape(-1, 4) for s in slots]
        rest = (counts - used) * np.arange(window)
        self.stream = np.concatenate(([0], np.cumsum(rest)))[:-1]  # where the residual tails of a length begin
        self.tokens = int(rest.sum())
        self.full = self.sequences + -(-self.tokens // window)  # the first full window's sequence

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the tail, length, sequence, offset)."""
        if rank < self.used[length]:
            s = self.slots[length]
            first, _, sequence, offset = s[np.searchsorted(s[:, 0], rank, "right") - 1].tolist()
            return [(0, length, sequence + rank - first, offset)]
        at, out, done = int(self.stream[length]) + (rank - int(self.used[length])) * length, [], 0
        while done < length:
            sequence, offset = divmod(at + done, self.window)
            n = min(length - done, self.window - offset)
            out.append((done, n, self.sequences + sequence, offset))
            done += n
        return out


#: Fixed value: the pattern of byte-level pre-tokenisation.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_encoding(path: str):
    """An encoding by ranks that gives the tokenizer file's ids, or None where merges don't follow the order of ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    usual = (model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
             and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True))
    if not usual:
        return None
    vocab = model["vocab"]
    parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in parts]
    if any(x >= y for x, y in zip(made, made[1:])) or (made and made[0] < 256) or len(made) + 256 != len(vocab):
        return None
    import tiktoken

    signs = byte_signs()
    ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def units_encoder(encoding):
    """Ids of many units at once, as (flat ids, ids per unit): each unit follows a space and holds none.

    They are encoded as one text. A token that begins with a space begins a unit, as nothing else in the text has that byte.
    """
    opens = np.zeros(encoding.n_vocab, bool)
    opens[[i for i in range(encoding.n_vocab) if encoding.decode_single_token_bytes(i)[:1] == b" "]] = True

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = encoding.encode_to_numpy(" " + " ".join(units), disallowed_special=()) if units else np.empty(0, np.uint32)
        return flat, np.diff(np.flatnonzero(opens[flat]), append=len(flat))

    return encode


def encoder(path: str):
    """Ids of texts by a BPE file of the tokenizers library, as (flat ids, offsets) per block.

    Texts with special strings, and files of other kinds, go through the library itself.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(path)
    whole = lambda text: model.encode(text, add_special_tokens=False).ids
    encoding = rank_encoding(path)
    if encoding is None:
        return lambda texts: common.expand(texts, whole, whole, whole, "(?s:.*)")
    special = "|".join(re.escape(t.content) for t in model.get_added_tokens_decoder().values())
    holds = re.compile(special) if special else None
    plain = lambda text: whole(text) if holds and holds.search(text) else encoding.encode_ordinary(text)
    units = units_encoder(encoding)
    unsafe = "|".join(x for x in (common._UNSAFE, special) if x)
    return lambda texts: common.expand(texts, plain, None, plain, unsafe, units)


def pack(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Each document is its ids by the tokenizer file at ``path`` and then ``end_id``; each id lies in exactly one
    piece, sequences are gapless from offset 0 and hold ``window`` ids, but for the last residual one, which is
    padded. A missing or empty text is one ``end_id``. Rows are independent: repeated rows and missing keys
    are packed like any other; other columns are ignored; an empty table gives no pieces.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        ranks, before = np.zeros(window, np.int64), 0
        for block in common.blocks(batches, "text"):
            flat, at = encode(common.texts_of(block.column("text")))
            rows, narrow = [], "<u2" if flat.max(initial=0) < 65536 else "<u4"
            for i in range(block.num_rows):
                ids = np.append(flat[at[i]:at[i + 1]], end_id).astype("<u4")
                full, tail = divmod(len(ids), window)
                crcs = [zlib.crc32(ids[k * window:(k + 1) * window]) for k in range(full)]
                rows.append((part, before, tail, int(ranks[tail]), len(ids), crcs, ids[full * window:].astype(narrow).tobytes()))
                before += full
                ranks[tail] += 1
            cols = list(zip(*rows))
            yield pa.record_batch([block.column("key"), *(pa.array(c, pa.int64()) for c in cols[:5]),
                                   pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.binary())],
                                  ["key", "part", "before", "bin", "rank", "doc_tokens", "crcs", "tail"])

    encoded = materialise(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        cut, f"key {kind}, part long, before long, bin long, rank long, doc_tokens long, crcs array<long>, tail binary"), "encoded")

    # One row per task and length, and one per task for its full windows: ranks become global by running sums.
    tallies = materialise(encoded.groupBy("part", "bin").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("full")), "tallies")
    run = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tallies.select("part", "bin", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("ahead"))
    parts = tallies.groupBy("part").agg(F.sum("full").alias("full"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the pass above
    windows = parts.select("part", F.coalesce(F.sum("full").over(whole), F.lit(0)).alias("windows"))
    counts = np.zeros(window, np.int64)
    for r in tallies.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        counts[r["bin"]] = r["n"]
    counts[0] = 0
    layout = docs.sparkSession.sparkContext.broadcast(Layout(counts, window))  # bounded by the window alone
    offsets = ahead.join(windows, "part")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = layout.value
        for batch in batches:
            owner, rows = [], []
            for i, r in enumerate(batch.drop_columns(["key"]).to_pylist()):
                for k, crc in enumerate(r["crcs"]):
                    owner.append(i)
                    rows.append((k * window, window, crc, r["doc_tokens"], plan.full + r["windows"] + r["before"] + k, 0))
                if not r["bin"]:
                    continue
                first = len(r["crcs"]) * window
                ids = np.frombuffer(r["tail"], "<u2" if len(r["tail"]) == 2 * r["bin"] else "<u4").astype("<u4")
                for start, n, sequence, offset in plan.place(r["bin"], r["ahead"] + r["rank"]):
                    owner.append(i)
                    rows.append((first + start, n, zlib.crc32(ids[start:start + n]), r["doc_tokens"], sequence, offset))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch([batch.column("key").take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                                  ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = encoded.join(offsets, ["part", "bin"]).mapInArrow(lay, PIECES.format(kind=kind))
    return out.withColumnRenamed("key", key)
