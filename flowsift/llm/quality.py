"""Quality rules with line labels from a linear-chain conditional random field.

Every line of a text is content or boilerplate. The field scores a line by its form (case, symbols, digits,
repeats, length) and a pair of neighbouring lines by their labels; Viterbi decoding finds the best labelling
of the whole text, and the share of words in content lines decides whether the text is kept. Plain rules come
first: too few words or too many repeated ones fail whatever the field says.

The field is fitted by maximum likelihood on at most ``SAMPLE`` labelled documents, chosen by a hash of their id, with
at most ``SAMPLE_LINES`` lines, half of them for each label: documents are taken in the order of the hash until these
are used up, the last one with its leading lines. All lines of a good document count as content, all lines of a bad
one as boilerplate. Documents are judged whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import common

#: Labelled documents that the fit uses at most.
SAMPLE = 2000
#: Lines that the fit uses at most, so that the driver's memory is bounded whatever the documents' length.
SAMPLE_LINES = 1 << 18
#: Lines that the fit takes as one sequence; a longer document is several, so that its rounds are bounded in time.
STRETCH = 1024
#: Share of a text's words that must lie in content lines.
SHARE = 0.5
FEATURES = 15
_SPACE = " \t\n\v\f\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MARKS = re.compile(r"[!?#*$%&|<>]{2,}")
_DIGITS = re.compile(r"[0-9]")


@dataclass
class Field:
    """Log-odds weights of content per feature, and scores of label pairs (from, to)."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely labels (1 content) of a sequence with these log-odds."""
        (s00, s01), (s10, s11) = self.pairs.tolist()
        a = b = 0.0
        back = []
        for i, x in enumerate(odds.tolist()):
            if i:
                to0, to1 = (a + s00 >= b + s10), (a + s01 > b + s11)  # ties stay with the same label
                back.append((0 if to0 else 1, 0 if to1 else 1))
                a, b = (a + s00 if to0 else b + s10), (a + s01 if to1 else b + s11)
            b += x
        label = 1 if b >= a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1], np.int8)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(features per line, words per line, lines with a word that equal an earlier one)."""
    lines = text.split("\n")
    out = np.zeros((len(lines), FEATURES))
    words, seen, repeats = np.zeros(len(lines), np.int64), set(), 0
    for i, line in enumerate(lines):
        bare = line.strip(_SPACE)
        if not bare:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        parts = _WORD.findall(bare)  # other white space than that of ``_SPACE`` is part of words
        n, size = len(parts), len(bare)
        words[i] = n
        upper = sum(map(str.isupper, parts))
        symbols = len(_SYMBOLS.findall(bare))
        out[i] = (1.0, np.log1p(n) / 5, n <= 3, upper / n, min(1.0, 8 * symbols / size), len(_DIGITS.findall(bare)) / size,
                  min(1.0, bare.count("!") / n), bare[-1] in ".?!", min(1.0, bare.count("|") / n), again, min(2.0, size / n / 10),
                  1 - len(set(parts)) / n, i == 0, i == len(lines) - 1, min(1.0, len(_MARKS.findall(bare)) / n))
    return out, words, repeats


def _fit(features: list[np.ndarray], good: list[int], rounds: int = 120, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; expectations by forward-backward over stretches of like length at once."""
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, f in enumerate(features):
        for a in range(0, len(f), STRETCH):
            part = f[a:a + STRETCH]
            groups.setdefault(1 << (len(part) - 1).bit_length(), []).append((i, part))
    packs = []
    for length, members in groups.items():
        x = np.zeros((len(members), length, FEATURES))
        there = np.zeros((len(members), length), bool)
        for r, (_, part) in enumerate(members):
            x[r, : len(part)], there[r, : len(part)] = part, True
        packs.append((x, there, np.array([good[i] for i, _ in members])))
    total = sum(int(t.sum()) for _, t, _ in packs)
    # Rare bad documents weigh as much as the good ones together would.
    weight = {c: 0.5 * len(good) / max(1, sum(g == c for g in good)) for c in (0, 1)}
    theta = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = -penalty * total * theta
        pairs = theta[FEATURES:].reshape(2, 2)
        for x, there, label in packs:
            rows, length = there.shape
            w = np.where(label == 1, weight[1], weight[0])
            node = np.stack([np.zeros((rows, length)), x @ theta[:FEATURES]], 2)
            ahead = np.zeros((rows, length, 2))
            behind = np.zeros((rows, length, 2))
            ahead[:, 0] = node[:, 0]
            for t in range(1, length):
                m = ahead[:, t - 1, :, None] + pairs
                ahead[:, t] = np.where(there[:, t, None], np.logaddexp(m[:, 0], m[:, 1]) + node[:, t], ahead[:, t - 1])
            for t in range(length - 2, -1, -1):
                m = pairs + (node[:, t + 1] + behind[:, t + 1])[:, None, :]
                behind[:, t] = np.where(there[:, t + 1, None], np.logaddexp(m[:, :, 0], m[:, :, 1]), behind[:, t + 1])
            z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            p = np.exp(ahead + behind - z[:, None, None])[:, :, 1]
            error = (label[:, None] - p) * there * w[:, None]
            grad[:FEATURES] += np.einsum("rt,rtf->f", error, x)
            both = there[:, 1:] & there[:, :-1]
            for a in (0, 1):
                for b in (0, 1):
                    q = np.exp(ahead[:, :-1, a] + pairs[a, b] + node[:, 1:, b] + behind[:, 1:, b] - z[:, None])
                    seen = ((label == a) & (label == b))[:, None]
                    grad[FEATURES + 2 * a + b] += ((seen - q) * both * w[:, None]).sum()
        grad /= max(1, total)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
        sample: int = SAMPLE, lines_most: int = SAMPLE_LINES) -> Field | None:
    """The field from labelled documents; None (all lines are content) where one of the two labels is missing.

    Labels that are null, contradict each other for a key or name no document are left out.
    """
    chosen = (labels.select(F.col(key).alias("key"), F.col(quality).cast("int").alias("good")).where("good in (0, 1) and key is not null")
              .groupBy("key").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most")
              .orderBy(F.xxhash64("key"), "key").limit(sample).select("key", "good"))

    half = lines_most // 2
    cell = 4 * FEATURES  # bytes of a line

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            out = [line_features(t)[0][:half].astype("<f4").tobytes() for t in common.texts_of(block.column("text")).to_pylist()]
            yield pa.record_batch([block.column("key"), block.column("good"), pa.array(map(len, out), pa.int64()), pa.array(out, pa.binary())],
                                  ["key", "good", "size", "x"])

    kind = docs.schema[key].dataType.simpleString()
    # ``sample`` rows of two numbers: small enough to broadcast whatever the corpus. One text per key.
    found = materialise(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
                        .mapInArrow(lines, f"key {kind}, good int, size long, x binary").dropDuplicates(["key"]), "features")
    left, taken = {0: half, 1: half}, []
    for r in found.select("key", "good", "size").orderBy(F.xxhash64("key"), "key").collect():  # ``sample`` rows at most
        if n := min(r["size"] // cell, left[r["good"]]):
            left[r["good"]] -= n
            taken.append((r["key"], n * cell))
    take = docs.sparkSession.createDataFrame(taken, f"key {kind}, part int")
    rows = found.join(F.broadcast(take), "key").select("key", "good", F.expr("substring(x, 1, part)").alias("x")).orderBy("key").collect()
    if {r.good for r in rows} != {0, 1}:
        return None
    return _fit([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(float) for r in rows], [r.good for r in rows])


def repeated_words(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text the words that lie in a window of three which occurs twice or more in the text."""
    n = len(code)
    if n < 3:
        return np.zeros(len(at) - 1, np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:-2] == owner[2:]
    # A number per distinct (text, first, second, third), put together exactly from two ranks.
    base = int(code.max()) + 1
    _, pair = np.unique(code[:-2] * base + code[1:-1], return_inverse=True)
    _, triple = np.unique(pair * base + code[2:], return_inverse=True)
    _, which, times = np.unique((owner[:-2] * (int(triple.max()) + 1) + triple)[inside], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(inside)[times[which] > 1]
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[starts + i] = True
    return np.bincount(owner[hit], minlength=len(at) - 1)


COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
           "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "content_share": pa.float64(),
           "line_labels": pa.string()}


def assess(texts: pa.Array, field: Field | None, share: float = SHARE) -> list[pa.Array]:
    """The columns ``COLUMNS`` for a block of texts without nulls."""
    code, at, words = common.words_of(texts)
    n = np.diff(at)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.add.reduceat(np.append(sizes[code], 0), at[:-1]) * (n > 0) if len(n) else n
    symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").cast(pa.int64())
    repeats = repeated_words(code, at)
    failed = (n < 50) | (100 * repeats > 50 * n)
    dup, content, labels = [], [], []
    for text in texts.to_pylist():
        x, per_line, again = line_features(text)
        dup.append(again)
        marks = field.decode(x @ field.weights) if field is not None else np.ones(len(x), np.int8)
        content.append(float(per_line[marks == 1].sum() / max(1, per_line.sum())))
        labels.append("".join("CB"[1 - m] for m in marks.tolist()))
    content = np.array(content, float)
    return [pa.array(n), pa.array(chars, pa.int64()), symbols, pa.array(dup, pa.int64()), pa.array(repeats, pa.int64()), pa.array(failed, pa.bool_()),
            pa.array(~failed & (content >= share), pa.bool_()), pa.array(content, pa.float64()), pa.array(labels, pa.string())]


def judge(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(key, rule figures, base_failed, kept, content_share, line_labels) per row.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines end at a line feed. A missing text counts as empty: no words, and
    base_failed. ``line_labels`` has C (content) or B (boilerplate) per line. Repeated rows and missing keys give
    rows like any other; other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            yield pa.record_batch([block.column("key"), *assess(common.texts_of(block.column("text")), field, share)], ["key", *COLUMNS])

    types = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}
    schema = ", ".join(f"{c} {types[t]}" for c, t in COLUMNS.items())
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(judged, f"key {kind}, {schema}")
    return out.withColumnRenamed("key", key)


def keep(docs: DataFrame, field: Field | None, text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns as they are."""
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for block in common.blocks([named], str(at)):
                mask = assess(common.texts_of(block.column(at)), field, share)[list(COLUMNS).index("kept")]
                yield block.filter(mask).rename_columns(batch.schema.names)

    return docs.mapInArrow(kept, docs.schema)
