"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the lengths of the corpus's frequent pre-tokens; tier two is a cache in
each worker that encodes a pre-token when it first meets it. Pre-tokens are never shuffled: the frequent
ones come from summaries of at most ``TABLE_WORDS`` entries per task. The table changes speed only, never a
count.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import common

#: Entries of the broadcast table and bytes of its longest word: some 2 MB at most, whatever the corpus.
TABLE_WORDS, WORD_BYTES = 1 << 15, 32
#: Parts by hash of the words that are as frequent as the last in the table.
_PARTS = 4096
#: A space next to another space (or the sign that stands for one) is no cut; neither is one at either end.
_UNSAFE = " [ ▁]|▁ |^ | $"


def _counter(path: str) -> tuple[Callable[[str], int], Callable[[str], int], str | None]:
    """(tokens of a whole text or first unit, tokens of a unit behind a space, unsafe texts) of a tokenizer file.

    ``unsafe`` is None where a text may not be cut at all.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # Units may be counted apart only if no piece holds a space behind another sign.
        inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.vocab_size()))
        count = lambda text: len(model.encode(text))
        return count, count, None if inner else _UNSAFE
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids), None, None


def frequent(docs: DataFrame, text: str, entries: int = TABLE_WORDS) -> list[str]:
    """At most ``entries`` of the most frequent units of all texts, as far as each task's own leading ``entries`` tell."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for block in common.blocks(batches, "text"):
            values, _ = common.list_parts(pa.compute.split_pattern(common.texts_of(block.column("text")), " "))
            coded = pa.compute.dictionary_encode(values)
            counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            top = np.argsort(-counts, kind="stable")[:entries]
            for word, n in zip(coded.dictionary.take(pa.array(top)).to_pylist(), counts[top].tolist()):
                if len(word.encode()) <= WORD_BYTES:
                    seen[word] += n
            if len(seen) > 8 * entries:
                seen = Counter(dict(seen.most_common(2 * entries)))
        top = seen.most_common(entries)
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                              ["word", "n"])

    counted = materialise(docs.select(F.col(text).alias("text")).mapInArrow(summary, "word string, n long")
                          .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    # The cut follows from a histogram of the counts in steps of a sixteenth of a power of two, within the step it falls into from
    # hashes; only words beyond it come to the driver.
    step = F.floor(F.log2("n") * 16)
    part = F.pmod(F.xxhash64("word"), F.lit(_PARTS))
    room, cut, parts = entries, None, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        cut = r["step"]
        if r["words"] > room:
            parts = 0
            for p in counted.where(step == cut).groupBy(part.alias("part")).agg(F.count("*").alias("words")).orderBy("part").collect():
                if p["words"] > room:
                    break
                room, parts = room - p["words"], p["part"] + 1
            break
        room, parts = room - r["words"], _PARTS
    if cut is None:
        return []
    return [r.word for r in counted.where((step > cut) | ((step == cut) & (part < parts))).orderBy(F.desc("n"), "word").collect()]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row, by the tokenizer file at ``path``.

    Counts are the library's, without added begin, end or special tokens, truncation or padding. A missing
    text counts as empty: 0 bytes, 0 tokens. A missing key stays missing; repeated rows each give a row;
    other columns are ignored. An empty table gives an empty table.
    """
    session, file = docs.sparkSession, path
    lengths = None
    if path.endswith(".model"):
        words = frequent(docs, text)
        first, later, unsafe = _counter(path)
        if unsafe:
            # Compact: one string of words and a byte per length.
            sizes = [min(later(w), 255) for w in words]
            lengths = session.sparkContext.broadcast(("\x00".join(w for w, n in zip(words, sizes) if n < 255 and "\x00" not in w),
                                                      bytes(n for w, n in zip(words, sizes) if n < 255 and "\x00" not in w)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, unit, unsafe = _counter(file)
        if lengths is not None:
            joined, sizes = lengths.value
            table = dict(zip(joined.split("\x00"), sizes)) if sizes else {}
            misses = common.Memo(unit)

            def look(word: str) -> tuple[int]:
                n = table.get(word)
                return (misses[word] if n is None else n,)
        for block in common.blocks(batches, "text"):
            texts = common.texts_of(block.column("text"))
            if lengths is not None:
                flat, at = common.expand(texts, lambda t: (whole(t),), look, lambda t: (whole(t),), unsafe)
                tokens = np.add.reduceat(np.append(flat, 0).astype(np.int64), at[:-1]) if len(texts) else at[:-1]
            else:
                memo = common.Memo(whole, 1024)
                tokens = np.fromiter((memo[t] for t in texts.to_pylist()), np.int64, len(texts))
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.record_batch([block.column("key"), size, pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                                  ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        counted, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
