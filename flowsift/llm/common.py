"""What several operators share: reading, text blocks, byte-pair encoding per distinct unit, row gathers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Text bytes that a task holds at once; longer single texts form a block of their own.
BLOCK_BYTES = 8 << 20
#: Rows that Spark sends to a Python worker at once.
ARROW_ROWS = 2000

#: A space is a safe place to cut a text for byte-level BPE when neither neighbour is white space. Texts with
#: other spaces are encoded in one go. Fixed value: the white space of Unicode.
_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = rf" [{_WHITE}]|[{_WHITE}] |^ | $"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that no column has, whatever its case."""
    lower = {t.lower() for t in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings without nulls: a missing text counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def list_parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list array and the offsets of its rows in them."""
    at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.values.slice(at[0], at[-1] - at[0]), at - at[0]


def expand(texts: pa.Array, first: Callable[[str], Sequence[int]], later: Callable[[str], Sequence[int]] | None,
           whole: Callable[[str], Sequence[int]], unsafe: str = _UNSAFE,
           together: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per text the concatenated codes of its units, as (flat codes, offsets).

    A text is cut at its spaces. Each distinct unit of the block is coded once: ``later`` codes a unit
    that follows a space, ``first`` the unit that begins a text. Texts that match ``unsafe`` go to
    ``whole`` uncut. ``together``, in place of ``later``, codes all units that follow a space at once, as (flat codes,
    codes per unit).
    """
    n = len(texts)
    odd = pc.match_substring_regex(texts, unsafe).to_numpy(zero_copy_only=False)
    values, starts = list_parts(pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " "))
    coded = pc.dictionary_encode(values)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    # Entries of the code table: a distinct later unit each, then a first unit (or the whole text) per row.
    head = pc.take(values, pa.array(starts[:-1])).to_pylist() if n else []
    rare = {i: t for i, t in zip(np.flatnonzero(odd).tolist(), texts.filter(pa.array(odd)).to_pylist())}
    used = np.ones(len(code), bool)
    used[starts[:-1]] = False
    seen = np.zeros(len(words), bool)
    seen[code[used]] = True
    nothing: tuple[int, ...] = ()
    table = [later(w) if s else nothing for w, s in zip(words, seen.tolist())] if together is None else []
    table += [whole(rare[i]) if i in rare else first(h) for i, h in enumerate(head)]
    code[starts[:-1]] = len(words) + np.arange(n)
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    flat = np.fromiter(chain.from_iterable(table), np.int64, int(sizes.sum()))
    if together is not None:
        many, counts = together([w for w, s in zip(words, seen.tolist()) if s])
        own = np.zeros(len(words), np.int64)
        own[seen] = counts
        flat, sizes = np.concatenate([many, flat]), np.concatenate([own, sizes])
    at = offsets_of(sizes)
    lengths = sizes[code]
    out = flat[ranges(at[code], lengths)].astype(np.uint32)
    return out, offsets_of(lengths)[starts]


class Memo(dict):
    """A function's results for the arguments seen, ``limit`` of them at most; the rest is computed anew."""

    def __init__(self, function: Callable, limit: int = 1 << 18):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        value = self.function(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (codes, offsets per text, the distinct words by code)."""
    values, starts = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    coded = pc.dictionary_encode(values)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    if "" in words:  # what stands before leading and behind trailing white space
        full = code != words.index("")
        starts = offsets_of(full)[starts]
        code = code[full]
    return code, starts, words


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def grouped(batches: Iterable[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.Table]:
    """Rows with equal ``columns`` as one table each; equal rows must lie next to each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        cuts = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if held and ids[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = ids[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


#: Bits of a membership filter: 4 MB at any input size. A fuller filter lets more rows pass, it never loses one.
FILTER_BITS = 1 << 25


def membership(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of hashed long ids, for thinning out a big table before a join by these ids."""
    slot = F.pmod(F.col(column), F.lit(bits))
    words = (ids.groupBy(F.shiftright(slot, 5).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(pmod({0}, 32) as int)))".format(f"`{column}`")).alias("mask")))
    packed = words.groupBy(F.shiftright("word", 12).alias("page")).agg(F.collect_list(F.struct("word", "mask")).alias("words"))
    out = np.zeros(bits >> 5, np.uint32)
    for row in packed.toLocalIterator():
        for word, mask in row["words"]:
            out[word] = mask
    return out


def may_hold(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = np.mod(ids.astype(np.int64), len(bitmap) << 5)
    return (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def without(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose long ``key`` is not in ``removed``; rows without a key stay.

    A filter of fixed size settles most rows where they are; only the others, which are removed but for a few, are
    shuffled for the join.
    """
    bitmap = df.sparkSession.sparkContext.broadcast(membership(removed, key))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(ids.notna().to_numpy() & may_hold(bitmap.value, ids.fillna(0).to_numpy(np.int64)))

    flag = free_name(df.columns, "maybe")
    flagged = df.withColumn(flag, maybe(F.col(key)))
    stay = flagged.where(~F.col(flag))
    return stay.union(flagged.where(flag).join(removed.select(key), key, "left_anti").select(*flagged.columns)).drop(flag)


def numbered(df: DataFrame, order: Sequence[str], within: str | None = None, out: str = "place", stem: str = "numbered") -> DataFrame:
    """``df``, written in the order of ``order`` (nulls first), with each row's 0-based place, counted anew per value of ``within``.

    ``within``, if given, is the first column of ``order``. Rows are sorted by range, so a value in a third of them
    spreads over many tasks. Each task numbers its own run of rows; what stands before a task's first rows follows
    from one summary row per task, which is all that reaches the driver.
    """
    part, nth, group = (free_name(df.columns, n) for n in ("part_", "nth_", "group_"))
    value = F.col(within).cast("string") if within else F.lit(None).cast("string")
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = pc.dictionary_encode(batch.column(group), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            if (batch.column(group)[0].as_py(),) == last:
                at[:starts[1] if len(starts) > 1 else n] += held
            last, held = (batch.column(group)[n - 1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([here] * n, pa.int32()), batch.column(group), pa.array(at, pa.int64())],
                                             [*batch.schema.names[:-1], part, group, nth])

    rows = materialise(df.withColumn(group, value).repartitionByRange(*order).sortWithinPartitions(*order)
                       .mapInArrow(count, ", ".join([*names, f"`{part}` int", f"`{group}` string", f"`{nth}` long"])), stem)
    tasks = rows.groupBy(part).agg(F.min(F.struct(group)).alias("first"), F.max(F.struct(group, nth)).alias("last")).orderBy(part).collect()
    before, carried = [], None
    for t in tasks:
        first, last = t["first"][group], t["last"][group]
        carry = carried[1] if carried and carried[0] == first else 0
        before.append((t[part], first, carry))
        carried = (last, t["last"][nth] + 1 + (carry if last == first else 0))
    table = df.sparkSession.createDataFrame(before, f"`{part}` int, first_ string, before_ long")
    table = table.select(part, *(F.col(c).alias(free_name(rows.columns, c)) for c in ("first_", "before_")))
    first, ahead = table.columns[1:]
    return (rows.join(F.broadcast(table), part)  # one row per task
            .withColumn(out, F.col(nth) + F.when(F.col(group).eqNullSafe(F.col(first)), F.col(ahead)).otherwise(0))
            .select(*df.columns, out))
