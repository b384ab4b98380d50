"""Labels, cleaning, duplicate removal and imputation of flow tables."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.scalars import (INF, count_where, finite, float_columns, number_or_zero,
                                        numeric_columns, q, round_even)

# Workers get this module's functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns removed before training, profile U.
DROPS_U = ["id", "srcip", "dstip", "sport", "dsport", "Stime", "Ltime", "attack_cat", "label", "stcpb", "dtcpb"]

# Columns removed before training, profile C.
DROPS_C = ["Flow ID", "Source IP", "Destination IP", "Timestamp", "Label", "label", "Fwd Header Length.1",
           "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
           "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate"]

# Spellings of the label column, in the order they are tried.
TEXT_LABELS = ["Label", " Label", "label"]
NUMBER_LABELS = ["label", "Label"]


def _first_present(df: DataFrame, names: list[str]) -> str:
    # Column names are compared with their case; Spark's own lookup would not.
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no label column: expected one of {names}, found {df.columns}")


def label_from_text(df: DataFrame, out: str = "label", column: str | None = None) -> DataFrame:
    """1 unless the trimmed text equals BENIGN; missing text counts as an attack."""
    name = column or _first_present(df, TEXT_LABELS)
    benign = F.coalesce(F.trim(q(name)) == "BENIGN", F.lit(False))
    flag = F.when(benign, 0).otherwise(1)
    kept = [q(c) for c in df.columns if c not in (name, out)]
    return df.select(*kept, flag.alias(out))


def label_from_number(df: DataFrame, out: str = "label") -> DataFrame:
    name = _first_present(df, NUMBER_LABELS)
    kept = [q(c) for c in df.columns if c not in (name, out)]
    return df.select(*kept, q(name).cast("int").alias(out))


def drop_known(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist, by exact name."""
    drop = set(names)
    return df.select(*[q(c) for c in df.columns if c not in drop])


def inf_to_null(df: DataFrame) -> DataFrame:
    """NaN and both infinities become NULL in every floating-point column."""
    floats = set(float_columns(df))
    return df.select(*[finite(q(c)).alias(c) if c in floats else q(c) for c in df.columns])


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Read the listed columns as numbers, 0 where that fails."""
    wanted = set(cols)
    return df.select(*[number_or_zero(q(c)).alias(c) if c in wanted else q(c) for c in df.columns])


def union_flows(dfs: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union by column name; with ``allow_missing`` absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def column_differences(dfs: list[DataFrame]) -> list[set[str]]:
    """Names by which each table after the first differs from the first."""
    first = set(dfs[0].columns)
    return [first ^ set(df.columns) for df in dfs[1:]]


def row_digest(cells: Mapping[str, Column]) -> Column:
    """128 bits that name a row by its cells; rows are taken as equal where these are.

    Spark's hash passes over missing cells, so which ones are missing is hashed beside them. Minus zero counts as zero and
    NaN as equal to NaN, as in grouping. Two hashes begin with different constants; that any two of n different
    rows meet has a chance of n^2 / 2^129.
    """
    gaps = [F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in cells.values()])]
    return F.struct(F.xxhash64(*gaps, *cells.values()).alias("h"), F.xxhash64(F.lit("second"), *cells.values(), *gaps).alias("g"))


def _earliest(df: DataFrame, cells: Mapping[str, Column], ordinal: str) -> DataFrame:
    """The row with the least ordinal of each group with equal cells, as it is.

    What is grouped and shuffled is 16 bytes and the ordinal, however wide the row; the map-side partial step
    leaves one row of a group of copies per task. Ordinals are unique, so the join that selects the rows has no skew.
    """
    first = df.select(row_digest(cells).alias("_d"), q(ordinal).alias("_o")).groupBy("_d").agg(F.min("_o").alias("_first")).select("_first")
    return df.join(first, q(ordinal) == F.col("_first"), "left_semi")


def dedup_exact(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row per distinct row. With an ordinal, which must be unique, the earliest copy and its ordinal are kept."""
    if ordinal is None:
        return df.distinct()
    return _earliest(df, {c: q(c) for c in df.columns if c != ordinal}, ordinal)


def _near_key(df: DataFrame, name: str, digits: int) -> Column:
    if name in float_columns(df):
        # NaN is missing, and missing equals missing.
        return round_even(F.when(F.isnan(q(name)), None).otherwise(q(name)), digits)
    return q(name)


def dedup_near(df: DataFrame, cols: Iterable[str], ordinal: str, digits: int = 4) -> DataFrame:
    """Keep the earliest row of those equal in ``cols`` after rounding to ``digits`` decimals, unrounded.

    ``ordinal`` must be unique.
    """
    return _earliest(df, {c: _near_key(df, c, digits) for c in cols}, ordinal)


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    return (df.groupBy(q(column).alias(column)).agg(F.count("*").alias(out))
            .orderBy(F.col(out).desc(), q(column).asc_nulls_last()))


def profile_missing(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Missing (NULL or NaN) and infinite values per column, and a row for the total."""
    names = list(cols or df.columns)
    floats = set(float_columns(df))
    sums = []
    for i, name in enumerate(names):
        c = q(name)
        lost = c.isNull() | F.isnan(c) if name in floats else c.isNull()
        sums.append(count_where(lost).alias(f"m{i}"))
        sums.append((count_where(F.abs(c) == INF) if name in floats else F.lit(0).cast("bigint")).alias(f"i{i}"))
    row = df.agg(*sums)
    counts = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"m{i}").alias("missing"),
                                F.col(f"i{i}").alias("infinite")) for i, n in enumerate(names)],
                     F.struct(F.lit("(total)").alias("column_name"),
                              reduce(Column.__add__, [F.col(f"m{i}") for i in range(len(names))]).alias("missing"),
                              reduce(Column.__add__, [F.col(f"i{i}") for i in range(len(names))]).alias("infinite")))
    return row.select(F.inline(counts))


#: Leading bits that one round of the median selection settles; 64 / ``BITS`` rounds give the exact value.
BITS = 16


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned 64-bit numbers in the same order: the bits, turned over where negative."""
    bits = (x + 0.0).view(np.int64)  # minus zero becomes zero
    return np.where(bits < 0, ~bits, bits ^ np.int64(-1 << 63)).view(np.uint64)


def _from_ordered_bits(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return struct.unpack("<d", bits.to_bytes(8, "little"))[0]


def _histogram(table: DataFrame, prefixes: list[list[int]], known: int, bits: int) -> DataFrame:
    """(col, prefix, bin, n): how many values of a column begin with a prefix of ``known`` bits, by the ``bits`` bits behind it.

    A task counts all columns in one pass over its rows and sends what occurs, so neither a frequent value nor a
    column gathers in one place.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {(i, p): np.zeros(1 << bits, np.int64) for i, wanted in enumerate(prefixes) for p in set(wanted)}
        for batch in batches:
            for i, wanted in enumerate(prefixes):
                if not wanted:
                    continue
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                keys = _ordered_bits(x[np.isfinite(x)])
                for p in set(wanted):
                    mine = keys[keys >> np.uint64(64 - known) == np.uint64(p)] if known else keys
                    totals[i, p] += np.bincount((mine >> np.uint64(64 - known - bits)).astype(np.int64) & ((1 << bits) - 1), minlength=1 << bits)
        for (i, p), n in totals.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(some), i, np.int32)), pa.array(np.full(len(some), p, np.int64)),
                                   pa.array(some), pa.array(n[some])], ["col", "prefix", "bin", "n"])

    return table.mapInArrow(count, "col int, prefix long, bin long, n long").groupBy("col", "prefix", "bin").agg(F.sum("n").alias("n"))


def fit_medians(df: DataFrame, cols: Iterable[str] | None = None, bits: int = BITS) -> DataFrame:
    """Exact median per column as rows (column_name, value); 0 where a column has no value.

    Spark's exact ``median`` keeps every distinct value of a column in one task's memory. Here the two middle values
    are selected by their bits: doubles keep their order as 64-bit numbers, a round counts the values of all columns
    by the next ``bits`` bits, and running sums over at most 2^bits bins tell which bin holds the rank. A
    fixed number of passes, 64 / ``bits``, gives the values exactly, whatever their distribution. The driver
    gets two rows per column and round.
    """
    if 64 % bits:
        raise ValueError("bits must divide 64")
    names = list(cols or numeric_columns(df))
    spark = df.sparkSession
    table = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    # Per column and side (lower, upper middle value): the bits known so far and the rank among the values with these bits.
    sought: dict[tuple[int, int], tuple[int, int | None]] = {(i, side): (0, None) for i in range(len(names)) for side in (0, 1)}
    for known in range(0, 64, bits):
        wanted = spark.createDataFrame([(i, side, *x) for (i, side), x in sought.items()], "col int, side int, prefix long, rank long")
        counts = _histogram(table, [[sought[i, s][0] for s in (0, 1) if (i, s) in sought] for i in range(len(names))], known, bits)
        same = Window.partitionBy("col", "prefix")
        placed = counts.withColumn("upto", F.sum("n").over(same.orderBy("bin"))).withColumn("all", F.sum("n").over(same))
        rank = F.coalesce("rank", F.floor((F.col("all") + 1 + F.col("side")) / 2))
        hits = (placed.join(F.broadcast(wanted), ["col", "prefix"]).withColumn("rank", rank)
                .where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))).collect())
        sought = {(r["col"], r["side"]): (r["prefix"] << bits | r["bin"], r["rank"] - r["upto"] + r["n"]) for r in hits}
    medians = [(name, sum(_from_ordered_bits(sought[i, s][0]) for s in (0, 1)) / 2 if (i, 0) in sought else 0.0) for i, name in enumerate(names)]
    return spark.createDataFrame(medians, "column_name string, value double")


def medians_as_dict(medians: DataFrame) -> dict[str, float]:
    """Medians on the driver: one number per column of the table they were fitted on."""
    return {r["column_name"]: float(r["value"]) for r in medians.collect()}


def impute(df: DataFrame, medians: Mapping[str, float] | None = None, fill: str = "median",
           but: Iterable[str] = ()) -> DataFrame:
    """Replace missing numbers by fitted medians (``fill='median'``) or by 0 (``fill='zero'``),
    in all numeric columns except ``but``."""
    clean = inf_to_null(df)
    values = dict(medians or {}) if fill == "median" else {}
    cells = {c: float(values.get(c, 0.0)) for c in numeric_columns(clean, but)}
    kinds = dict(clean.dtypes)
    whole = ("tinyint", "smallint", "int", "bigint")
    out = []
    for c in clean.columns:
        if c not in cells:
            out.append(q(c))
        elif kinds[c] in whole and cells[c] != int(cells[c]):
            # A fractional median widens a whole-number column that has gaps.
            out.append(F.coalesce(q(c).cast("double"), F.lit(cells[c])).alias(c))
        else:
            out.append(F.coalesce(q(c), F.lit(cells[c]).cast(kinds[c])).alias(c))
    return clean.select(*out)


def conform_features(df: DataFrame, features: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly the given feature columns in the given order, 0 for absent ones; extras go."""
    present = set(df.columns)
    return df.select(*[q(c) for c in keep],
                     *[q(f) if f in present else F.lit(0).alias(f) for f in features])


def sample_attack(df: DataFrame, name: str, features: Iterable[str], ordinal: str,
                  label: str = "Label", n: int = 1) -> DataFrame:
    """The first ``n`` rows labelled ``name``, features as doubles with missing as 0."""
    rows = df.filter(F.trim(q(label)) == name).orderBy(q(ordinal)).limit(n)
    filled = [F.coalesce(finite(q(f).cast("double")), F.lit(0.0)).alias(f) for f in features]
    return rows.select(q(ordinal), *filled)
