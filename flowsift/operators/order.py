"""Global order, exact splits and samples without a single-task sort.

``row_number() over (order by ...)`` alone sends every row to one task. Here rows are dealt out by
ranges of the sort columns in their own types, each range is numbered on its own, and a small table of
range sizes supplies the offset. Ranges stay level even if one value holds most of the table, because
the last sort column is unique (an ordinal, or the values themselves) and cuts such a value further.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.scalars import FLOATS, INF, q
from flowsift.session import materialise


def default_buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cuts(quantiles: list[float]) -> tuple[list[float], list[float]]:
    """Bucket borders from quantiles, and the values frequent enough to fill a bucket alone."""
    hot = sorted({a for a, b in zip(quantiles, quantiles[1:]) if a == b})
    borders = set(quantiles)
    for value in hot:
        borders.add(math.nextafter(value, 0.0 if math.isinf(value) else INF))
    return [-INF, *sorted(b for b in borders if not math.isinf(b)), INF], hot


def _bucketize(df: DataFrame, source: str, out: str, cuts: list[float]) -> DataFrame:
    if len(cuts) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=cuts, inputCol=source, outputCol=out, handleInvalid="keep").transform(df)


def sort_key(df: DataFrame, key: str) -> Column:
    """The key as it is ordered by: missing ones and NaN as 0, in its own type."""
    kind = next(f.dataType for f in df.schema.fields if f.name == key)
    c = q(key)
    return F.coalesce(F.nanvl(c, F.lit(0.0)) if isinstance(kind, FLOATS) else c, F.lit(0))


def in_ranges(df: DataFrame, by: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` written in the order of ``by``, with ``_range`` and ``_at``: all rows of a smaller range come first,
    and ``_at`` numbers the rows of a range without gaps.

    Spark cuts the ranges at sampled values of all columns of ``by`` together, so whole numbers need not pass for doubles
    and a value in most rows is cut by the columns behind it. The table is written because a range keeps its
    rows only if it is not sorted anew.
    """
    dealt = df.repartitionByRange(ranges, *map(q, by)) if ranges else df.repartitionByRange(*map(q, by))
    return materialise(dealt.sortWithinPartitions(*map(q, by)).withColumn("_range", F.spark_partition_id())
                       .withColumn("_at", F.monotonically_increasing_id()), "ranges")


def place_in_order(df: DataFrame, by: list[str], within: str | None = None, out: str = "place", ranges: int | None = None) -> DataFrame:
    """0-based place of each row in the order of ``by``, counted anew for each value of ``within``, the first of ``by``.

    The table of offsets has one row per range and value of ``within`` in it, at most as many as ranges and values together,
    and is broadcast: ``within`` should have few values, such as column names.
    """
    rows = in_ranges(df, by, ranges)
    cells = [*([within] if within else []), "_range"]
    sizes = rows.groupBy(*map(q, cells)).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    earlier = Window.partitionBy(*([q(within)] if within else [])).orderBy("_range")
    offsets = sizes.select(*[q(c).alias(f"_c{i}") for i, c in enumerate(cells)], (F.sum("_n").over(earlier) - F.col("_n") - F.col("_from")).alias("_off"))
    same = [q(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(cells)]
    return (rows.join(F.broadcast(offsets), same).withColumn(out, F.col("_at") + F.col("_off"))
            .select(*[q(c) for c in df.columns], out))


def global_row_number(df: DataFrame, key: str, ordinal: str, out: str = "rn", buckets: int | None = None) -> DataFrame:
    """1-based position in (key, ordinal) order over the whole table; missing keys and NaN sort as 0."""
    placed = place_in_order(df.withColumn("_key", sort_key(df, key)), ["_key", ordinal], out="_place", ranges=buckets)
    return placed.select(*[q(c) for c in df.columns], (F.col("_place") + 1).alias(out))


def seeded_hash(identifier: str, seed: int) -> Column:
    """Hex text that orders rows at random, but the same way on every run and layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), q(identifier).cast("string")))


def sample_n(df: DataFrame, identifier: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows without replacement. Each task keeps n rows; there is no full sort."""
    return (df.withColumn("_h", seeded_hash(identifier, seed))
            .orderBy("_h", q(identifier)).limit(n).drop("_h"))


def split_sizes(counts: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """Rows of each class for training and validation, from a table (stratum, n).

    The hold-out takes ceil(ratio x rows), its test part ceil(ratio x hold-out); classes share
    each part by largest remainder.
    """
    total = sum(ratios)
    train, val, test = (r / total for r in ratios) if abs(total - 1.0) > 0.01 else ratios
    holdout, fraction = val + test, test / (val + test)
    everything = Window.partitionBy()

    def share(n: str, draws: str, out: str, frame: DataFrame) -> DataFrame:
        exact = F.col(n) / F.sum(n).over(everything) * F.col(draws)
        frame = (frame.withColumn("_exact", F.when(F.sum(n).over(everything) > 0, exact).otherwise(0.0))
                 .withColumn("_floor", F.floor("_exact")))
        rest = F.col(draws) - F.sum("_floor").over(everything)
        turn = F.row_number().over(Window.orderBy((F.col("_floor") - F.col("_exact")), "stratum"))
        return (frame.withColumn(out, F.col("_floor") + F.when(turn <= rest, 1).otherwise(0))
                .drop("_exact", "_floor"))

    sized = counts.withColumn("_all", F.sum("n").over(everything))
    sized = sized.withColumn("_train", F.col("_all") - F.ceil(F.col("_all") * holdout))
    sized = share("n", "_train", "n_train", sized)
    sized = sized.withColumn("_held", F.col("n") - F.col("n_train"))
    sized = sized.withColumn("_hold", F.sum("_held").over(everything))
    sized = sized.withColumn("_val", F.col("_hold") - F.ceil(F.col("_hold") * fraction))
    sized = share("_held", "_val", "n_val", sized)
    return sized.select("stratum", "n", "n_train", "n_val")


# Rows of a class that one task may read in a split.
CLASS_ROWS = 1 << 18


def split_stratified(df: DataFrame, identifier: str, label: str | None = "label",
                     ratios: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Add ``split`` (train / validation / test) with exact sizes per class.

    Rows stand in the order of a seeded hash inside their class, and a class is cut at two places.
    One aggregate counts rows per (class, piece of the hash); only the pieces that hold a cut
    are ranked, which gives the (hash, id) pair at each cut. A map-only pass then compares every row
    with the two pairs of its class. Pieces are hash prefixes whose number follows the row
    count, so a piece stays small. Rows whose (hash, id) pairs are equal go to the same part.
    ``label=None`` splits without strata.
    """
    stratum = F.coalesce(q(label).cast("string") if label else F.lit("all"), F.lit(""))
    place = F.struct(seeded_hash(identifier, seed).alias("h"), q(identifier).alias("id"))
    slim = df.select(stratum.alias("stratum"), place.alias("place"))
    rows = slim.groupBy("stratum").agg(F.count("*").alias("n"))
    sizes = split_sizes(rows, ratios)
    # About 16,000 rows a piece, by the largest class; hex digits of the prefix follow.
    most = rows.agg(F.max("n").alias("m")).first()["m"] or 0
    digits = max(1, math.ceil(math.log(max(1, most / 16_000), 16)) if most > 16_000 else 1)
    piece = F.substring(F.col("place.h"), 1, digits)
    cells = slim.groupBy("stratum", piece.alias("piece")).agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("stratum").orderBy("piece")) - F.col("k")
    cut = F.explode(F.array(F.struct(F.lit(1).alias("cut"), F.col("n_train").alias("at")),
                            F.struct(F.lit(2).alias("cut"), (F.col("n_train") + F.col("n_val")).alias("at"))))
    cuts = (cells.select("stratum", "piece", "k", before.alias("before")).join(sizes.select("stratum", cut.alias("c")), "stratum")
            .where((F.col("c.at") > F.col("before")) & (F.col("c.at") <= F.col("before") + F.col("k")))
            .select("stratum", "piece", F.col("c.cut").alias("cut"), (F.col("c.at") - F.col("before")).alias("rank")))
    # Cuts and bounds have a row or two per class. Spark cannot tell and would deal all rows out by class, so with large classes
    # they are broadcast.
    few = F.broadcast if most > CLASS_ROWS else lambda rows: rows
    inside = slim.withColumn("piece", piece).join(few(cuts), ["stratum", "piece"])
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "piece", "cut").orderBy("place")))
    last = (ranked.where("r = rank").groupBy("stratum")
            .agg(F.max(F.when(F.col("cut") == 1, F.col("place"))).alias("train"), F.max(F.when(F.col("cut") == 2, F.col("place"))).alias("val")))
    # One row per class; a cut at 0 has no pair, so no row lies before it.
    bounds = last.select(F.col("stratum").alias("_stratum"), F.col("train").alias("_train"), F.col("val").alias("_val"))
    joined = df.withColumn("_s", stratum).withColumn("_p", place).join(few(bounds), F.col("_s") == F.col("_stratum"), "left")
    split = (F.when(F.col("_p") <= F.col("_train"), "train").when(F.col("_p") <= F.col("_val"), "validation").otherwise("test"))
    return joined.withColumn("split", split).select(*[q(c) for c in df.columns], "split")
