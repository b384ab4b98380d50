import hashlib

import pytest
from pyspark.sql import functions as F

from flowsift.operators import order


def _numbers(df, n):
    return {r["id"]: r["rn"] for r in order.global_row_number(df, "t", "id", buckets=n).collect()}


@pytest.mark.parametrize("partitions", [1, 4, 16])
@pytest.mark.parametrize("buckets", [2, 7, 32])
def test_row_number_with_a_hot_value_and_gaps(spark, partitions, buckets):
    # Half of the rows share one time, some have none.
    rows = [(i, None if i % 11 == 0 else (500.0 if i % 2 else float((i * 37) % 1000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t double").repartition(partitions)
    expected = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] or 0.0, r[0])), 1)}
    assert _numbers(df, buckets) == expected


def test_hot_value_is_cut_into_level_buckets(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("t"))
    sizes = [r["count"] for r in order.in_ranges(df, ["t", "id"], 16).groupBy("_range").count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 3 * 20000 / 16


def test_whole_numbers_that_are_one_double_are_told_apart_and_cut(spark):
    # Nanoseconds: 3,000 successive numbers round to a dozen doubles.
    start = 1_700_000_000_000_000_001
    rows = [(i, start + (i * 7919) % 3000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t long").repartition(5)
    assert len({float(t) for _, t in rows}) < 20
    assert _numbers(df, 16) == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: r[1]), 1)}
    sizes = [r["count"] for r in order.in_ranges(df, ["t", "id"], 16).groupBy("_range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 3 * 3000 / 16


def test_places_per_value(spark):
    rows = [(None if i % 5 == 0 else "ab"[i % 2], (i * 37) % 400) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(6)
    got = {(r.g, r.v): r.place for r in order.place_in_order(df, ["g", "v"], within="g", ranges=11).collect()}
    for g in (None, "a", "b"):
        assert [got[g, v] for v in sorted(v for x, v in rows if x == g)] == list(range(sum(x == g for x, _ in rows)))


def test_row_number_of_small_tables(spark):
    empty = spark.createDataFrame([], "id long, t double")
    assert _numbers(empty, 4) == {}
    assert _numbers(spark.createDataFrame([(5, 1.0)], "id long, t double"), 4) == {5: 1}
    assert _numbers(spark.createDataFrame([(2, 1.0), (1, 1.0)], "id long, t double"), 4) == {1: 1, 2: 2}


def test_split_sizes_follow_the_published_counts(spark):
    counts = spark.createDataFrame([("0", 85630), ("1", 68037)], "stratum string, n bigint")
    sizes = {r["stratum"]: (r["n_train"], r["n_val"], r["n"] - r["n_train"] - r["n_val"])
             for r in order.split_sizes(counts, (0.70, 0.15, 0.15)).collect()}
    assert tuple(map(sum, zip(*sizes.values()))) == (107566, 23050, 23051)
    assert (sizes["0"][0], sizes["1"][0]) == (59940, 47626)


@pytest.mark.parametrize("label", ["label", None])
@pytest.mark.parametrize("ratios", [(0.7, 0.15, 0.15), (7.0, 1.5, 1.5)])
def test_split_is_exact_and_independent_of_layout(spark, label, ratios):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    one = {r["id"]: r["split"] for r in order.split_stratified(df.repartition(1), "id", label, ratios).collect()}
    many = {r["id"]: r["split"] for r in order.split_stratified(df.repartition(16), "id", label, ratios).collect()}
    assert one == many
    sizes = {s: sum(v == s for v in one.values()) for s in ("train", "validation", "test")}
    assert sizes == {"train": 700, "validation": 150, "test": 150}
    if label:
        assert sum(v == "train" and i % 10 == 0 for i, v in one.items()) == 70


def test_sample_takes_the_least_hashes(spark):
    got = {r["id"] for r in order.sample_n(spark.range(500).repartition(5), "id", 20, seed=7).collect()}
    assert got == set(sorted(range(500), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:20])
    assert order.sample_n(spark.range(3), "id", 20).count() == 3


def test_split_never_deals_large_classes_out(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("flow_id"), (F.col("id") % 2).alias("label"), F.lit(1.5).alias("wide"))
    monkeypatch.setattr(order, "CLASS_ROWS", 2000, raising=False)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if Spark took the bounds for large
    try:
        split = order.split_stratified(df, "flow_id")
        sizes = {tuple(r) for r in split.groupBy("label", "split").count().collect()}
        plan = split._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sizes == {(c, s, n) for c in (0, 1) for s, n in (("train", 1750), ("validation", 375), ("test", 375))}
    assert "hashpartitioning(_s#" not in plan and "wide" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert plan.count("BroadcastHashJoin") >= 2
