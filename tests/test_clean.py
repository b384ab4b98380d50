import random
import statistics

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import clean, encode
from flowsift.operators.common_schema import COMMON, SOURCES, to_common

NAN, INF = float("nan"), float("inf")


def test_near_duplicates_round_half_even_and_keep_the_first(spark):
    values = [0.00015, 0.00025, 0.0002, 1.0, None, NAN, None, -0.0, 0.0]
    df = spark.createDataFrame([(i, v, "x", i % 2) for i, v in enumerate(values)], "ord long, v double, t string, label int")
    kept = sorted(r.ord for r in clean.dedup_near(df.repartition(4), ["v", "t"], "ord").collect())
    expected = pd.DataFrame({"v": [v if v is not None else NAN for v in values], "t": "x"}).round(4).duplicated()
    assert kept == [i for i, dup in enumerate(expected) if not dup]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_exact_duplicates_keep_the_least_ordinal(spark, partitions):
    df = spark.createDataFrame([(i, None if i % 3 else "x", i % 2) for i in range(60)], "ord long, a string, b int").repartition(partitions)
    assert sorted(r.ord for r in clean.dedup_exact(df, "ord").collect()) == [0, 1, 2, 3]
    assert clean.dedup_exact(df.drop("ord")).count() == 4


def test_medians_equal_the_plain_definition(spark):
    rng = random.Random(5)
    cols = {"heavy": [0.0 if rng.random() < 0.7 else rng.random() for _ in range(2001)],
            "wide": [rng.gauss(0, 1e6) for _ in range(2001)],
            "gaps": [rng.choice([None, NAN, INF, -INF, 1.5, rng.random()]) for _ in range(2001)],
            "even": [float(i) if i < 1000 else None for i in range(2001)], "none": [None] * 2001}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = clean.medians_as_dict(clean.fit_medians(df))
    # Smaller steps give the same.
    assert got == clean.medians_as_dict(clean.fit_medians(df, bits=8))
    assert got == clean.medians_as_dict(clean.fit_medians(df, bits=4))
    for name, values in cols.items():
        finite = [v for v in values if v is not None and v == v and abs(v) != INF]
        assert got[name] == pytest.approx(statistics.median(finite) if finite else 0.0, rel=1e-12), name


def test_medians_of_extreme_values(spark):
    tiny, huge = 5e-324, 1.7e308
    cols = {"signs": [-0.0, 0.0, -tiny, tiny, -huge, huge], "near": [1.0, 1.0 + 2 ** -52, 1.0 - 2 ** -53, None, None, None],
            "below": [-huge, -1.0, -1.0 - 2 ** -52, None, None, None], "one": [None] * 5 + [-3.5], "same": [7.0] * 6}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(3)
    want = {c: statistics.median(x for x in v if x is not None) for c, v in cols.items()}
    assert clean.medians_as_dict(clean.fit_medians(df)) == want
    assert clean.medians_as_dict(clean.fit_medians(df.where("same is null"))) == dict.fromkeys(cols, 0.0)


def test_ordered_bits_keep_order_and_value():
    values = [-INF, -1e300, -1.0, -5e-324, 0.0, 5e-324, 0.5, 1.0, 1e300, INF]
    keys = clean._ordered_bits(np.array(values)).tolist()
    assert keys == sorted(keys) and [clean._from_ordered_bits(k) for k in keys] == values


def test_duplicates_with_gaps_signs_and_wide_rows(spark):
    rows = [(0, None, "a", 1.0), (1, "a", None, 1.0), (2, None, "a", 1.0), (3, "", "a", 1.0), (4, None, "a", -0.0), (5, None, "a", 0.0), (6, None, "a", NAN),
            (7, None, "a", NAN), (8, None, None, None), (9, None, None, None), (10, "a", "", 1.0), (11, None, "a", 1.00004)]
    df = spark.createDataFrame(rows, "ord long, x string, y string, z double").repartition(4)
    assert sorted(r.ord for r in clean.dedup_exact(df, "ord").collect()) == [0, 1, 3, 4, 6, 8, 10, 11]
    # Rounded, NaN is missing.
    assert sorted(r.ord for r in clean.dedup_near(df, ["x", "y", "z"], "ord").collect()) == [0, 1, 3, 4, 6, 8, 10]
    assert sorted(r.ord for r in clean.dedup_near(df, ["z"], "ord").collect()) == [0, 4, 6]


def test_only_digests_are_grouped(spark):
    wide = spark.range(10).select("id", *[F.col("id").cast("double").alias(f"column_{i}") for i in range(70)])
    plan = clean.dedup_near(wide, wide.columns[1:], "id")._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "HashAggregate" in line]
    assert grouped and all("column_7" not in line.split("functions")[0] for line in grouped)


def test_labels(spark):
    text = spark.createDataFrame([(" BENIGN ",), ("BENIGN",), ("DoS",), (None,)], "Label string")
    assert [r.label for r in clean.label_from_text(text).collect()] == [0, 0, 1, 1]
    assert clean.label_from_text(text).columns == ["label"]
    assert [r.label for r in clean.label_from_number(spark.createDataFrame([(1,), (0,)], "Label long")).collect()] == [1, 0]
    with pytest.raises(ValueError, match="label"):
        clean.label_from_text(spark.range(1))


def test_numbers_from_text(spark):
    words = ["1", " 2.5 ", "1e3", "x", None, "1d", "2F", "", "-7", "NaN"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in clean.coerce_numeric(df, ["w"]).collect()] == [1.0, 2.5, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, -7.0, 0.0]


def test_infinities_and_imputation(spark):
    df = spark.createDataFrame([(INF, 1, "a"), (NAN, None, None), (2.0, 4, "c")], "x double, n long, t string")
    assert [r.x for r in clean.inf_to_null(df).collect()] == [None, None, 2.0]
    filled = clean.impute(df, {"x": 9.0, "n": 2.5}).collect()
    assert [(r.x, r.n, r.t) for r in filled] == [(9.0, 1.0, "a"), (9.0, 2.5, None), (2.0, 4.0, "c")]
    assert [(r.x, r.n) for r in clean.impute(df, {"x": 9.0}, fill="zero").collect()] == [(0.0, 1), (0.0, 0), (2.0, 4)]


def test_missing_profile(spark):
    df = spark.createDataFrame([(INF, "a"), (NAN, None), (None, "c")], "x double, t string")
    assert {r.column_name: (r.missing, r.infinite) for r in clean.profile_missing(df).collect()} == {
        "x": (2, 1), "t": (1, 0), "(total)": (3, 1)}


def test_shape_and_union(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert tuple(clean.conform_features(df, ["c", "zz", "a"]).first()) == (3, 0, 1)
    other = spark.createDataFrame([(5, 6)], "a int, d int")
    assert clean.column_differences([df, other]) == [{"b", "c", "d"}]
    assert clean.union_flows([df, other], allow_missing=True).count() == 2
    assert clean.drop_known(df, ["b", "nope"]).columns == ["a", "c"]


def test_dictionary_and_unseen_values(spark):
    df = spark.createDataFrame([("udp",), ("tcp",), (None,), ("tcp",)], "proto string")
    known = encode.fit_encoder(df, ["proto"])
    assert {r.value: r.code for r in known.collect()} == {"nan": 0, "tcp": 1, "udp": 2}
    new = spark.createDataFrame([("udp",), ("icmp",), (None,)], "proto string")
    for hint in (None, "merge"):
        assert [r.proto for r in encode.encode(new, known, ["proto"], hint=hint).orderBy(F.col("proto")).collect()] == [0, 0, 2]
    assert sorted(r.proto for r in encode.encode(new, known, ["proto"], unseen=-1).collect()) == [-1, 0, 2]


def test_large_dictionaries_are_numbered_range_by_range(spark):
    df = spark.range(200_000).select(F.hex(F.xxhash64("id")).alias("long"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 7)).alias("short"),
                                     F.lit(None).cast("string").alias("none"))
    known = encode.fit_encoder(df, ["long", "short", "none"], ranges=9).collect()
    for name in df.columns:
        found = sorted((r.code, r.value) for r in known if r.column_name == name)
        assert [v for _, v in found] == sorted({"nan" if r[0] is None else r[0] for r in df.select(name).distinct().collect()})
        assert [c for c, _ in found] == list(range(len(found)))


def test_common_schema_of_both_profiles(spark):
    assert (len(COMMON), len(SOURCES["u"]), len(SOURCES["c"])) == (64, 38, 37)
    u = to_common(spark.createDataFrame([(16.0, 8.0, 3, 5)], "sload double, dload double, sinpkt int, dinpkt int"), "u").first()
    assert (u.byte_rate, u.flow_iat_mean, u.src_load, u.dst_port) == (3.0, 4.0, 16.0, 0)
    c = to_common(spark.range(1).select(F.lit(80).alias("Destination Port"), F.lit(2.5).alias("Flow Bytes/s")), "c").first()
    assert (c.dst_port, c.byte_rate, c.src_ttl) == (80, 2.5, 0)


def test_attack_sample(spark):
    df = spark.createDataFrame([(1, " DoS ", None), (2, "DoS", 5.0), (3, "BENIGN", 1.0)], "ord long, Label string, x double")
    assert [tuple(r) for r in clean.sample_attack(df, "DoS", ["x"], "ord").collect()] == [(1, 0.0)]
