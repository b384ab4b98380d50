import collections
import random

import pytest
from pyspark.sql import functions as F

from flowsift.operators import connections as C

SCHEMA = "ord long, last_us long, src string, dst string, sport int, dport int, service string, state string, sttl int, dttl int"


def deque_counts(rows, size=100):
    history, out = collections.deque(maxlen=size - 1), {}
    for r in sorted(rows, key=lambda r: (r["last_us"] or 0, r["ord"])):
        out[r["ord"]] = tuple(1 + sum(all(h[c] == r[c] for c in cols) for h in history) for cols in C.COUNTERS.values())
        history.append(r)
    return out


@pytest.mark.parametrize("block,partitions", [(99, 4), (130, 1), (10_000, 16)])
def test_window_counts_equal_the_history(spark, block, partitions):
    rng = random.Random(block)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = [dict(zip(names, (i, 0 if rng.random() < 0.4 else rng.randrange(5000), "hot" if rng.random() < 0.5 else f"s{rng.randrange(9)}",
                             f"d{rng.randrange(3)}", rng.choice([1, 2, None]), rng.randrange(3), rng.choice(["http", None]), "SF", 64,
                             rng.choice([0, 252])))) for i in range(700)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(partitions)
    counted = C.conn_window_counts(df, "last_us", "ord", block=block).collect()
    assert {r["ord"]: tuple(r[c] for c in C.COUNTERS) for r in counted} == deque_counts(rows)


def test_window_counts_need_a_block_of_the_history_size(spark):
    with pytest.raises(ValueError):
        C.conn_window_counts(spark.createDataFrame([], SCHEMA), "last_us", "ord", block=50)


def test_window_counts_shuffle_once_per_numbering_and_block(spark):
    df = spark.createDataFrame([(i, i, "s", "d", 1, 2, "x", "SF", 1, 1) for i in range(300)], SCHEMA)
    plan = C.conn_window_counts(df, "last_us", "ord")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_block") == 1


def test_application_counts(spark):
    conn = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    http = spark.createDataFrame([(1, "a", "GET", 3, 10), (2, "a", "", None, 20), (3, "a", "POST", 1, None)],
                                 "ord long, uid string, method string, trans_depth int, response_body_len long")
    ftp = spark.createDataFrame([(1, "b", "RETR", None), (2, "b", None, "bob"), (3, "a", "", "")], "ord long, uid string, command string, usr string")
    got = {r.uid: tuple(r)[1:] for r in C.attach_app_counts(conn, http, ftp).collect()}
    assert got == {"a": (1, 0, 2, 0, 0), "b": (0, 0, 0, 1, 1), "c": (0, 0, 0, 0, 0)}


def test_enrichment_falls_back_field_by_field(spark):
    conn = spark.createDataFrame(
        [(1, "u1", "a", "b", 1, 2, 9.0, "TCP", None, "SF", 5, 6, 50, 60), (2, "u2", "x", "y", 1, 2, 7.0, "icmp", "dns", None, 5, None, 50, 60)],
        "ord long, uid string, orig_h string, resp_h string, orig_p int, resp_p int, duration double, proto string, service string, "
        "conn_state string, orig_pkts long, resp_pkts long, orig_ip_bytes long, resp_ip_bytes long")
    pkt = spark.createDataFrame([("a", "b", 1, 2, 6, 0.0, 3, 4, 30, 40, 77, *([1] * 13))],
                                "src string, dst string, sport int, dport int, proto int, dur double, spkts long, dpkts long, sbytes long, "
                                "dbytes long, last_us long, " + ", ".join(f"{c} int" for c in C.PACKET_FIELDS))
    got = {r.uid: r for r in C.enrich_connections(conn, pkt).collect()}
    assert (got["u1"].dur, got["u1"].spkts, got["u1"].service, got["u1"].last_us, got["u1"].sttl) == (9.0, 3, "-", 77, 1)
    assert (got["u2"].dur, got["u2"].spkts, got["u2"].dpkts, got["u2"].state, got["u2"].last_us, got["u2"].sttl) == (7.0, 5, 0, "-", 0, 0)


def test_rates_guard_zero_and_cut_to_whole_bytes(spark):
    df = spark.createDataFrame([("a", "a", 5, 5, 3, 0, 10, 4, 0.0), ("a", "b", 5, 5, 3, 2, 10, 5, 2.0)],
                               "src string, dst string, sport int, dport int, spkts long, dpkts long, sbytes long, dbytes long, dur double")
    a, b = C.derive_rates(df).collect()
    assert (a.smean, a.dmean, a.rate, a.sload, a.is_sm_ips_ports) == (3, 0, 0.0, 0.0, 1)
    assert (b.smean, b.dmean, b.rate, b.sload, b.dload, b.is_sm_ips_ports) == (3, 2, 2.5, 40.0, 20.0, 0)


def test_finalise_reports_missing_features(spark):
    with pytest.raises(ValueError, match="service"):
        C.finalise_u(spark.range(1).select(F.lit(1.0).alias("dur")))
    row = {f: F.lit(float("nan")) for f in C.FEATURES_U}
    out = C.finalise_u(spark.range(1).select(*[c.alias(n) for n, c in row.items()]))
    assert out.columns == C.FEATURES_U and len(C.FEATURES_U) == 40 and set(out.first()) == {0.0}
