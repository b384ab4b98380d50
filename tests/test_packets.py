"""Packet aggregation against a plain loop over the packets."""

import random

import pytest

from flowsift.operators import packets
from flowsift.sources.schemas import PACKETS

FLAGS = ["S", "SA", "A", "PA", "FA", "R"]


def random_packets(n, seed, hosts=4, hot=0.0):
    rng = random.Random(seed)
    rows, us = [], 1_700_000_000_000_000
    for ord_ in range(n):
        us += rng.randrange(0, 5000)
        a, b = rng.randrange(hosts), rng.randrange(hosts)
        if rng.random() < hot:
            a, b = 0, 1
        tcp = rng.random() < 0.8
        ports = (1000 + a % 2, 1000 + b % 2)
        rows.append((ord_, us, f"h{a}", f"h{b}", *ports, 6 if tcp else 17, rng.choice([0, 64, 128]), rng.randrange(40, 1500),
                     tcp, rng.choice([0, 500]) if tcp else None, rng.randrange(6) if tcp else None,
                     rng.choice(FLAGS) if tcp else None, rng.choice([0, 10]) if tcp else None))
    return rows


def mean(xs):
    return sum(xs) / len(xs) / 1000 if xs else 0.0


def loop(rows, compat):
    """The tracked-state form: one pass, a dictionary keyed by the first-seen direction."""
    flows = {}
    for _, us, src, dst, sport, dport, proto, ttl, size, tcp, win, seq, flags, payload in rows:
        key, back = (src, dst, sport, dport, proto), (dst, src, dport, sport, proto)
        if back in flows:
            f, side = flows[back], "d"
        else:
            f = flows.setdefault(key, {"s": [], "d": [], "sb": 0, "db": 0, "sttl": ttl, "swin": win or 0, "dttl": 0,
                                       "dwin": 0, "sseq": set(), "dseq": set(), "sl": 0, "dl": 0, "syn": None, "sa": None, "ack": None})
            side = "s"
        f[side].append(us)
        f[side + "b"] += size
        if side == "d":
            f["dttl"] = f["dttl"] or ttl
            f["dwin"] = f["dwin"] or (win or 0)
        if tcp:
            f[side + "l"] += seq in f[side + "seq"] and payload > 0
            f[side + "seq"].add(seq)
            s, a = "S" in flags, "A" in flags
            if side == "s" and s and not a and f["syn"] is None:
                f["syn"] = us
            if side == "s" and a and not s and f["sa"] is not None and f["ack"] is None:
                f["ack"] = us
            if side == "d" and s and a and f["sa"] is None:
                f["sa"] = us
    out = {}
    for key, f in flows.items():
        gaps = {x: [b - a for a, b in zip(f[x], f[x][1:])] for x in "sd"}
        bends = {x: [abs(b - a) for a, b in zip(gaps[x], gaps[x][1:])] for x in "sd"}
        sides = [f[x] for x in "sd" if f[x]]
        last = max(x[-1] for x in sides)
        dur = last - (min(f["s"][0], f["d"][0] if f["d"] else 0) if compat else min(x[0] for x in sides))
        sa = max(0, f["sa"] - f["syn"]) / 1e6 if f["sa"] is not None and f["syn"] is not None else 0.0
        ack = max(0, f["ack"] - f["sa"]) / 1e6 if f["ack"] is not None and f["sa"] is not None else 0.0
        out[key] = (max(0, dur) / 1e6, f["sttl"], f["dttl"], f["sl"], f["dl"], mean(gaps["s"]), mean(gaps["d"]),
                    mean(bends["s"]), mean(bends["d"]), f["swin"], f["dwin"], sa + ack, sa, ack,
                    len(f["s"]), len(f["d"]), f["sb"], f["db"], last / 1e6)
    return out


@pytest.mark.parametrize("seed,hot,block,partitions,compat", [
    (1, 0.0, 1 << 20, 4, False), (2, 0.0, 5, 16, False), (3, 0.6, 40, 1, True), (4, 0.6, 3, 4, False)])
def test_flows_equal_the_loop(spark, seed, hot, block, partitions, compat):
    rows = random_packets(1500, seed, hot=hot)
    df = spark.createDataFrame(rows, PACKETS).repartition(partitions)
    got = {(r.src, r.dst, r.sport, r.dport, r.proto): tuple(r[m] for m in packets.MEASURES)
           for r in packets.packets_to_flows(df, compat, block).collect()}
    expected = loop(rows, compat)
    assert set(got) == set(expected)
    for key, values in expected.items():
        assert got[key] == pytest.approx(values, rel=1e-9, abs=1e-6), key


def test_direction_of_self_flow_and_controlled_capture(spark):
    tcp = (64, 60, True, 500)
    rows = [(0, 10, "a", "a", 5, 5, 6, *tcp, 1, "S", 0), (1, 20, "a", "a", 5, 5, 6, *tcp, 2, "A", 0),
            (2, 30, "c", "b", 9, 80, 6, *tcp, 1, "S", 0), (3, 40, "b", "c", 80, 9, 6, *tcp, 1, "SA", 0)]
    got = {r.ord: r.is_forward for r in packets.first_seen_direction(spark.createDataFrame(rows, PACKETS)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}


def test_one_way_duration(spark):
    rows = [(i, 1_000_000 * (i + 5), "a", "b", 1, 2, 17, 64, 60, False, None, None, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, PACKETS)
    assert packets.packets_to_flows(df).first().dur == 2.0
    assert packets.packets_to_flows(df, compat=True).first().dur == 7.0


def test_two_sided_capture_hits_the_port_rule(spark):
    from flowsift.operators.rules import apply_rules

    rows, n = [], 0
    for i in range(100):
        for src, dst, sport, dport in ((f"10.10.0.{i}", "192.168.1.1", 40000 + i, 445), ("127.0.0.1", "127.0.0.1", 50000 + i, 8000)):
            for flags, payload in (("S", 0), ("PA", 20)):
                rows.append((n, 1000 * n, src, dst, sport, dport, 6, 64, 60 + payload, True, 8192, n, flags, payload))
                n += 1
    flows = packets.packets_to_flows(spark.createDataFrame(rows, PACKETS))
    named = flows.withColumnsRenamed({"src": "src_ip", "dst": "dst_ip", "sport": "src_port", "dport": "dst_port", "proto": "protocol"})
    fired = apply_rules(named).filter("sig.is_intrusion")
    assert flows.count() == 200 and fired.count() == 100
    assert {r.dst_port for r in fired.collect()} == {445}


def test_packets_are_read_and_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "packets")
    spark.createDataFrame(random_packets(500, 3), PACKETS).write.parquet(path)
    table = spark.read.parquet(path)
    plan = packets.flow_segments(table, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("Exchange") == 1
    # What follows reads the segments; numbers of sides with one segment are not even read.
    flows = packets.packets_to_flows(table, block=50)._jdf.queryExecution()
    assert path not in flows.optimizedPlan().toString() and path not in flows.executedPlan().toString()
