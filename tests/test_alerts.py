"""Alert matching against the plain per-flow scan, and the rule and fusion tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from flowsift.operators import alerts as A
from flowsift.operators import fuse
from flowsift.operators.rules import Rule, apply_rules
from flowsift.plans.pipelines import hybrid_detection

FLOW = "flow_id long, src_ip string, dst_ip string, src_port int, dst_port int"
ALERT = "alert_ord long, src_ip string, dst_ip string, src_port int, dst_port int, signature string, signature_id string, severity int"


def scan(flow, alerts):
    """Each alert in turn, forward or swapped; an unknown flow field fits anything."""
    _, si, di, sp, dp = flow

    def fits(a, b, c, d):
        return all(f is None or f == v for f, v in zip((si, di, sp, dp), (a, b, c, d)))

    return [x for x in alerts if fits(x[1], x[2], x[3], x[4]) or fits(x[2], x[1], x[4], x[3])]


def random_case(seed, n_flows=400, n_alerts=300):
    rng = random.Random(seed)

    def ends(gap):
        ip = lambda: None if rng.random() < gap else rng.choice("abc")
        port = lambda: None if rng.random() < gap else rng.choice([1, 2, 445])
        # Half of everything shares one pair of ends.
        return ("a", "b", 1, 445) if rng.random() < 0.5 and gap < 0.5 else (ip(), ip(), port(), port())

    flows = [(i, *ends(0.25)) for i in range(n_flows)]
    alerts = [(i, *ends(0.1), f"rule {i % 4}", str(i % 4), rng.choice([1, 2, 3])) for i in range(n_alerts)]
    return flows, alerts


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 4), (3, 16)])
def test_match_equals_the_scan(spark, seed, partitions):
    flows, alerts = random_case(seed)
    out = A.match_alerts(spark.createDataFrame(flows, FLOW).repartition(partitions),
                         spark.createDataFrame(alerts, ALERT).repartition(partitions)).collect()
    got = {r.flow_id: r.sig for r in out}
    assert len(out) == len(flows)
    for flow in flows:
        hits, sig = scan(flow, alerts), got[flow[0]]
        order = list(dict.fromkeys((h[6], h[5]) for h in hits))
        assert sig.matched_rules == [f"SID-{i}: {s}" for i, s in order]
        assert sig.rule_hits == [sum((h[6], h[5]) == rule for h in hits) for rule in order]
        assert sig.n_alerts == len(hits) and sig.is_intrusion == bool(hits)
        worst = max((h[7] for h in hits), default=0)
        assert sig.severity == ("NONE" if not hits else {1: "CRITICAL", 2: "HIGH"}.get(worst, "MEDIUM"))


def test_no_alerts_and_all_unknown_flow(spark):
    flows = spark.createDataFrame([(1, None, None, None, None), (2, "a", "b", 1, 2)], FLOW)
    none = A.match_alerts(flows, spark.createDataFrame([], ALERT)).collect()
    assert [r.sig.is_intrusion for r in none] == [False, False]
    some = A.match_alerts(flows, spark.createDataFrame([(1, "x", "y", 1, 2, "r", "7", 1), (2, None, None, None, None, "s", "8", 2)], ALERT))
    sig = {r.flow_id: r.sig for r in some.collect()}
    assert sig[1].matched_rules == ["SID-7: r", "SID-8: s"] and not sig[2].is_intrusion


def test_severity_takes_the_greatest_number_unless_told(spark):
    flows = spark.createDataFrame([(1, "a", "b", 1, 2)], FLOW)
    alerts = spark.createDataFrame([(1, "a", "b", 1, 2, "r", "7", 1), (2, "b", "a", 2, 1, "s", "8", 2)], ALERT)
    assert A.match_alerts(flows, alerts).first().sig.severity == "HIGH"
    assert A.match_alerts(flows, alerts, gravest=True).first().sig.severity == "CRITICAL"


def test_small_index_is_broadcast_and_large_one_is_not(spark):
    flows, alerts = (spark.createDataFrame(rows, schema) for rows, schema in zip(random_case(4), (FLOW, ALERT)))

    def plan():
        return A.match_alerts(flows, alerts)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan() and "NestedLoop" not in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan()
        assert "SortMergeJoin" in large and "NestedLoop" not in large and "Cartesian" not in large
        index = A.alert_index(flows, alerts)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in index and "Cartesian" not in index
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rules_are_pluggable(spark):
    df = spark.createDataFrame([(1, "tcp", 22, 900)], "flow_id long, proto string, dst_port int, total_fwd_packets int")
    assert not apply_rules(df).first().sig.is_intrusion
    own = [Rule("SSH", lambda: F.col("dst_port") == 22, "LOW"), Rule("NEVER", lambda: F.lit(None).cast("boolean"), "CRITICAL")]
    sig = apply_rules(df, own).first().sig
    assert (sig.is_intrusion, sig.matched_rules, sig.severity) == (True, ["SSH"], "LOW")
    assert apply_rules(df, []).first().sig.severity == "NONE"
    volume = apply_rules(df.withColumn("protocol", F.lit(6))).first().sig
    assert volume.matched_rules == ["SIG-HIGH-VOLUME-TCP"]


def test_alias_only_where_the_field_is_absent(spark):
    df = spark.createDataFrame([(None, "alias", 5)], "src_ip string, source_ip string, source_port int")
    row = fuse.with_aliases(df).first()
    assert (row.src_ip, row.src_port, row.dst_ip, row.dst_port, row.protocol) == (None, 5, "unknown", 0, "unknown")


def test_threshold_lookup():
    assert (fuse.threshold_for("u"), fuse.threshold_for("C"), fuse.threshold_for("x"), fuse.threshold_for(None)) == (0.5, 0.75, 0.5, 0.5)
    assert fuse.threshold_for("u", 0.3) == 0.3 and fuse.threshold_for("u", {"default": 0.9}) == 0.9


def test_fusion_and_severity_table(spark):
    # score, alert severity number or none -> trigger, verdict, detection severity, incident severity
    cases = [(0.97, 1, "BOTH", "INTRUSION", "CRITICAL", "CRITICAL"), (0.93, None, "ML", "INTRUSION", "HIGH", "HIGH"),
             (0.001, None, "NONE", "BENIGN", "LOW", "LOW"), (0.51, None, "ML", "INTRUSION", "LOW", "LOW"),
             (0.49999999, 3, "SIGNATURE", "INTRUSION", "MEDIUM", "MEDIUM"), (0.96, 3, "BOTH", "INTRUSION", "MEDIUM", "CRITICAL")]
    flows = spark.createDataFrame([(i, f"h{i}", "t", 1, 2, c[0]) for i, c in enumerate(cases)], FLOW + ", score double")
    alerts = spark.createDataFrame([(i, f"h{i}", "t", 1, 2, "r", "1", c[1]) for i, c in enumerate(cases) if c[1]], ALERT)
    rows = fuse.severity_incident(hybrid_detection(flows, alerts)).orderBy("flow_id").collect()
    assert [(r.triggered_by, r.final_verdict, r.severity, r.incident_severity) for r in rows] == [c[2:] for c in cases]
    without = fuse.fuse(fuse.verdicts(flows, "score", 0.5)).orderBy("flow_id").collect()
    assert [r.triggered_by for r in without] == ["ML", "ML", "NONE", "ML", "NONE", "ML"]


def test_severities_known_beforehand_are_not_compared_in_the_plan(spark):
    # The optimizer took UPPER of them in the driver, which fills its heap with ICU's table of case mappings.
    flows = spark.createDataFrame([(i, 6, 40000, port, score, 1) for i, (port, score) in enumerate(
        [(22, 0.1), (23, 0.1), (24, 0.1), (80, 0.96), (80, 0.86), (80, 0.7), (80, None), (23, float("nan"))])],
        "flow_id long, protocol int, src_port int, dst_port int, score double, fwd_packet_count long")
    own = [Rule(f"R{port}", lambda p=port: F.col("dst_port") == p, named) for port, named in ((22, "high"), (23, "MEDIUM"), (24, "unheard of"))]
    judged = fuse.severity_incident(hybrid_detection(flows, rules=own))
    compared = re.findall(r"upper\((.{8})", judged._jdf.queryExecution().analyzed().toString())
    assert compared and all(c.startswith("sig#") for c in compared)
    rows = judged.orderBy("flow_id").collect()
    assert [r.sig.severity for r in rows] == ["HIGH", "MEDIUM", "LOW", "NONE", "NONE", "NONE", "NONE", "MEDIUM"]
    assert [r.severity for r in rows] == ["HIGH", "MEDIUM", "LOW", "CRITICAL", "HIGH", "MEDIUM", "LOW", "MEDIUM"]
    assert [r.incident_severity for r in rows] == ["HIGH", "MEDIUM", "LOW", "CRITICAL", "HIGH", "MEDIUM", "LOW", "MEDIUM"]
