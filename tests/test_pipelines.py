"""Train, evaluate and detect end to end on a small labelled table with gaps and copies."""

import random

import pytest
from pyspark.sql import functions as F

from flowsift.operators import fuse, reports, views
from flowsift.operators.model import BoostConfig
from flowsift.plans import pipelines
from flowsift.plans.profiles import C, U, get_profile
from flowsift.sources.sinks import PrepState

SMALL = pipelines.TrainConfig(boost=BoostConfig(trees=5, depth=3, rate=0.5))


def labelled_u(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        dur, spkts = rng.choice([None, rng.random()]), rng.randrange(100)
        row = (i, rng.choice(["tcp", "udp", None]), "http", "SF", dur, spkts, float(spkts * 10), "Generic", int(spkts > 60))
        rows.append(row)
    # Near copies of the first rows under another label, and exact copies under another id.
    rows += [(n + i, *rows[i][1:8], 1 - rows[i][8]) for i in range(20)]
    return rows


@pytest.fixture(scope="module")
def flows_u(spark):
    return spark.createDataFrame(labelled_u(), "id long, proto string, service string, state string, dur double, spkts long, "
                                               "sbytes double, attack_cat string, label int")


@pytest.fixture(scope="module")
def trained(spark, flows_u, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("trained"))
    rows = flows_u.withColumn("ord", F.col("id"))
    return pipelines.run_training(rows, U, "ord", SMALL, out), out


def test_cleaning_keeps_first_rows_with_their_label(spark, flows_u):
    rows = flows_u.withColumn(pipelines.ORD, F.col("id"))
    kept = pipelines.clean_labelled(rows, U).collect()
    assert "id" not in kept[0].asDict() and "attack_cat" not in kept[0].asDict()
    # Of rows equal in all kept features the first stays, so the relabelled copies are gone.
    assert max(r[pipelines.ORD] for r in kept) < 900
    by_key = {}
    for r in labelled_u():
        by_key.setdefault((r[1], r[2], r[3], round(r[4], 4) if r[4] is not None else None, r[5], r[6]), (r[0], r[8]))
    assert {(r[pipelines.ORD], r.label) for r in kept} == set(by_key.values())


def test_training_fits_on_train_rows_only(spark, trained, flows_u):
    result, out = trained
    assert result.features == ["proto", "service", "state", "dur", "spkts", "sbytes"]
    counts = {r.split: r["count"] for r in result.matrix.groupBy("split").count().collect()}
    total = sum(counts.values())
    assert counts["train"] == total - -(-3 * total // 10)
    assert result.metrics.first().roc_auc > 0.9
    saved = PrepState.load(spark, f"{out}/state")
    assert saved.features == result.features
    assert {r.value for r in saved.encoders.filter("column_name = 'proto'").collect()} <= {"tcp", "udp", "nan"}
    assert spark.read.json(f"{out}/threshold_sweep").count() == 17


def test_evaluation_of_the_saved_model_repeats_the_test_metrics(spark, trained, flows_u):
    result, out = trained
    again = pipelines.run_evaluation(spark, flows_u.withColumn("ord", F.col("id")), U, "ord", out, SMALL)
    assert again["metrics"].first() == result.metrics.first()
    assert set(again) == {"metrics", "class_report", "roc_curve", "pr_curve", "pr_auc", "threshold_sweep", "threshold_best"}


def test_detection_end_to_end(spark, trained, flows_u, tmp_path):
    result, _ = trained
    flows = flows_u.limit(50).select("*", F.col("id").alias("flow_id"), F.lit("run").alias("analysis_id"),
                                     F.concat(F.lit("h"), F.col("id")).alias("src_ip"), F.lit("t").alias("dst_ip"),
                                     F.lit(1).alias("src_port"), F.when(F.col("id") % 5 == 0, 445).otherwise(80).alias("dst_port"),
                                     F.lit(0).alias("last_us"))
    alerts = spark.createDataFrame([(1, "t", "h3", 80, 1, "R", "7", 2)],
                                   "alert_ord long, src_ip string, dst_ip string, src_port int, dst_port int, signature string, signature_id string, severity int")
    out = pipelines.run_detection(flows, result.model, result.features, 0.5, result.state, alerts=alerts, out=str(tmp_path / "d"), explain=True)
    rows = {r.flow_id: r for r in out["detections"].collect()}
    assert len(rows) == 50 and rows[3].signature == "SID-7: R" and rows[3].severity == "HIGH"
    summary = out["summaries"].first()
    assert summary.flow_count == 50 and summary.total_intrusions == sum(r.is_intrusion for r in rows.values())
    listed = {r.detection_id: r for r in out["incidents"].collect()}
    assert set(listed) == {r.detection_id for r in rows.values() if r.is_intrusion}
    report = listed[rows[3].detection_id].report
    assert "[signatures]" in report and "SID-7: R" in report and "1. " in report.split("[indicators]")[1]
    ruled = pipelines.run_detection(flows, result.model, result.features, 0.5, result.state)
    assert ruled["detections"].filter("signature = 'SIG-SMB-445'").count() == 10


def test_detector_comparison_is_stored(spark, tmp_path):
    flows = spark.createDataFrame([(1, 0.9, 445, 1), (2, 0.1, 80, 1), (3, 0.1, 23, 0)], "flow_id int, score double, dst_port int, src_port int")
    judged = pipelines.hybrid_detection(flows)
    out = pipelines.run_comparison(judged, F.lit(True), out=str(tmp_path / "cmp"))
    assert {r.detector: (r.tp, r.fn) for r in out["metrics"].collect()} == {"ml": (1, 2), "signature": (2, 1), "hybrid": (2, 1)}
    rows = spark.read.csv(str(tmp_path / "cmp" / "flows"), header=True).orderBy("flow_id").collect()
    assert [(r.ground_truth, r.ml_verdict, r.signature_rules, r.hybrid_trigger) for r in rows] == [
        ("ATTACK", "ATTACK", "SIG-SMB-445", "BOTH"), ("ATTACK", "BENIGN", None, "NONE"), ("ATTACK", "BENIGN", "SIG-TELNET-23", "SIGNATURE")]
    assert spark.read.json(str(tmp_path / "cmp" / "component_counts")).first().neither == 1


def test_training_on_the_common_schema(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(9)), rng.random(), "DoS" if i % 3 == 0 else "BENIGN") for i in range(400)]
    df = spark.createDataFrame(rows, ["ord", "Destination Port", "Flow Bytes/s", "Label"])
    config = pipelines.TrainConfig(common=True, boost=BoostConfig(trees=2, depth=2))
    result = pipelines.run_training(df, C, "ord", config)
    assert len(result.features) == 64 and result.threshold == 0.75


def test_profile_lookup():
    assert get_profile("U") is U
    with pytest.raises(ValueError, match="unknown profile"):
        get_profile("x")


def test_report_sections_are_left_out_when_empty(spark):
    flows = spark.createDataFrame([(1, 0.001, "a", "b", 1, 2, 0, "d1")],
                                  "flow_id int, score double, src_ip string, dst_ip string, src_port int, dst_port int, last_us long, detection_id string")
    judged = fuse.fuse(fuse.verdicts(flows, "score", 0.5).withColumn("sig", F.lit(None).cast(
        "struct<is_intrusion:boolean,matched_rules:array<string>,severity:string,engine:string>")))
    row = reports.incident_report(reports.incidents(judged)).first()
    assert row.signature_result is None and row.severity == "LOW" and row.protocol == "unknown"
    assert "[signatures]" not in row.report and "[indicators]" not in row.report and "probability: 0.0010 (0.1%)" in row.report
    assert row.feature_values == {"flow_id": "1", "src_port": "1", "dst_port": "2", "last_us": "0"}


def test_views_treat_missing_values(spark):
    df = spark.createDataFrame([("d1", None, "b", None, 0, None, "ML", "LOW", None), ("d2", "A1", "b", 5, 6, "udp", "BOTH", "ODD", 0.0)],
                               "detection_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
                               "triggered_by string, severity string, ml_confidence double").withColumn("flow_time", F.lit("2024-01-01").cast("timestamp"))
    shown = views.display_row(df).orderBy("detection_id").collect()
    assert [(r.source, r.destination, r.protocol) for r in shown] == [("unknown:*", "b:*", "TCP"), ("A1:5", "b:6", "udp")]
    assert [r.confidence for r in views.activity_series(df).collect()] == [1.0, 1.0]
    assert {(r.severity, r.n) for r in views.kpi_severity(df).collect()} == {("LOW", 2)}
    assert {(r.protocol, r.n) for r in views.breakdown(df, "protocol").collect()} == {("Unknown", 1), ("udp", 1)}
    assert [r.detection_id for r in views.filter_incidents(df, "a1").collect()] == ["d2"]
    assert tuple(views.shown_of_total(df, "", "", "ML").first()) == (1, 2)


def test_intermediates_are_dropped(spark):
    import os

    from flowsift.session import intermediates, materialise

    with intermediates(spark):
        df = materialise(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file:")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
