import json
import logging

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.operators.connections import extractors
from flowsift.operators.clean import label_from_text
from flowsift.sources import flows, logs, sinks
from flowsift.sources.schemas import EXPORTER, FEATURES_C, RAW_U, type_c, type_u


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_quirks(spark, tmp_path, caplog):
    one = write(tmp_path / "one.csv", " Destination Port, Fwd Header Length,Flow Bytes/s, Fwd Header Length, Label\n"
                "80,20,Infinity,21,BENIGN\n443,30,NaN,31,DoS Hulk\n")
    two = write(tmp_path / "two.csv", "Label,Destination Port,Extra\nPortScan,22,1.5\n")
    with caplog.at_level(logging.WARNING, "flowsift.sources"):
        df = flows.read_flow_csvs(spark, [one, str(tmp_path / "missing.csv"), two], ordinal="ord")
    assert "missing.csv" in caplog.text and "Extra" in caplog.text
    rows = df.orderBy("ord").collect()
    assert df.columns == ["Destination Port", "Fwd Header Length", "Flow Bytes/s", "Fwd Header Length.1", "Label", "ord", "Extra"]
    assert [tuple(r)[:4] for r in rows] == [(80.0, 20.0, None, 21.0), (443.0, 30.0, None, 31.0), (22.0, None, None, None)]
    assert [r.label for r in label_from_text(df.orderBy("ord")).collect()] == [0, 1, 1]
    with pytest.raises(FileNotFoundError):
        flows.read_flow_csvs(spark, [str(tmp_path / "nothing.csv")])


def test_charset_is_a_parameter(spark, tmp_path):
    path = write(tmp_path / "latin.csv", "Label,Flow Duration\nWeb Attack é XSS,1\n", "latin-1")
    good = flows.read_flow_csvs(spark, [path], encoding={path: "ISO-8859-1"}).first()
    assert good.Label == "Web Attack é XSS"


def test_unique_names():
    assert flows.unique_names([" a", "b ", "a", "a "]) == ["a", "b", "a.1", "a.2"]


def test_headerless_and_presplit(spark, tmp_path):
    raw = write(tmp_path / "raw.csv", ",".join("tcp" if n == "proto" else "1" for n in RAW_U) + "\n")
    df = flows.read_headerless(spark, [raw])
    assert df.columns == RAW_U and df.first()["proto"] == "tcp"
    assert "spkts" in flows.presplit_names(df).columns
    names = write(tmp_path / "names.csv", "No,Name ,Type\n1, alpha ,x\n2,beta,y\n", "latin-1")
    small = write(tmp_path / "small.csv", "1,2\n3,4\n")
    named = flows.read_headerless(spark, [small], names, ordinal="ord")
    assert named.columns == ["alpha", "beta", "ord"] and named.count() == 2

    a = write(tmp_path / "train.csv", "id,proto,dur,label\n1,udp,0.5,0\n")
    b = write(tmp_path / "test.csv", "id,proto,dur,label\n2,tcp,0.1,1\n")
    assert flows.read_presplit(spark, a, b).count() == 2
    assert flows.read_presplit(spark, a, str(tmp_path / "no.csv"), lambda: df).columns == RAW_U
    with pytest.raises(FileNotFoundError):
        flows.read_presplit(spark, a, str(tmp_path / "no.csv"))
    assert (str(type_u("Spkts")), str(type_u("dur")), str(type_c("Label"))) == ("LongType()", "DoubleType()", "StringType()")


def test_exporter_contract(spark, tmp_path):
    assert len(EXPORTER) == 71 == len(set(FEATURES_C))
    header = [*EXPORTER, "src_ip", "protocol", "timestamp"]
    path = write(tmp_path / "flows.csv", ",".join(header) + "\n" + ",".join(["1"] * 71 + ["10.0.0.1", "6", "2024-01-01"]) + "\n")
    row = flows.read_exporter_csv(spark, path).first()
    assert row["Destination Port"] == 1.0 and row["src_ip"] == "10.0.0.1" and row["dst_port"] == 1.0
    assert extractors()["c"]({"exporter": flows.read_flow_csv(spark, path)}).count() == 1
    with pytest.raises(ValueError, match="flow_duration, idle_min"):
        flows.conform_exporter(spark.range(1).select(*[F.lit(1).alias(c) for c in EXPORTER if c not in ("flow_duration", "idle_min")]))


def test_alert_log(spark, tmp_path):
    alert = {"event_type": "alert", "src_ip": "a", "dest_ip": "b", "src_port": 1, "dest_port": 2}
    lines = ["", "{broken", json.dumps({"event_type": "flow"}),
             json.dumps({**alert, "alert": {"signature": "TCP INVALID checksum", "signature_id": 9}}),
             json.dumps({**alert, "alert": {"signature": "R1", "signature_id": 7, "severity": 1}}),
             json.dumps({**alert, "src_port": "odd", "alert": {"signature": "R2", "severity": "2"}}), json.dumps({"event_type": "alert"})]
    df = logs.read_alerts(spark, write(tmp_path / "alerts.json", "\n".join(lines) + "\n"))
    got = [(r.signature, r.signature_id, r.severity, r.src_ip) for r in df.orderBy("alert_ord").collect()]
    assert got == [("R1", "7", 1, "a"), ("R2", "unknown", 2, "a"), ("", "unknown", 3, None)]
    assert logs.read_alerts(spark, str(tmp_path / "absent.json")).count() == 0


def test_connection_logs(spark, tmp_path):
    write(tmp_path / "conn.log", json.dumps({"uid": "u", "id.orig_h": "a", "id.resp_p": 80, "duration": 1.5}) + "\nnot json\n\n")
    write(tmp_path / "ftp.log", json.dumps({"uid": "u", "command": "RETR", "user": "bob"}) + "\n")
    t = logs.read_conn_logs(spark, str(tmp_path))
    row = t["conn"].first()
    assert t["conn"].count() == 1 and (row.orig_h, row.resp_p, row.duration, row.service) == ("a", 80, 1.5, None)
    assert t["ftp"].first().usr == "bob" and t["http"].count() == 0


def test_json_flows_route_rejects(spark):
    df = spark.createDataFrame([(1, '{"dst_port": 80}'), (2, "oops"), (3, None), (4, "[1]")], "id int, j string")
    good, bad = flows.parse_flow_json(df, "j", "dst_port INT")
    assert [tuple(r) for r in good.collect()] == [(1, 80)]
    assert sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 0.5)], "id int, rules array<string>, p double")
    sinks.write_flow_results(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().rules == '["a","b"]'
    sinks.write_flow_results(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).first().rules == ["a", "b"]
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().p == 0.5


def test_state_round_trip(spark, tmp_path):
    encoders = spark.createDataFrame([("proto", "tcp", 0), ("proto", "udp", 1)], "column_name string, value string, code int")
    state = sinks.PrepState(encoders, {"dur": 0.5}, ["proto", "dur"], {"dur": "seconds"})
    state.save(str(tmp_path / "state"))
    again = sinks.PrepState.load(spark, str(tmp_path / "state"))
    assert (again.medians, again.features, again.descriptions, again.labels) == ({"dur": 0.5}, ["proto", "dur"], {"dur": "seconds"}, {0: "BENIGN", 1: "ATTACK"})
    assert sorted(map(tuple, again.encoders.collect())) == [("proto", "tcp", 0), ("proto", "udp", 1)]


def test_detection_store(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "r1", True), ("d2", "r1", False), ("d3", "r2", True)], "detection_id string, analysis_id string, is_intrusion boolean")
    runs = spark.createDataFrame([("r1", 2), ("r2", 1)], "analysis_id string, flow_count int")
    path = str(tmp_path / "store")
    sinks.write_detections(rows, runs, path)
    stored = sinks.read_detections(spark, path)
    assert stored.count() == 2
    assert sinks.lookup_detection(stored, "d1", "r1").first().analysis_id == "r1"
    assert sinks.lookup_run(spark, path, "r2").first().flow_count == 1
    for missing in (lambda: sinks.lookup_detection(stored, "d2"), lambda: sinks.lookup_run(spark, path, "r9")):
        with pytest.raises(LookupError):
            missing()
    plan = stored.filter("detection_id = 'd1' AND analysis_id = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(analysis_id" in plan and "EqualTo(detection_id,d1)" in plan


def test_rerun_replaces_what_was_stored(spark, tmp_path):
    schema, path = "detection_id string, analysis_id string, is_intrusion boolean", str(tmp_path / "store")

    def store(rows, runs):
        sinks.write_detections(spark.createDataFrame(rows, schema), spark.createDataFrame(runs, "analysis_id string, flow_count int"), path)

    def stored():
        return sorted((r.detection_id, r.analysis_id) for r in sinks.read_detections(spark, path).collect())

    first = [("d1", "2024-01-01 10:00", True), ("d2", "2024-01-01 10:00", True), ("d3", "007", True)]
    store(first, [("2024-01-01 10:00", 2), ("007", 1)])
    store(first, [("2024-01-01 10:00", 2), ("007", 1)])
    assert stored() == [("d1", "2024-01-01 10:00"), ("d2", "2024-01-01 10:00"), ("d3", "007")]
    assert sinks.lookup_run(spark, path, "007").count() == 1
    # One run again with another result, one that finds nothing any more, one that is new.
    store([("d4", "007", True), ("d1", "2024-01-01 10:00", False), ("d5", "r/3", True)], [("2024-01-01 10:00", 5), ("007", 9), ("r/3", 1)])
    assert stored() == [("d4", "007"), ("d5", "r/3")]
    assert sinks.lookup_run(spark, path, "2024-01-01 10:00").first().flow_count == 5
    with pytest.raises(LookupError):
        sinks.lookup_detection(sinks.read_detections(spark, path), "d1")


def test_lookup_by_id_skips_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.concat(F.lit("det-"), F.md5(F.col("id").cast("string"))).alias("detection_id"),
                                       F.concat(F.lit("run"), F.col("id") % 3).alias("analysis_id"), F.lit(True).alias("is_intrusion"), "id")
    path = str(tmp_path / "store")
    sinks.write_detections(rows, rows.groupBy("analysis_id").count(), path)
    some = rows.where("id = 4321").first().detection_id
    found = sinks.read_detections(spark, path).filter(F.col("detection_id") == some)
    assert [r.id for r in found.collect()] == [4321]

    def leaves(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return leaves(plan.executedPlan())
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return sum(map(leaves, below), []) if below else [plan]

    (scan,) = leaves(found._jdf.queryExecution().executedPlan())
    assert "Scan" in scan.nodeName() and scan.metrics().get("numOutputRows").get().value() < 100_000


def test_many_small_files_keep_their_order(spark, tmp_path):
    """Thousands of files of two headers and two charsets: one scan per header and charset, rows by file, then row."""
    paths, want = [], []
    for i in range(2000):
        path = tmp_path / f"part {(i * 7) % 2000:04d}.csv"
        names, text = (("a", "Label"), "BENIGN") if i % 2 else (("Label", "b"), "Web Attack – é")
        rows = [(f"{i}.{j}", text) if i % 2 else (text, f"{i}.{j}") for j in range(1 + i % 3)]
        body = "\n".join([",".join(names), *(",".join(r) for r in rows)])
        path.write_bytes(body.replace("–", "-").encode("latin-1" if i % 10 == 0 else "utf-8"))
        paths.append(str(path))
        want += [(f"{i}.{j}", text.replace("–", "-")) for j in range(1 + i % 3)]
    df = flows.read_flow_csvs(spark, paths, lambda _: T.StringType(), ordinal="ord")
    got = [(r.a or r.b, r.Label) for r in df.orderBy("ord").collect()]
    assert got == want
    assert [r.ord for r in df.select("ord").orderBy("ord").collect()] == list(range(len(want)))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2 * 3 + 1


def test_file_statistics_over_stretches(spark, tmp_path):
    """A file of many stretches, one without lines, odd names, a folder and a pattern."""
    body = "\n".join(["a,b", *(f"{i},{'x' * 50}" for i in range(20_000))])
    (tmp_path / "big é.csv").write_text(body + "\n\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "latin.csv").write_bytes("b,a\né,1".encode("latin-1"))
    (tmp_path / "_skipped.csv").write_text("z\n1\n")
    paths = [str(tmp_path / "[bl]*.csv"), str(tmp_path / "empty.csv"), str(tmp_path)]
    files = flows.data_files(spark, paths)
    assert [f.rsplit("/", 1)[1] for f in files] == ["big é.csv", "latin.csv", "empty.csv"]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        found = {r.file.rsplit("/", 1)[1]: (bytes(r.head), r.utf8, r.lines) for r in flows.file_statistics(spark, list(files)).collect()}
        df = flows.read_flow_csvs(spark, paths, lambda _: T.StringType(), ordinal="ord").orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == {"big%20é.csv": (b"a,b", True, 20_002), "latin.csv": (b"b,a", False, 2)}
    assert [(r.a, r.ord) for r in df] == [(str(i), i) for i in range(20_000)] + [("1", 20_000)] and df[-1].b == "é"
    assert flows.charset_of(spark, [str(tmp_path / "latin.csv")]) == {next(f for f in files if "latin" in f): "ISO-8859-1"}
    only = flows.read_flow_csv(spark, str(tmp_path / "empty.csv"))
    assert only.columns == [] and only.count() == 0


def test_descriptions_follow_the_features():
    from flowsift.operators.common_schema import COMMON, DESCRIPTIONS, descriptions_of

    assert list(DESCRIPTIONS) == COMMON and len(set(DESCRIPTIONS.values())) == 64
    said = descriptions_of(["sttl", "FIN Flag Count", "flow_duration", "unheard of"])
    assert said == {"sttl": DESCRIPTIONS["src_ttl"], "FIN Flag Count": DESCRIPTIONS["tcp_flags_fin"], "flow_duration": DESCRIPTIONS["flow_duration"]}


def test_name_tables_hold_what_they_should():
    from flowsift.operators.common_schema import COMMON, SOURCES

    assert len(EXPORTER) == 71 and EXPORTER["dst_port"] == "Destination Port" and EXPORTER["tot_fwd_pkts"] == "Total Fwd Packets"
    assert len(COMMON) == len(set(COMMON)) == 64 and COMMON[:4] == ["src_port", "dst_port", "protocol", "flow_duration"]
    assert SOURCES["u"]["fwd_packet_count"] == "spkts" and SOURCES["c"]["init_win_bwd"] == "Init_Win_bytes_backward"
    assert "src_port" not in SOURCES["u"] and "src_port" not in SOURCES["c"] and "src_ttl" not in SOURCES["c"]
