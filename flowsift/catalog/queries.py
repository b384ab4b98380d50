"""One runnable query per operator, over tables derived from the driver's data.

Each takes (spark, sf_dir) and runs over whole tables. Derived doubles are rounded by the same
formula as in the oracle SQL, whole numbers are widened to 64 bits, nested values are shown
as text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.catalog.fixtures import table
from flowsift.functions.scalars import q
from flowsift.operators import (alerts, attribution, clean, common_schema, connections, encode, fuse, metrics, model,
                                order, packets, reports, rules, views)
from flowsift.plans import pipelines, profiles
from flowsift.plans.pipelines import hybrid_detection
from flowsift.session import materialise, scratch_path
from flowsift.sources import flows as flow_sources
from flowsift.sources import logs, sinks
from flowsift.sources.schemas import EXPORTER, RAW_U

Query = Callable[[SparkSession, str], DataFrame]

CLEAN_FIELDS = ["flow_duration", "flow_bytes_s", "fwd_packets", "proto"]
RAW_NUMBERS = ["flow_duration", "flow_bytes_s", "fwd_packets"]
MODEL_FEATURES = ["protocol", "service", "state", "spkts", "dpkts", "sbytes", "dbytes", "dur", "sttl", "dttl", "dst_port"]
LINEAR = {"spkts": 0.01, "dpkts": -0.02, "dur": 0.5}
FILE_ROWS = 1 << 17
BOOST = model.BoostConfig(trees=20, depth=5, rate=0.3)
END_POINTS = ["src", "dst", "sport", "dport", "proto"]


def digits(c: Column, n: int = 6) -> Column:
    scale = float(10 ** n)
    return F.rint(c * scale) / scale


def plain(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """Widen integers to 64 bits and round doubles (6 decimals unless told otherwise)."""
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DoubleType):
            c = digits(c, (places or {}).get(f.name, 6))
        out.append(c.alias(f.name))
    return df.select(*out)


def gapped(*names: str) -> list[Column]:
    """Whole-number columns with gaps as text: the two engines' Python types for them differ."""
    return [q(n).cast("string").alias(n) for n in names]


def map_text(c: Column) -> Column:
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


# -- scans and projections

def wide(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """``names`` as doubles derived from the event number: column j is (event_id x (j + 2)) mod 97."""
    cells = [F.expr(f"CAST((event_id * {j + 2}) % 97 AS DOUBLE)").alias(n) for j, n in enumerate(names, 1)]
    return table(spark, sf, "ev").select("event_id", *cells)


def conform_rename(spark, sf):
    source = wide(spark, sf, list(EXPORTER)).withColumns(
        {"src_ip": F.concat(F.lit("10.0.0."), F.col("event_id") % 9), "protocol": F.lit("6")})
    return flow_sources.conform_exporter(source, ["event_id"])


def json_flows(spark, sf):
    lines = table(spark, sf, "alert_json")
    good, _ = flow_sources.parse_flow_json(
        lines, "line", "event_type STRING, src_ip STRING, alert STRUCT<signature_id: BIGINT>")
    return good.select("ord", "event_type", "src_ip", F.col("alert.signature_id").cast("string").alias("signature_id"))


def json_rejects(spark, sf):
    _, bad = flow_sources.parse_flow_json(table(spark, sf, "alert_json"), "line", "event_type STRING")
    return bad.select("ord", "line")


def alert_filter(spark, sf):
    return plain(logs.parse_alert_lines(table(spark, sf, "alert_json"), "line", "ord"))


def clean_flows(spark, sf):
    raw = table(spark, sf, "raw_flows").withColumnRenamed("label_text", "Label")
    return plain(clean.inf_to_null(clean.drop_known(raw, clean.DROPS_C)).drop("text_num"), {"flow_bytes_s": 9})


def label_binary(spark, sf):
    text = clean.label_from_text(table(spark, sf, "raw_flows").select("ord", "label_text"), column="label_text")
    number = clean.label_from_number(table(spark, sf, "flows").select(F.col("flow_id").alias("ord"), F.col("label").alias("Label")))
    return plain(text.withColumn("source", F.lit("text")).unionByName(number.withColumn("source", F.lit("number"))))


def impute_median(spark, sf):
    raw = table(spark, sf, "raw_flows").select("ord", *RAW_NUMBERS)
    medians = clean.medians_as_dict(clean.fit_medians(raw, RAW_NUMBERS))
    return plain(clean.impute(raw, medians))


def conform_features(spark, sf):
    wanted = ["dbytes", "spkts", "no_such_feature", "dur"]
    return plain(clean.conform_features(table(spark, sf, "flows"), wanted, ["flow_id"]))


def coerce_numeric(spark, sf):
    return plain(clean.coerce_numeric(table(spark, sf, "raw_flows").select("ord", "text_num", "proto"), ["text_num", "proto"]))


def to_common_u(spark, sf):
    source = wide(spark, sf, list(common_schema.SOURCES["u"].values()))
    return plain(common_schema.to_common(source, "u", ("event_id",)))


def to_common_c(spark, sf):
    source = wide(spark, sf, list(common_schema.SOURCES["c"].values()))
    return plain(common_schema.to_common(source, "c", ("event_id",)))


def flow_rates(spark, sf):
    named = table(spark, sf, "flows").withColumnsRenamed(
        {"src_ip": "src", "dst_ip": "dst", "src_port": "sport", "dst_port": "dport"})
    return plain(connections.derive_rates(named).select(
        "flow_id", "smean", "dmean", "rate", "sload", "dload", "is_sm_ips_ports"))


def flow_aliases(spark, sf):
    renamed = table(spark, sf, "flows").select(
        "flow_id", F.col("src_ip").alias("source_ip"), "dst_ip", F.col("src_port").alias("source_port"), "dst_port",
        F.col("protocol").alias("proto"))
    named = fuse.with_aliases(renamed)
    return plain(named.select("flow_id", "src_ip", "dst_ip", *gapped("src_port"), "dst_port", "protocol", "fwd_packet_count"))


def flow_metadata(spark, sf):
    return fuse.flow_metadata(table(spark, sf, "flows")).select("flow_id", map_text(F.col("flow_metadata")).alias("metadata"))


def attack_sample(spark, sf):
    raw = table(spark, sf, "raw_flows")
    return plain(clean.sample_attack(raw, "DoS Hulk", RAW_NUMBERS, "ord", label="label_text", n=5), {"flow_bytes_s": 9})


def union_flows(spark, sf):
    flows = table(spark, sf, "flows")
    a = flows.select("flow_id", "spkts", "service")
    b = flows.select("flow_id", "dpkts", "service")
    both = clean.union_flows([a, b], allow_missing=True)
    return both.select("flow_id", "service", *gapped("spkts", "dpkts"))


# -- duplicates, statistics, dictionaries

def dedup_exact(spark, sf):
    rows = table(spark, sf, "raw_flows").select("ord", "fwd_packets", "proto", "label_text")
    return clean.dedup_exact(rows, "ord")


def dedup_near(spark, sf):
    raw = clean.inf_to_null(table(spark, sf, "raw_flows"))
    return plain(clean.dedup_near(raw, CLEAN_FIELDS, "ord").select("ord", *CLEAN_FIELDS), {"flow_bytes_s": 9})


def fit_medians(spark, sf):
    return plain(clean.fit_medians(table(spark, sf, "raw_flows"), RAW_NUMBERS))


def fit_medians_narrowed(spark, sf):
    """Medians selected in sixteen rounds of four bits."""
    return plain(clean.fit_medians(table(spark, sf, "raw_flows"), RAW_NUMBERS, bits=4))


def label_distribution(spark, sf):
    return clean.value_counts(table(spark, sf, "raw_flows"), "label_text")


def profile_missing(spark, sf):
    return clean.profile_missing(table(spark, sf, "raw_flows"), [*RAW_NUMBERS, "proto", "label_text"])


def _raw_categories(spark, sf):
    return table(spark, sf, "raw_flows").select("ord", "proto", "label_text")


def fit_encoder(spark, sf):
    return plain(encode.fit_encoder(_raw_categories(spark, sf), ["proto", "label_text"]))


def encode_categories(spark, sf):
    rows = _raw_categories(spark, sf)
    known = encode.fit_encoder(rows.filter("proto IS NOT NULL AND label_text <> 'PortScan'"), ["proto", "label_text"])
    return plain(encode.encode(rows, known, ["proto", "label_text"]))


def encode_categories_joined(spark, sf):
    """Encoding by the shuffle join that large dictionaries take."""
    rows = _raw_categories(spark, sf)
    known = encode.fit_encoder(rows.filter("proto IS NOT NULL AND label_text <> 'PortScan'"), ["proto", "label_text"])
    return plain(encode.encode(rows, known, ["proto", "label_text"], hint="merge"))


# -- packets and connections

def packets_to_flows_blocks(spark, sf):
    """The same flows from blocks of 256 packets, stitched."""
    return plain(packets.packets_to_flows(table(spark, sf, "packets"), block=256),
                 {"sinpkt": 3, "dinpkt": 3, "sjit": 3, "djit": 3})


def packets_to_flows(spark, sf):
    return plain(packets.packets_to_flows(table(spark, sf, "packets")),
                 {"sinpkt": 3, "dinpkt": 3, "sjit": 3, "djit": 3})


def packets_to_flows_compat(spark, sf):
    return plain(packets.packets_to_flows(table(spark, sf, "packets"), compat=True).select(*END_POINTS, "dur", "last_time"))


def packet_direction(spark, sf):
    return packets.first_seen_direction(table(spark, sf, "packets")).select("ord", "is_forward")


def inter_arrival(spark, sf):
    return plain(packets.inter_arrival(table(spark, sf, "packets")), {"sinpkt": 3, "dinpkt": 3})


def jitter(spark, sf):
    return plain(packets.jitter(table(spark, sf, "packets")), {"sjit": 3, "djit": 3})


def retransmissions(spark, sf):
    return plain(packets.retransmissions(table(spark, sf, "packets")))


def handshake_times(spark, sf):
    marks = packets.handshake(table(spark, sf, "packets"))
    return plain(marks.select(*END_POINTS, *gapped("syn_us", "synack_us", "ack_us"), "synack", "ackdat", "tcprtt"))


def _flow_inputs(spark, sf):
    return {n: table(spark, sf, n) for n in ("conn", "http", "ftp", "packets")}


def conn_enrich(spark, sf):
    t = _flow_inputs(spark, sf)
    enriched = connections.enrich_connections(t["conn"], packets.packets_to_flows(t["packets"]))
    return plain(enriched.select("uid", "src", "dst", "sport", "dport", "proto", "service", "state", "dur", "spkts",
                                 "dpkts", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "last_us"))


def http_last(spark, sf):
    return plain(connections.last_by(table(spark, sf, "http"), "uid", "ord"))


def app_counts(spark, sf):
    t = _flow_inputs(spark, sf)
    return plain(connections.attach_app_counts(t["conn"].select("uid"), t["http"], t["ftp"]))


def conn_window_counts(spark, sf):
    named = table(spark, sf, "flows").withColumnsRenamed(
        {"src_ip": "src", "dst_ip": "dst", "src_port": "sport", "dst_port": "dport"})
    counted = connections.conn_window_counts(named, "last_us", "flow_id")
    return plain(counted.select("flow_id", "rn", *connections.COUNTERS))


def conn_window_counts_blocks(spark, sf):
    """The same counters from blocks of 500 flows."""
    named = table(spark, sf, "flows").withColumnsRenamed(
        {"src_ip": "src", "dst_ip": "dst", "src_port": "sport", "dst_port": "dport"})
    return plain(connections.conn_window_counts(named, "last_us", "flow_id", block=500).select("flow_id", "rn", *connections.COUNTERS))


def extract_flows_u(spark, sf):
    return plain(connections.extract_u(_flow_inputs(spark, sf)).select(
        "flow_id", "dur", "spkts", "rate", "trans_depth", "is_ftp_login", *connections.COUNTERS))


# -- order, split, sample

def split_stratified(spark, sf):
    return plain(order.split_stratified(table(spark, sf, "flows").select("flow_id", "label"), "flow_id"))


def split_summary(spark, sf):
    return plain(metrics.split_summary(order.split_stratified(table(spark, sf, "flows"), "flow_id")))


def sample_n(spark, sf):
    return order.sample_n(table(spark, sf, "flows").select("flow_id", "score"), "flow_id", 1000)


# -- metrics

def _scored(spark, sf):
    return table(spark, sf, "flows").select("score", "label")


def class_weight(spark, sf):
    return plain(metrics.class_weight(_scored(spark, sf)))


def row_number_gaps(spark, sf):
    """Order by a key with missing values, NaN and infinities; many rows share a value."""
    return order.global_row_number(table(spark, sf, "raw_flows").select("ord", "flow_bytes_s"), "flow_bytes_s", "ord", buckets=32).select("ord", "rn")


def metrics_unscored(spark, sf):
    """Recall by three tables of an evaluation over flows of which some have no score or NaN."""
    gaps = F.when(F.col("flow_id") % 9 == 0, None).when(F.col("flow_id") % 9 == 1, float("nan")).otherwise(F.col("score"))
    df = table(spark, sf, "flows").select(gaps.alias("score"), "label")
    at = metrics.SWEEP[8]  # just above 0.5
    whole = metrics.binary_metrics(df, threshold=at).select(F.lit("metrics").alias("source"), F.col("true_positive_rate").alias("recall"), F.col("total_samples").alias("n"))
    report = metrics.class_report(df, threshold=at).where("class_name = 'ATTACK'").select(F.lit("report"), "recall", F.col("support").alias("n"))
    sweep = metrics.threshold_sweep(df).where("threshold = 0.5").select(F.lit("sweep"), "recall", F.lit(None).cast("long"))
    return plain(whole.union(report).union(sweep)).select("source", "recall", F.coalesce("n", F.lit(0)).alias("n"))


def conn_log_lines(spark, sf):
    """Connection log lines with times as text, ports as text and unusable numbers, read from a written log."""
    folder = scratch_path(spark, "logs")
    conn = table(spark, sf, "conn")
    port = F.when(F.col("ord") % 2 == 0, F.concat(F.lit('"'), F.col("orig_p"), F.lit('"'))).otherwise(F.col("orig_p").cast("string"))
    line = F.concat(F.lit('{"ts":"2024-01-01T00:00:00Z","uid":"'), F.col("uid"), F.lit('","id.orig_h":"'), F.col("orig_h"), F.lit('","id.orig_p":'), port,
                    F.lit(',"orig_pkts":'), F.when(F.col("ord") % 5 == 0, '"-"').otherwise(F.col("orig_pkts").cast("string")), F.lit("}"))
    conn.select(F.when(F.col("ord") % 7 == 0, "{broken").otherwise(line).alias("value")).write.text(f"{folder}/conn.log")
    rows = logs.read_conn_logs(spark, folder)["conn"]
    return plain(rows.select("uid", "orig_h", "orig_p", F.coalesce("orig_pkts", F.lit(-1)).alias("orig_pkts")))


def explained_incidents(spark, sf):
    """Incidents with indicators less intrusions, per run; flow ids repeat between the runs."""
    fitted, matrix = _trained(spark, sf)
    flows = matrix.drop("split").withColumn("analysis_id", F.explode(F.array(F.lit("run-a"), F.lit("run-b"))))
    # The ends come from the flow table; the model needs none of them.
    ends = table(spark, sf, "flows").select("flow_id", "src_ip", "dst_ip", "src_port", "last_us")
    found = pipelines.run_detection(flows.join(ends, "flow_id"), fitted, MODEL_FEATURES, 0.5, explain=True)
    told = found["incidents"].where(F.size("top_features") > 0).groupBy("detection_id").agg(F.count("*").alias("n"))
    hits = found["detections"].where("is_intrusion").join(told, "detection_id", "left")
    return hits.groupBy("analysis_id").agg((F.sum(F.coalesce("n", F.lit(0))) - F.count("*")).alias("surplus"))


def binary_metrics(spark, sf):
    return plain(metrics.binary_metrics(_scored(spark, sf)))


def class_report(spark, sf):
    return plain(metrics.class_report(_scored(spark, sf)))


def threshold_sweep(spark, sf):
    return plain(metrics.threshold_sweep(_scored(spark, sf)))


def threshold_best(spark, sf):
    return plain(metrics.threshold_best(metrics.threshold_sweep(_scored(spark, sf))))


def roc_curve(spark, sf):
    points = metrics.roc_curve(_scored(spark, sf))
    return plain(points.withColumn("threshold", F.when(F.col("threshold") <= 1, F.col("threshold"))))


def roc_auc(spark, sf):
    return plain(metrics.roc_auc(_scored(spark, sf)))


def pr_curve(spark, sf):
    return plain(metrics.pr_curve(_scored(spark, sf)))


def pr_auc(spark, sf):
    return plain(metrics.pr_auc(_scored(spark, sf)))


def _flags(spark, sf):
    judged = _judged(spark, sf)
    return judged.select("label", F.col("ml.is_intrusion").alias("ml_flag"), F.col("sig.is_intrusion").alias("sig_flag"))


def compare_detectors(spark, sf):
    return plain(metrics.compare_detectors(_flags(spark, sf)))


def flow_results(spark, sf):
    rows = pipelines.flow_results(_judged(spark, sf), F.col("label") == 1)
    return plain(rows.select(*[c for c in rows.columns if c != "src_port"], *gapped("src_port")))


def complementarity(spark, sf):
    return metrics.complementarity(_flags(spark, sf))


# -- detection

def _judged(spark, sf):
    return hybrid_detection(table(spark, sf, "flows"), table(spark, sf, "alerts"), threshold=0.5)


def _detections(spark, sf):
    return fuse.detection_rows(_judged(spark, sf))


def rule_signatures(spark, sf):
    flows = table(spark, sf, "flows").withColumn("fwd_packet_count", F.col("spkts"))
    fired = rules.apply_rules(flows)
    return fired.select("flow_id", F.col("sig.is_intrusion").alias("is_intrusion"), F.col("sig.severity").alias("severity"),
                        F.array_join("sig.matched_rules", ";").alias("matched_rules"))


def rules_empty(spark, sf):
    fired = rules.apply_rules(table(spark, sf, "flows"), [])
    return fired.select("flow_id", F.col("sig.is_intrusion").alias("is_intrusion"), F.col("sig.severity").alias("severity"))


def _sig_text(df):
    return df.select("flow_id", F.col("sig.is_intrusion").alias("is_intrusion"),
                     F.array_join("sig.matched_rules", ";").alias("matched_rules"),
                     F.array_join(F.transform("sig.rule_hits", lambda h: h.cast("string")), ";").alias("rule_hits"),
                     F.col("sig.n_alerts").alias("n_alerts"), F.col("sig.severity").alias("severity"),
                     alerts.first_rule(F.col("sig.matched_rules")).alias("first_rule"),
                     F.col("sig.details").alias("details"))


def match_alerts(spark, sf):
    return _sig_text(alerts.match_alerts(table(spark, sf, "flows"), table(spark, sf, "alerts")))


def match_alerts_aliases(spark, sf):
    """Flows with the other exporters' field names and without source ports."""
    flows = table(spark, sf, "flows").withColumnsRenamed({"src_ip": "source_ip", "dst_ip": "destination_ip", "dst_port": "destination_port"})
    matched = alerts.match_alerts(flows.drop("src_port"), table(spark, sf, "alerts"))
    return plain(matched.select("flow_id", "sig.n_alerts", "sig.is_intrusion"))


def match_alerts_gravest(spark, sf):
    return _sig_text(alerts.match_alerts(table(spark, sf, "flows"), table(spark, sf, "alerts"), gravest=True)).select(
        "flow_id", "n_alerts", "severity")


def verdicts(spark, sf):
    profile = F.when(F.col("flow_id") % 3 == 0, "u").when(F.col("flow_id") % 3 == 1, "c").otherwise("other")
    judged = fuse.verdicts(table(spark, sf, "flows").withColumn("profile", profile), "score",
                           fuse.threshold_column(F.col("profile")))
    return plain(judged.select("flow_id", "profile", "ml.prediction", "ml.probability", "ml.threshold", "ml.is_intrusion"))


def fuse_verdicts(spark, sf):
    return _judged(spark, sf).select("flow_id", "is_intrusion", "triggered_by", "final_verdict")


def severity_detection(spark, sf):
    return _judged(spark, sf).select("flow_id", "severity")


def severity_incident(spark, sf):
    return fuse.severity_incident(_judged(spark, sf)).select("flow_id", "incident_severity")


def detection_rows(spark, sf):
    rows = _detections(spark, sf)
    return plain(rows.select(
        "detection_id", "analysis_id", "flow_id", "is_intrusion", "final_verdict", "triggered_by", "severity",
        F.col("ml_result.verdict").alias("ml_verdict"), "ml_confidence",
        F.col("signature_result.verdict").alias("signature_verdict"), "signature", "src_ip", "dst_ip",
        *gapped("src_port"), "dst_port", "protocol", F.unix_micros("flow_time").alias("flow_us")))


def run_summary(spark, sf):
    return views.run_summary(_judged(spark, sf))


def hybrid_detection_query(spark, sf):
    return plain(_judged(spark, sf).select(
        "flow_id", "analysis_id", "final_verdict", "triggered_by", "severity", F.col("ml.probability").alias("probability"),
        F.col("sig.n_alerts").alias("n_alerts"), F.array_join("sig.matched_rules", ";").alias("matched_rules")))


def detections_store(spark, sf):
    """Store all runs, store them again, then read the whole store back."""
    path = _stored(spark, sf, 2)
    return plain(sinks.read_detections(spark, path).select("detection_id", "flow_id", "analysis_id", "triggered_by", "severity"))


def _stored(spark, sf, times: int = 1) -> str:
    judged = materialise(_judged(spark, sf), "judged")
    path = scratch_path(spark, "store")
    for _ in range(times):
        sinks.write_detections(fuse.detection_rows(judged), views.run_summary(judged), path)
    return path


def detection_lookup(spark, sf):
    """The first and the last id of each run, each looked up in the store by id alone, with the summary of its run."""
    path = _stored(spark, sf)
    stored = sinks.read_detections(spark, path)
    ends = stored.groupBy("analysis_id").agg(F.min("detection_id").alias("a"), F.max("detection_id").alias("z")).collect()
    found = [sinks.lookup_detection(stored, i).join(sinks.lookup_run(spark, path, r["analysis_id"]).select("analysis_id", "flow_count"), "analysis_id")
             for r in ends for i in (r["a"], r["z"])]
    rows = reduce(DataFrame.unionByName, found).select("detection_id", "flow_id", "analysis_id", "severity", "flow_count")
    return plain(rows)


# -- views and reports

def _intrusions(spark, sf):
    return _detections(spark, sf).filter("is_intrusion")


def kpi_totals(spark, sf):
    return views.kpi_totals(run_summary(spark, sf))


def kpi_severity(spark, sf):
    return views.kpi_severity(_intrusions(spark, sf))


def kpi_trigger(spark, sf):
    return views.kpi_trigger(_intrusions(spark, sf))


def breakdown_protocol(spark, sf):
    return views.breakdown(_intrusions(spark, sf), "protocol")


def top_src(spark, sf):
    return views.top_talkers(_intrusions(spark, sf), "src_ip")


def top_dst(spark, sf):
    return views.top_talkers(_intrusions(spark, sf), "dst_ip")


def recent_incidents(spark, sf):
    shown = views.display_row(views.recent(_intrusions(spark, sf)))
    return shown.select("detection_id", "source", "destination", "protocol", "triggered_by", "severity")


def activity_series(spark, sf):
    return plain(views.activity_series(_intrusions(spark, sf)).select("detection_id", "confidence"))


def incident_filter(spark, sf):
    kept = views.filter_incidents(_intrusions(spark, sf), "10.0.0.1", "MEDIUM", "BOTH")
    return kept.select("detection_id", "src_ip", "dst_ip", "severity", "triggered_by")


def incident_count(spark, sf):
    return views.shown_of_total(_intrusions(spark, sf), "10.0.0.1", "", "ML")


def _incidents(spark, sf):
    hits = _judged(spark, sf).filter("is_intrusion").withColumn("detection_id", fuse.detection_id())
    return reports.incidents(hits)


def incidents(spark, sf):
    return plain(_incidents(spark, sf).select(
        "detection_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ml_prediction",
        "ml_confidence", "signature_result", map_text(F.col("feature_values")).alias("feature_values"), "severity",
        "triggered_by"))


def incident_report(spark, sf):
    return reports.incident_report(_incidents(spark, sf)).select("detection_id", "report")


def run_report(spark, sf):
    return reports.run_report(run_summary(spark, sf)).select("analysis_id", "report")


def report_rows(spark, sf):
    hits = _judged(spark, sf).filter("is_intrusion").withColumn("detection_id", fuse.detection_id())
    rows = reports.report_rows(reports.incident_report(reports.incidents(hits, ("detection_id", "sig"))))
    return plain(rows.select("detection_id", F.col("ml_analysis.prediction").alias("prediction"),
                             F.col("signature_analysis.matched").alias("matched"),
                             F.col("signature_analysis.signature").alias("signature"),
                             F.length("report").alias("report_length"), *reports.listing_columns()))


# -- attribution and model

def top_features(spark, sf):
    """Fixed attributions f1..f20 per flow, cut to the 15 greatest."""
    def value(j: int) -> Column:
        return F.expr(f"CAST((flow_id * {j} * 31) % 201 - 100 AS DOUBLE) / 100")

    items = F.array(*[F.struct(
        F.format_string("f%02d", F.lit(j)).alias("name"), value(j).alias("contribution"), value(j).alias("value"),
        F.when(value(j) > 0, "attack").otherwise("benign").alias("direction"), F.abs(value(j)).alias("abs_contribution"))
        for j in range(1, 21)])
    top = attribution.top_features(table(spark, sf, "flows").select("flow_id", items.alias("attributions")))
    return plain(top.select("flow_id", F.posexplode(F.arrays_zip("attributions", "share")).alias("position", "a")).select(
        "flow_id", "position", F.col("a.attributions.name").alias("feature"),
        F.col("a.attributions.contribution").alias("contribution"), F.col("a.share").alias("share")))


def _linear(spark, sf):
    flows = table(spark, sf, "flows")
    return attribution.attribute_linear(flows, LINEAR, attribution.feature_means(flows, list(LINEAR)), ["flow_id"])


def attributions_linear(spark, sf):
    return plain(_linear(spark, sf).select("flow_id", F.posexplode("attributions").alias("position", "a")).select(
        "flow_id", "position", F.col("a.name").alias("feature"), F.col("a.contribution").alias("contribution"),
        F.col("a.direction").alias("direction")), {"contribution": 4})


def global_attribution_linear(spark, sf):
    return plain(attribution.mean_absolute(_linear(spark, sf)), {"mean_abs_contribution": 4})


_models: dict[tuple[str, str], tuple[PipelineModel, DataFrame]] = {}


def _trained(spark, sf) -> tuple[PipelineModel, DataFrame]:
    """Model and coded matrix, fitted once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        flows = order.split_stratified(table(spark, sf, "flows"), "flow_id")
        known = encode.fit_encoder(flows.filter("split = 'train'"), ["service", "state"])
        coded = encode.encode(flows, known, ["service", "state"])
        # Kept for the session, so no block of intermediates may own it.
        path = scratch_path(spark, "matrix")
        # A row is small here and costs much to explain, so files are cut by rows: tasks then get equal shares.
        clean.conform_features(coded, MODEL_FEATURES, ["flow_id", "label", "split"]).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        matrix = spark.read.parquet(path)
        fitting = matrix.filter("split <> 'test'").withColumn("is_val", F.col("split") == "validation")
        _models[key] = model.train_model(fitting, MODEL_FEATURES, "label", BOOST, "is_val"), matrix
    return _models[key]


def train_model(spark, sf):
    fitted, matrix = _trained(spark, sf)
    scored = model.score(matrix.filter("split = 'test'"), fitted, MODEL_FEATURES)
    return plain(metrics.binary_metrics(scored))


def score_flows(spark, sf):
    fitted, matrix = _trained(spark, sf)
    return plain(model.score(matrix, fitted, MODEL_FEATURES).select("flow_id", "ml.prediction", "ml.probability"))


def feature_importance(spark, sf):
    fitted, _ = _trained(spark, sf)
    return plain(model.feature_importance(spark, fitted, MODEL_FEATURES))


def attributions(spark, sf):
    fitted, matrix = _trained(spark, sf)
    listed = attribution.attribute(matrix, fitted, MODEL_FEATURES, ["flow_id"])
    return plain(listed.select("flow_id", "base_value", F.posexplode("attributions").alias("position", "a")).select(
        "flow_id", "base_value", "position", F.col("a.name").alias("feature"), F.col("a.contribution").alias("contribution")))


def attributions_add_up(spark, sf):
    """Per flow whether base value and contributions give the log-odds of its score."""
    fitted, matrix = _trained(spark, sf)
    scored = model.score(matrix, fitted, MODEL_FEATURES, None)
    raw = attribution.contributions(scored, fitted, MODEL_FEATURES, ["flow_id", "score"])
    margin = F.col("base_value") + F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    return raw.select("flow_id", (F.abs(1 / (1 + F.exp(-margin)) - F.col("score")) < 1e-9).alias("adds_up"))


def importance_total(spark, sf):
    """Features that the fitted model ranks, and the sum of their importance."""
    fitted, _ = _trained(spark, sf)
    return plain(model.feature_importance(spark, fitted, MODEL_FEATURES, None).agg(
        F.count("*").alias("features"), F.sum("importance").alias("total")))


def global_attribution(spark, sf):
    fitted, matrix = _trained(spark, sf)
    return attribution.global_attribution(matrix, fitted, MODEL_FEATURES)


def _planted(spark, sf) -> DataFrame:
    """Labelled flows with copies: whether one is an attack shows in one feature, so any fitted tree knows it."""
    flows = table(spark, sf, "flows").select(
        "flow_id", F.col("src_ip").alias("srcip"), "service", "state", "spkts", "dpkts", "sttl", (F.col("sbytes") / 7).alias("rate"),
        (F.col("sttl") == 128).cast("int").alias("label"))
    return flows.unionByName(flows.where("flow_id % 3 = 0").withColumn("flow_id", F.col("flow_id") + 10_000_000_000))


PLANTED = pipelines.TrainConfig(boost=model.BoostConfig(trees=3, depth=3, rate=0.5, column_sample=1.0, row_sample=1.0))


def _trained_run(spark, sf) -> str:
    path = scratch_path(spark, "run")
    pipelines.run_training(_planted(spark, sf), profiles.U, "flow_id", PLANTED, path)
    return path


def _outcome(metrics_: DataFrame) -> DataFrame:
    return plain(metrics_.select("accuracy", "f1_score", "roc_auc", "true_negatives", "false_positives", "false_negatives", "true_positives", "total_samples"))


def training_run(spark, sf):
    """A whole training run, as its stored metrics tell: cleaned, split, fitted, evaluated on the test part."""
    return _outcome(spark.read.json(f"{_trained_run(spark, sf)}/metrics"))


def evaluation_run(spark, sf):
    """A saved model evaluated on the test part of the table it was trained on."""
    tables = pipelines.run_evaluation(spark, _planted(spark, sf), profiles.U, "flow_id", _trained_run(spark, sf), PLANTED)
    return _outcome(tables["metrics"])


def csv_flows(spark, sf):
    """Flows written as CSV files of two headers and read back by name, numbered by file and row."""
    rows = table(spark, sf, "flows").select("flow_id", "dur", "service", F.col("sbytes").alias(" Total Length"), F.expr("flow_id div 1000 % 2").alias("half"))
    path = scratch_path(spark, "csv")
    for half, names in ((0, ["flow_id", "dur", "service", " Total Length"]), (1, [" Total Length", "flow_id", "service"])):
        (rows.where(F.col("half") == half).select(*map(q, names)).repartitionByRange("flow_id").sortWithinPartitions("flow_id")
         .write.csv(f"{path}/{half}", header=True))
    types = {"flow_id": T.LongType(), "Total Length": T.LongType(), "dur": T.DoubleType()}
    back = flow_sources.read_flow_csvs(spark, [f"{path}/0", f"{path}/1"], lambda n: types.get(n, T.StringType()), ordinal="ord")
    return back.select("flow_id", "dur", "service", F.col("Total Length").alias("total_length"), "ord")


def csv_charsets(spark, sf):
    """Flows written as UTF-8 and as Latin-1, read back without naming either."""
    rows = table(spark, sf, "flows").select("flow_id", F.concat(F.when(F.col("flow_id") % 3 == 0, "Überfall é ").otherwise("accès "), F.coalesce("service", F.lit("?"))).alias("said"))
    path = scratch_path(spark, "charsets")
    for part, charset in ((0, "UTF-8"), (1, "ISO-8859-1")):
        rows.where(F.col("flow_id") % 2 == part).write.option("encoding", charset).csv(f"{path}/{part}", header=True)
    back = flow_sources.read_flow_csvs(spark, [f"{path}/0", f"{path}/1"], lambda n: T.LongType() if n == "flow_id" else T.StringType())
    return back.select("flow_id", "said")


def headerless_flows(spark, sf):
    """Flows written without names in the default column order, read by position under their pre-split names."""
    flows = table(spark, sf, "flows")
    have = {"srcip": F.col("src_ip"), "dstip": F.col("dst_ip"), "sport": F.col("src_port"), "dsport": F.col("dst_port"), "proto": F.when(F.col("protocol") == 6, "tcp").otherwise("udp"),
            "state": F.col("state"), "service": F.col("service"), "dur": F.col("dur"), "sbytes": F.col("sbytes"), "Spkts": F.col("spkts"), "Dpkts": F.col("dpkts"),
            "stcpb": F.col("flow_id"), "Label": F.col("label")}
    path = scratch_path(spark, "headerless")
    flows.select(*[have.get(n, F.lit(1)).cast("string").alias(f"c{i}") for i, n in enumerate(RAW_U)]).write.csv(path)
    back = flow_sources.presplit_names(flow_sources.read_headerless(spark, [path]))
    return plain(back.select(F.col("stcpb").alias("flow_id"), "srcip", "sport", "proto", "service", "state", "dur", "sbytes", "spkts", "dpkts", F.col("Label").alias("label"),
                             (F.lit(len(back.columns))).alias("width")))


def presplit_flows(spark, sf):
    """The pre-split pair, written with one half of the flows each and read as one table."""
    flows = table(spark, sf, "flows").select(F.col("flow_id").alias("id"), "dur", "service", "spkts", "label")
    path = scratch_path(spark, "presplit")
    for name, part in (("train", 0), ("test", 1)):
        flows.where(F.col("id") % 2 == part).write.csv(f"{path}/{name}", header=True)
    return plain(flow_sources.read_presplit(spark, f"{path}/train", f"{path}/test"))


def flow_results_csv(spark, sf):
    """Per-flow results written as CSV and read back. CSV does not tell an empty list of rules from a missing one."""
    rows, path = flow_results(spark, sf), scratch_path(spark, "results")
    sinks.write_flow_results(rows, path, "csv")
    return spark.read.csv(path, header=True, schema=rows.schema).fillna("", ["signature_rules"])


def metrics_sink(spark, sf):
    """Metrics written as JSON lines and read back."""
    rows, path = class_report(spark, sf), scratch_path(spark, "metrics")
    sinks.write_metrics(rows, path)
    return spark.read.schema(rows.schema).json(path)


def prep_state(spark, sf):
    """What a saved preparation holds: dictionary, medians, features with descriptions."""
    rows, path = _planted(spark, sf).select("service", "state", "spkts", "dpkts", "sttl", "rate"), scratch_path(spark, "state")
    pipelines.fit_state(rows, profiles.U).save(path)
    state = sinks.PrepState.load(spark, path)
    numbers = spark.createDataFrame(sorted(state.medians.items()), "name string, number double").select(F.lit("median").alias("part"), "name", F.lit("").alias("value"), "number")
    features = spark.createDataFrame([(f, state.descriptions.get(f, ""), float(i)) for i, f in enumerate(state.features)], "name string, value string, number double")
    codes = state.encoders.select(F.lit("code"), "column_name", "value", F.col("code").cast("double"))
    return plain(numbers.union(codes).union(features.select(F.lit("feature"), "name", "value", "number")))


def profile_labels(spark, sf):
    """Labels by either profile's own rule, the profile found by its name."""
    whole = table(spark, sf, "flows").select(F.col("flow_id").alias("id"), F.col("label").alias("Label"))
    text = table(spark, sf, "raw_flows").select(F.col("ord").alias("id"), F.col("label_text").alias(" Label"))
    found = [profiles.get_profile(name).label(rows).withColumn("profile", F.lit(name.lower())) for name, rows in (("U", whole), ("c", text))]
    return plain(found[0].unionByName(found[1]).select("profile", "id", "label"))


QUERIES: dict[str, Query] = {
    "hybrid_detection": hybrid_detection_query,
    **{f.__name__: f for f in (
        conform_rename, json_flows, json_rejects, alert_filter, clean_flows, label_binary, impute_median,
        conform_features, coerce_numeric, to_common_u, to_common_c, flow_rates, flow_aliases, flow_metadata,
        attack_sample, union_flows, dedup_exact, dedup_near, fit_medians, label_distribution, profile_missing,
        fit_encoder, encode_categories, packets_to_flows, packets_to_flows_compat, packet_direction, inter_arrival,
        jitter, retransmissions, handshake_times, conn_enrich, http_last, app_counts, conn_window_counts,
        extract_flows_u, split_stratified, split_summary, sample_n, class_weight, binary_metrics, class_report,
        threshold_sweep, threshold_best, roc_curve, roc_auc, pr_curve, pr_auc, compare_detectors, complementarity, flow_results,
        rule_signatures, rules_empty, match_alerts, match_alerts_gravest, verdicts, fuse_verdicts,
        severity_detection, severity_incident, detection_rows, run_summary, detections_store, detection_lookup, training_run, evaluation_run,
        csv_flows, csv_charsets, headerless_flows, presplit_flows, flow_results_csv, metrics_sink, prep_state, profile_labels, kpi_totals,
        kpi_severity, kpi_trigger, breakdown_protocol, top_src, top_dst, recent_incidents, activity_series,
        fit_medians_narrowed, encode_categories_joined, packets_to_flows_blocks, conn_window_counts_blocks,
        attributions_add_up, importance_total, row_number_gaps, metrics_unscored, conn_log_lines, explained_incidents, match_alerts_aliases,
        incident_filter, incident_count, incidents, incident_report, run_report, report_rows, top_features,
        attributions_linear, global_attribution_linear, train_model, score_flows, feature_importance, attributions,
        global_attribution)},
}
