"""Summaries, rankings and filters over detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalars import count_where, q


def run_summary(df: DataFrame, analysis_id: str = "analysis_id", dataset: str | None = None) -> DataFrame:
    """One row per run: flows, intrusions, hits per detector, split by trigger, verdict.

    Needs is_intrusion, triggered_by. ``dataset`` names the column that says which data set a run read;
    a run that read several has them comma-joined.
    """
    named = [] if dataset is None else [F.array_join(F.sort_array(F.collect_set(q(dataset))), ", ").alias("dataset")]
    trigger = F.col("triggered_by")
    ml, sig = trigger.isin("ML", "BOTH"), trigger.isin("SIGNATURE", "BOTH")
    return df.groupBy(q(analysis_id).alias("analysis_id")).agg(
        F.count("*").alias("flow_count"), count_where(F.col("is_intrusion")).alias("total_intrusions"),
        count_where(ml).alias("ml_attacks"), count_where(sig).alias("signature_alerts"),
        count_where(ml & ~sig).alias("ml_only"), count_where(sig & ~ml).alias("sig_only"),
        count_where(ml & sig).alias("hybrid"),
        F.when(F.max(F.col("is_intrusion").cast("int")) == 1, "MALICIOUS").otherwise("BENIGN").alias("verdict"), *named)


def kpi_totals(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.count("*").alias("runs"), F.coalesce(F.sum("flow_count"), F.lit(0)).alias("flows"),
                         F.coalesce(F.sum("total_intrusions"), F.lit(0)).alias("intrusions"))


def kpi_severity(intrusions: DataFrame) -> DataFrame:
    """Intrusions per severity; anything that is not CRITICAL, HIGH or MEDIUM counts as LOW."""
    known = F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM")
    bucket = F.when(known, F.col("severity")).otherwise("LOW")
    return intrusions.groupBy(bucket.alias("severity")).agg(F.count("*").alias("n"))


def kpi_trigger(intrusions: DataFrame) -> DataFrame:
    return (intrusions.filter(F.col("triggered_by").isin("ML", "SIGNATURE", "BOTH"))
            .groupBy("triggered_by").agg(F.count("*").alias("n")))


def breakdown(df: DataFrame, column: str, unknown: str = "Unknown") -> DataFrame:
    """Rows per value, most frequent first; missing and empty values count as ``unknown``."""
    text = q(column).cast("string")
    value = F.when(text.isNull() | (text == ""), unknown).otherwise(text)
    return df.groupBy(value.alias(column)).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def top_talkers(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return (df.groupBy(q(column).alias(column)).agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), q(column)).limit(n))


def _end_point(ip: str, port: str) -> Column:
    number = q(port).cast("string")
    shown = F.when(number.isNull() | number.isin("0", ""), "*").otherwise(number)
    return F.concat_ws(":", F.coalesce(q(ip), F.lit("unknown")), shown)


def display_row(df: DataFrame) -> DataFrame:
    """Columns of the incident list: ends as ip:port with * for no port, TCP for no protocol."""
    protocol = F.col("protocol").cast("string")
    return df.select(
        "detection_id", F.col("flow_time"), _end_point("src_ip", "src_port").alias("source"),
        _end_point("dst_ip", "dst_port").alias("destination"),
        F.when(protocol.isNull() | protocol.isin("", "0"), "TCP").otherwise(protocol).alias("protocol"),
        "triggered_by", "severity")


def recent(df: DataFrame, n: int = 8, time: str = "flow_time", tie: str = "detection_id") -> DataFrame:
    """The newest n rows."""
    return df.orderBy(q(time).desc_nulls_last(), q(tie)).limit(n)


def activity_series(df: DataFrame, n: int = 30, time: str = "flow_time", tie: str = "detection_id") -> DataFrame:
    """Confidence of the newest n rows, oldest first; a missing or zero confidence shows as 1."""
    value = F.col("ml_confidence")
    return (recent(df, n, time, tie)
            .select(q(time).alias("flow_time"), q(tie).alias("detection_id"),
                    F.when(value.isNull() | (value == 0), 1.0).otherwise(value).alias("confidence"))
            .orderBy(F.col("flow_time").asc_nulls_first(), F.col("detection_id").desc()))


def _criteria(search: str, severity: str, trigger: str) -> Column:
    keep = F.lit(True)
    if search:
        text = search.lower()
        hits = [F.lower(F.coalesce(c, F.lit(""))).contains(text) for c in ("src_ip", "dst_ip")]
        keep = keep & (hits[0] | hits[1])
    if severity:
        keep = keep & (F.col("severity") == severity)
    return keep & (F.col("triggered_by") == trigger) if trigger else keep


def filter_incidents(df: DataFrame, search: str = "", severity: str = "", trigger: str = "") -> DataFrame:
    """Rows whose source or destination address contains ``search`` and whose severity and
    trigger equal the given ones; an empty criterion does not filter."""
    return df.filter(_criteria(search, severity, trigger))


def shown_of_total(df: DataFrame, search: str = "", severity: str = "", trigger: str = "") -> DataFrame:
    """How many rows the filter keeps, and of how many, in one pass."""
    return df.agg(count_where(_criteria(search, severity, trigger)).alias("shown"), F.count("*").alias("total"))
