"""Field aliases, verdicts, fusion of the two detectors, severity and detection rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalars import q, scored
from flowsift.functions.severity import band_rank, name_of, probability_band, rank
from flowsift.operators.alerts import first_rule

# Field, the other name it may have, and the value where both are absent.
ALIASES = [
    ("src_ip", "source_ip", "unknown"),
    ("dst_ip", "destination_ip", "unknown"),
    ("src_port", "source_port", 0),
    ("dst_port", "destination_port", 0),
    ("protocol", "proto", "unknown"),
    ("fwd_packet_count", "total_fwd_packets", 0),
]

# Keys of the flow metadata map.
METADATA_KEYS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                 "source_ip", "destination_ip", "source_port", "destination_port"]

# Address columns left out of the feature-value map.
ADDRESS_KEYS = ["src_ip", "dst_ip", "source_ip", "destination_ip"]

# Decision thresholds per profile.
THRESHOLDS = {"u": 0.50, "c": 0.75}
DEFAULT_THRESHOLD = 0.5


def with_aliases(df: DataFrame, **defaults) -> DataFrame:
    """Add absent fields from their alias, else their default. A NULL in a field that exists
    stays: only absence falls back."""
    have = set(df.columns)
    added = [(q(alias) if alias in have else F.lit(defaults.get(name, default))).alias(name)
             for name, alias, default in ALIASES if name not in have]
    return df.select("*", *added) if added else df


def _text_map(df: DataFrame, names: list[str]) -> Column:
    pairs = [c for n in names for c in (F.lit(n), q(n).cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def flow_metadata(df: DataFrame) -> DataFrame:
    """Add ``flow_metadata``: end points and protocol under the names the flow has."""
    return df.withColumn("flow_metadata", _text_map(df, [k for k in METADATA_KEYS if k in df.columns]))


def feature_values(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """Add ``feature_values``: every plain column but the addresses, as text."""
    names = [n for n, t in df.dtypes if n not in ADDRESS_KEYS and n not in but
             and not t.startswith(("struct", "array", "map"))]
    return df.withColumn("feature_values", _text_map(df, names))


def threshold_for(profile: str | None, thresholds: float | dict[str, float] | None = None) -> float:
    """Threshold of a profile from one number or a map with an optional ``default``."""
    table = THRESHOLDS if thresholds is None else thresholds
    if not isinstance(table, dict):
        return float(table)
    return float(table.get((profile or "").lower(), table.get("default", DEFAULT_THRESHOLD)))


def threshold_column(profile: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Threshold of each row's profile."""
    table = THRESHOLDS if thresholds is None else thresholds
    out = F
    for name, value in table.items():
        if name != "default":
            out = out.when(F.lower(profile) == name, float(value))
    return out.otherwise(float(table.get("default", DEFAULT_THRESHOLD)))


def verdicts(df: DataFrame, score: str, threshold: Column | float) -> DataFrame:
    """Add ``ml``: the unrounded probability is compared, the reported one has 6 decimals.
    A missing score and NaN are BENIGN."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    value = scored(q(score))
    attack = F.coalesce(value >= limit, F.lit(False))
    return df.withColumn("ml", F.struct(
        F.when(attack, "ATTACK").otherwise("BENIGN").alias("prediction"),
        (F.rint(value * 1e6) / 1e6).alias("probability"), limit.cast("double").alias("threshold"),
        attack.alias("is_intrusion")))


def fuse(df: DataFrame) -> DataFrame:
    """Add is_intrusion, triggered_by and final_verdict: an intrusion if either detector says so.

    A missing signature result (no ``sig`` column, or NULL) counts as no match.
    """
    ml = F.coalesce(F.col("ml.is_intrusion"), F.lit(False))
    sig = F.coalesce(F.col("sig.is_intrusion"), F.lit(False)) if "sig" in df.columns else F.lit(False)
    return (df.withColumn("is_intrusion", ml | sig)
            .withColumn("triggered_by", F.when(ml & sig, "BOTH").when(ml, "ML").when(sig, "SIGNATURE").otherwise("NONE"))
            .withColumn("final_verdict", F.when(ml | sig, "INTRUSION").otherwise("BENIGN")))


def severity_detection(df: DataFrame) -> DataFrame:
    """Add ``severity`` of a detection: LOW unless an intrusion; the signature's severity if it
    fired, else the band of the probability."""
    named = F.upper(F.col("sig.severity")) if "sig" in df.columns else F.lit(None).cast("string")
    has_sig = F.coalesce((named != "NONE") & (named != ""), F.lit(False))
    return df.withColumn("severity", F.when(~F.col("is_intrusion"), "LOW").when(has_sig, named)
                         .otherwise(probability_band(F.col("ml.probability"))))


def severity_incident(df: DataFrame, out: str = "incident_severity") -> DataFrame:
    """Add the severity of an incident: the graver of probability band and signature severity."""
    band = band_rank(F.col("ml.probability"))
    sig = rank(F.col("sig.severity")) if "sig" in df.columns else F.lit(1)
    return df.withColumn(out, name_of(F.greatest(band, sig)))


def detection_id(flow_id: str = "flow_id", analysis_id: str = "analysis_id") -> Column:
    """Id of a detection: a hash of run and flow. All 128 bits are kept, as 8 hex digits would
    repeat after some ten thousand rows."""
    return F.concat(F.lit("det-"), F.md5(F.concat_ws(":", q(analysis_id), q(flow_id).cast("string"))))


def detection_rows(df: DataFrame, flow_id: str = "flow_id", analysis_id: str = "analysis_id") -> DataFrame:
    """One detection per flow, with nested verdicts and the flat columns older readers use."""
    aliased = with_aliases(df)
    signature = F.when(F.col("is_intrusion") & (F.col("sig.severity") != "NONE"), first_rule(F.col("sig.matched_rules")))
    signature = F.coalesce(signature, F.lit(""))
    when = F.timestamp_micros(F.col("last_us")) if "last_us" in df.columns else F.lit(None).cast("timestamp")
    return aliased.select(
        detection_id(flow_id, analysis_id).alias("detection_id"),
        q(analysis_id).alias("analysis_id"), q(flow_id).alias("flow_id"),
        "is_intrusion", "final_verdict", "triggered_by", "severity",
        F.struct(F.col("ml.prediction").alias("verdict"), "ml.prediction", F.col("ml.probability").alias("confidence"))
        .alias("ml_result"),
        F.struct(F.when(F.col("sig.is_intrusion"), "ALERT").otherwise("BENIGN").alias("verdict"),
                 signature.alias("signature"), F.coalesce(F.col("sig.severity"), F.lit("NONE")).alias("severity"))
        .alias("signature_result"),
        F.col("ml.prediction").alias("ml_prediction"), F.col("ml.probability").alias("ml_confidence"),
        signature.alias("signature"), "src_ip", "dst_ip", "src_port", "dst_port",
        F.col("protocol").cast("string").alias("protocol"), when.alias("flow_time"))
