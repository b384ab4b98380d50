"""Connection-log enrichment, flow rates and last-100-connections counters (profile U)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.scalars import count_where, finite, float_columns, numeric_columns, q, ratio
from flowsift.operators.order import global_row_number
from flowsift.operators.packets import packets_to_flows
from flowsift.session import materialise

# IP protocol numbers by the name used in connection logs.
PROTOCOL_IDS = {"tcp": 6, "udp": 17, "icmp": 1}

# The 40 model features of profile U, in model order.
FEATURES_U = [
    "dur", "proto", "service", "state", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl",
    "sload", "dload", "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin", "dwin", "tcprtt",
    "synack", "ackdat", "smean", "dmean", "trans_depth", "response_body_len", "ct_srv_src",
    "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
    "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd", "ct_src_ltm", "ct_srv_dst", "is_sm_ips_ports"]

# Counter name and the columns in which an earlier flow must equal the current one.
COUNTERS = {
    "ct_srv_src": ["service", "src"],
    "ct_dst_ltm": ["dst"],
    "ct_src_dport_ltm": ["src", "dport"],
    "ct_dst_sport_ltm": ["dst", "sport"],
    "ct_dst_src_ltm": ["src", "dst"],
    "ct_src_ltm": ["src"],
    "ct_srv_dst": ["service", "dst"],
    "ct_state_ttl": ["state", "sttl", "dttl"],
}

PACKET_FIELDS = ["sttl", "dttl", "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin", "dwin",
                 "tcprtt", "synack", "ackdat"]


def protocol_id(name: Column) -> Column:
    out = F
    for text, number in PROTOCOL_IDS.items():
        out = out.when(F.lower(name) == text, number)
    return out.otherwise(0)


def last_by(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key, by a combinable maximum instead of a sort."""
    rest = [c for c in df.columns if c not in (key, ordinal)]
    return df.groupBy(q(key)).agg(*[F.max_by(q(c), q(ordinal)).alias(c) for c in rest])


def _said(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def app_counts(http: DataFrame, ftp: DataFrame) -> DataFrame:
    """Application-layer facts per connection id, in one aggregation over both logs.

    Last HTTP row's depth and body length, HTTP rows with a method, FTP rows with a command,
    1 if any FTP row has a user. http has ord, uid, method, trans_depth, response_body_len;
    ftp has uid, command, usr.
    """
    web = http.select("uid", F.col("ord").alias("http_ord"), "trans_depth", "response_body_len",
                      _said("method").alias("method"), F.lit(False).alias("command"), F.lit(False).alias("login"))
    files = ftp.select("uid", _said("command").alias("command"), _said("usr").alias("login"))
    both = web.unionByName(files, allowMissingColumns=True)
    return both.groupBy("uid").agg(
        F.max_by("trans_depth", "http_ord").alias("trans_depth"),
        F.max_by("response_body_len", "http_ord").alias("response_body_len"),
        count_where(F.col("method")).alias("ct_flw_http_mthd"),
        count_where(F.col("command")).alias("ct_ftp_cmd"),
        F.max(F.col("login").cast("int")).alias("is_ftp_login"))


def attach_app_counts(conn: DataFrame, http: DataFrame, ftp: DataFrame) -> DataFrame:
    """Left join of ``app_counts`` on uid; connections without application rows get zeros."""
    names = ["trans_depth", "response_body_len", "ct_flw_http_mthd", "ct_ftp_cmd", "is_ftp_login"]
    joined = conn.join(app_counts(http, ftp), "uid", "left")
    return joined.select(*conn.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def enrich_connections(conn: DataFrame, pktflows: DataFrame) -> DataFrame:
    """Left equi-join of packet flows to the connection log, each field falling back to the log.

    The packet side has one row per flow key, so the join never multiplies connections. A packet
    duration of 0 also falls back. Connections without packets get last time 0.
    """
    pkt = pktflows.select(
        F.col("src").alias("orig_h"), F.col("dst").alias("resp_h"), F.col("sport").alias("orig_p"),
        F.col("dport").alias("resp_p"), F.col("proto").cast("int").alias("proto_id"), F.col("dur").alias("p_dur"),
        *[F.col(c).alias(f"p_{c}") for c in ("spkts", "dpkts", "sbytes", "dbytes", "last_us", *PACKET_FIELDS)])
    joined = (conn.withColumn("proto_id", protocol_id(F.col("proto")))
              .join(pkt, ["orig_h", "resp_h", "orig_p", "resp_p", "proto_id"], "left"))

    def fallback(packet: str, log: str) -> Column:
        return F.coalesce(F.col(packet), F.col(log), F.lit(0)).cast("bigint")

    extra = [c for c in conn.columns if c not in
             ("orig_h", "resp_h", "orig_p", "resp_p", "duration", "proto", "service", "conn_state",
              "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes")]
    return joined.select(
        *extra, F.col("orig_h").alias("src"), F.col("resp_h").alias("dst"),
        F.col("orig_p").alias("sport"), F.col("resp_p").alias("dport"),
        F.coalesce(F.col("p_last_us"), F.lit(0)).alias("last_us"),
        F.when(F.col("p_dur") != 0, F.col("p_dur")).otherwise(F.coalesce("duration", F.lit(0.0))).alias("dur"),
        F.coalesce("proto", F.lit("unknown")).alias("proto"),
        F.coalesce("service", F.lit("-")).alias("service"), F.coalesce("conn_state", F.lit("-")).alias("state"),
        fallback("p_spkts", "orig_pkts").alias("spkts"), fallback("p_dpkts", "resp_pkts").alias("dpkts"),
        fallback("p_sbytes", "orig_ip_bytes").alias("sbytes"), fallback("p_dbytes", "resp_ip_bytes").alias("dbytes"),
        *[F.coalesce(F.col(f"p_{c}"), F.lit(0)).alias(c) for c in PACKET_FIELDS])


def derive_rates(df: DataFrame) -> DataFrame:
    """Mean sizes (cut to whole bytes), packet rate, loads in bits/s, same-endpoint flag.

    Every quotient is 0 where its denominator is not positive.
    """
    return (df
            .withColumn("smean", ratio(F.col("sbytes"), F.col("spkts")).cast("bigint"))
            .withColumn("dmean", ratio(F.col("dbytes"), F.col("dpkts")).cast("bigint"))
            .withColumn("rate", ratio(F.col("spkts") + F.col("dpkts"), F.col("dur")))
            .withColumn("sload", ratio(F.col("sbytes") * 8, F.col("dur")))
            .withColumn("dload", ratio(F.col("dbytes") * 8, F.col("dur")))
            .withColumn("is_sm_ips_ports", F.coalesce(
                (F.col("src").eqNullSafe(F.col("dst")) & F.col("sport").eqNullSafe(F.col("dport"))).cast("int"),
                F.lit(0))))


def conn_window_counts(flows: DataFrame, key: str, ordinal: str, size: int = 100, block: int = 20_000,
                       counters: dict[str, list[str]] | None = None) -> DataFrame:
    """Eight counts of equal flows among the current and the ``size`` - 1 flows before it.

    Flows are numbered in global (time, ordinal) order and cut into blocks; the last size - 1
    rows of a block are copied to the next one. One shuffle by block then serves all windows,
    because (block, columns) groups lie inside a block. No source, service or address, however
    frequent, is a shuffle key.
    """
    if block < size - 1:
        raise ValueError("a block must hold at least size - 1 rows")
    numbered = global_row_number(flows, key, ordinal, "rn")
    home = F.expr(f"(rn - 1) div {block}")
    reach = F.expr(f"(rn + {size - 2}) div {block}")
    copies = (numbered.withColumn("_home", home)
              .withColumn("_block", F.explode(F.when(reach > home, F.array(home, home + 1)).otherwise(F.array(home)))))
    copies = copies.repartition("_block")
    for name, cols in (counters or COUNTERS).items():
        near = (Window.partitionBy("_block", *[q(c) for c in cols]).orderBy("rn").rangeBetween(-(size - 1), 0))
        copies = copies.withColumn(name, F.count(F.lit(1)).over(near))
    return copies.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")


def finalise_u(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 40 model features in order, NaN and infinities as 0; an error lists what is missing."""
    missing = [f for f in FEATURES_U if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    floats, numbers = set(float_columns(df)), set(numeric_columns(df))

    def clean(name: str) -> Column:
        if name in floats:
            return F.coalesce(finite(q(name)), F.lit(0.0)).alias(name)
        return F.coalesce(q(name), F.lit(0)).alias(name) if name in numbers else q(name)

    return df.select(*(keep or []), *[clean(f) for f in FEATURES_U])


def extract_u(tables: dict[str, DataFrame], compat: bool = False) -> DataFrame:
    """Profile U extractor: packets and conn/http/ftp logs to the 40 features plus flow ends.

    ``conn`` needs an ordinal ``ord`` for ties between equal last times.
    """
    logged = attach_app_counts(tables["conn"], tables["http"], tables["ftp"])
    flows = derive_rates(enrich_connections(logged, packets_to_flows(tables["packets"], compat)))
    # The counters read their input three times (borders, sizes, rows): write it once.
    counted = conn_window_counts(materialise(flows, "flows"), "last_us", "ord")
    ends = counted.withColumns({
        "flow_id": F.col("ord"), "src_ip": F.col("src"), "dst_ip": F.col("dst"), "src_port": F.col("sport"),
        "dst_port": F.col("dport"), "protocol": F.col("proto"), "timestamp": F.col("last_us") / 1e6})
    return finalise_u(ends, ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp"])


def extractors() -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """Flow extractor per profile: a function from named input tables to a flow table."""
    from flowsift.sources.flows import conform_exporter

    return {"u": extract_u, "c": lambda tables: conform_exporter(tables["exporter"])}
