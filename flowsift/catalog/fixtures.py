"""Flow, packet, log and alert tables derived from the driver's ``events`` table.

The views are SQL text valid in Spark and in DuckDB up to a few tokens, so that both engines
read the same rows. ``event_id`` is unique and increases with time; it is the ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsift.session import scratch_path

VIEWS = {
    "ev": """
SELECT event_id, user_id, event_type, value, {US} AS us, {K} AS k FROM {EVENTS}""",
    "flows": """
SELECT event_id AS flow_id, us AS last_us,
 concat('10.0.0.', CAST(user_id % 40 AS {STR})) AS src_ip,
 concat('192.168.1.', CAST(k % 12 AS {STR})) AS dst_ip,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(40000 + event_id % 50 AS INT) END AS src_port,
 CASE k % 8 WHEN 0 THEN 445 WHEN 1 THEN 23 WHEN 2 THEN 21 WHEN 3 THEN 80 WHEN 4 THEN 53 ELSE 443 END AS dst_port,
 CASE WHEN event_id % 5 = 0 THEN 17 ELSE 6 END AS protocol,
 CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS service,
 CASE k % 4 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' ELSE 'REJ' END AS state,
 CAST(floor(value * 10) AS BIGINT) AS spkts, k AS dpkts,
 CAST(floor(value * 100) AS BIGINT) AS sbytes, k * 60 AS dbytes,
 CASE WHEN k % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(k AS DOUBLE) / 4 END AS dur,
 CASE WHEN k % 2 = 0 THEN 64 ELSE 128 END AS sttl, CASE WHEN k % 3 = 0 THEN 0 ELSE 252 END AS dttl,
 CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score,
 CASE WHEN (event_id * 7919) % 1000 + k * 5 > 700 THEN 1 ELSE 0 END AS label,
 concat('run-', CAST(event_id % 4 AS {STR})) AS analysis_id
FROM ev""",
    "alerts": """
SELECT flow_id AS alert_ord,
 CASE WHEN flow_id % 2 = 0 THEN src_ip ELSE dst_ip END AS src_ip,
 CASE WHEN flow_id % 2 = 0 THEN dst_ip ELSE src_ip END AS dst_ip,
 CASE WHEN flow_id % 2 = 0 THEN src_port ELSE dst_port END AS src_port,
 CASE WHEN flow_id % 2 = 0 THEN dst_port ELSE src_port END AS dst_port,
 concat('RULE-', CAST(flow_id % 9 AS {STR})) AS signature,
 2000000 + flow_id % 9 AS signature_id, 1 + flow_id % 3 AS severity
FROM flows WHERE flow_id % 23 = 0 AND src_port IS NOT NULL""",
    "packets": """
SELECT event_id AS ord, us,
 concat('h', CAST(user_id % 30 AS {STR})) AS src, concat('h', CAST(k % 30 AS {STR})) AS dst,
 CAST(CASE WHEN event_id % 8 = 0 THEN 5000 ELSE 1000 END + user_id % 30 AS INT) AS sport,
 CAST(1000 + k % 30 AS INT) AS dport,
 CASE WHEN (user_id % 30 + k % 30) % 4 = 0 THEN 17 ELSE 6 END AS proto,
 CASE WHEN k % 5 = 0 THEN 0 ELSE 64 END AS ttl, CAST(40 + floor(value) AS INT) AS len,
 (user_id % 30 + k % 30) % 4 <> 0 AS is_tcp,
 CASE WHEN (user_id % 30 + k % 30) % 4 = 0 THEN NULL WHEN k % 7 = 0 THEN 0 ELSE 500 END AS win,
 CASE WHEN (user_id % 30 + k % 30) % 4 = 0 THEN NULL ELSE event_id % 7 END AS seq,
 CASE WHEN (user_id % 30 + k % 30) % 4 = 0 THEN NULL
  ELSE CASE event_type WHEN 'signup' THEN 'S' WHEN 'click' THEN 'SA'
   WHEN 'view' THEN 'A' WHEN 'purchase' THEN 'PA' ELSE 'FA' END END AS flags,
 CASE WHEN (user_id % 30 + k % 30) % 4 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 0 ELSE 10 END AS payload_len
FROM ev""",
    "conn": """
SELECT ord, concat('C', CAST(ord AS {STR})) AS uid, src AS orig_h, dst AS resp_h, sport AS orig_p, dport AS resp_p,
 CAST(ord % 13 AS DOUBLE) AS duration, CASE WHEN proto = 6 THEN 'tcp' ELSE 'UDP' END AS proto,
 CASE WHEN ord % 4 = 0 THEN 'http' WHEN ord % 4 = 1 THEN 'ftp' ELSE NULL END AS service,
 CASE WHEN ord % 2 = 0 THEN 'SF' ELSE 'S0' END AS conn_state,
 ord % 17 AS orig_pkts, ord % 19 AS resp_pkts, ord % 1009 AS orig_ip_bytes, ord % 1013 AS resp_ip_bytes
FROM packets WHERE ord % 3 = 0""",
    "http": """
SELECT event_id AS ord, concat('C', CAST(event_id - event_id % 12 AS {STR})) AS uid,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'GET' END AS method,
 CAST(k % 6 AS INT) AS trans_depth, k * 10 AS response_body_len
FROM ev WHERE event_type = 'view'""",
    "ftp": """
SELECT event_id AS ord, concat('C', CAST(event_id - event_id % 9 AS {STR})) AS uid,
 CASE WHEN k % 2 = 0 THEN 'RETR' ELSE NULL END AS command, CASE WHEN k % 3 = 0 THEN 'bob' ELSE NULL END AS usr
FROM ev WHERE event_type = 'purchase'""",
    "raw_flows": """
SELECT event_id AS ord, CAST(k AS DOUBLE) AS flow_duration,
 CASE k % 10 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN NULL
  ELSE CAST(k AS DOUBLE) / 8 + CAST(event_id % 3 AS DOUBLE) / 1000000 END AS flow_bytes_s,
 user_id % 4 AS fwd_packets,
 CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto,
 CASE WHEN user_id % 9 = 0 THEN 'abc' ELSE CAST(k AS {STR}) END AS text_num,
 CASE event_type WHEN 'signup' THEN ' BENIGN ' WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'DoS Hulk'
  WHEN 'error' THEN 'PortScan' ELSE NULL END AS label_text
FROM ev""",
    "alert_json": """
SELECT event_id AS ord, CASE
 WHEN event_id % 11 = 0 THEN 'not json'
 WHEN event_id % 7 = 0 THEN '{{"event_type":"flow"}}'
 WHEN event_id % 5 = 0 THEN '{{"event_type":"alert","src_ip":"a","alert":{{"signature":"X Invalid Checksum","signature_id":1,"severity":3}}}}'
 ELSE concat('{{"event_type":"alert","src_ip":"10.0.0.', CAST(user_id % 40 AS {STR}), '","alert":{{"signature":"R","signature_id":', CAST(k AS {STR}), '}}}}') END AS line
FROM ev""",
}

NEEDS = {
    "ev": [], "flows": ["ev"], "alerts": ["ev", "flows"], "packets": ["ev"],
    "conn": ["ev", "packets"], "http": ["ev"], "ftp": ["ev"], "raw_flows": ["ev"], "alert_json": ["ev"],
}

DUCKDB = {"K": "CAST(json_extract(props,'$.k') AS BIGINT)", "US": "epoch_us(ts)", "STR": "VARCHAR",
          "EVENTS": "events"}


def _spark_tokens(sf_dir: str) -> dict[str, str]:
    return {"K": "CAST(get_json_object(props,'$.k') AS BIGINT)", "US": "unix_micros(CAST(ts AS TIMESTAMP))",
            "STR": "STRING", "EVENTS": f"parquet.`{sf_dir}/events.parquet`"}


def _with(names: list[str], tokens: dict[str, str]) -> str:
    wanted: list[str] = []
    for name in names:
        for view in [*NEEDS[name], name]:
            if view not in wanted:
                wanted.append(view)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].format(**tokens)})" for v in wanted)


def ctes(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they need) for DuckDB."""
    return _with(list(names), DUCKDB)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_with([name], _spark_tokens(sf_dir)) + f"\nSELECT * FROM {name}")


_staged: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a Parquet table in the shared folder, written once per application.

    Operators then read plain columns, as they would from a real flow table, instead of
    repeating the JSON parsing behind every derived column.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        path = scratch_path(spark, f"fixture-{name}")
        rows = view(spark, sf_dir, name)
        rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
        _staged[key] = path
    return spark.read.parquet(_staged[key])
