"""DuckDB SQL for the query catalog, over the same derived tables.

Each text states the result directly (one OR-join, plain global windows, per-row counting),
not the way the Spark operator reaches it.
"""

from __future__ import annotations

from flowsift.catalog.fixtures import ctes
from flowsift.functions.severity import BANDS, RANKS
from flowsift.operators.common_schema import COMMON, SOURCES, descriptions_of
from flowsift.operators.connections import COUNTERS
from flowsift.operators.metrics import SWEEP
from flowsift.sources.schemas import EXPORTER


def r(expr: str, n: int = 6) -> str:
    """Round half to even by the formula the queries use."""
    return f"round_even(({expr}) * {10 ** n}.0::DOUBLE, 0) / {10 ** n}.0::DOUBLE"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den})::DOUBLE ELSE 0.0::DOUBLE END"


def wide(names: list[str]) -> str:
    cells = ", ".join(f'CAST((event_id * {j + 2}) % 97 AS DOUBLE) AS "{n}"' for j, n in enumerate(names, 1))
    return ctes("ev") + f", wide AS (SELECT event_id, {cells} FROM ev)"


def common(profile: str) -> str:
    cells = []
    for n in COMMON:
        source = SOURCES[profile].get(n)
        cells.append(f'"{source}" AS {n}' if source else f"0::BIGINT AS {n}")
    if profile == "u":
        extra = {"byte_rate": r("(sload + dload) / 8"), "flow_iat_mean": r("(sinpkt + dinpkt) / 2")}
        cells = [f"{extra[n]} AS {n}" if n in extra else c for n, c in zip(COMMON, cells)]
    return wide(list(SOURCES[profile].values())) + " SELECT event_id, " + ", ".join(cells) + " FROM wide"


def finite(c: str) -> str:
    return f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"


BAND = "CASE " + " ".join(f"WHEN {{p}} >= {low} THEN '{name}'" for low, name in BANDS) + " ELSE 'LOW' END"
RANK = "CASE {s} " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in RANKS.items()) + " ELSE 1 END"
NAME = "CASE {n} " + " ".join(f"WHEN {n} THEN '{name}'" for name, n in RANKS.items()) + " END"


def band(p: str) -> str:
    return BAND.replace("{p}", p)


def rank(s: str) -> str:
    return RANK.replace("{s}", s)


# -- packets: first-seen direction, then plain windows over whole flows

PACKETS = ctes("packets") + """,
sides AS (SELECT *, CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN src ELSE dst END AS lo_ip,
  CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN sport ELSE dport END AS lo_port,
  CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN dst ELSE src END AS hi_ip,
  CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN dport ELSE sport END AS hi_port FROM packets),
firsts AS (SELECT *, first_value(src) OVER w AS f_src, first_value(dst) OVER w AS f_dst,
  first_value(sport) OVER w AS f_sport, first_value(dport) OVER w AS f_dport, row_number() OVER w AS nth
  FROM sides WINDOW w AS (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, proto ORDER BY ord)),
directed AS (SELECT *, CASE WHEN src = dst AND sport = dport THEN nth = 1 ELSE src = f_src AND sport = f_sport END AS fwd
  FROM firsts),
gaps AS (SELECT *, us - lag(us) OVER v AS gap,
  row_number() OVER (PARTITION BY f_src, f_dst, f_sport, f_dport, proto, fwd, is_tcp, seq ORDER BY ord) AS seq_nth
  FROM directed WINDOW v AS (PARTITION BY f_src, f_dst, f_sport, f_dport, proto, fwd ORDER BY ord)),
bends AS (SELECT *, abs(gap - lag(gap) OVER v) AS bend,
  min(CASE WHEN NOT fwd AND is_tcp AND contains(flags, 'S') AND contains(flags, 'A') THEN ord END)
   OVER (PARTITION BY f_src, f_dst, f_sport, f_dport, proto) AS sa_ord
  FROM gaps WINDOW v AS (PARTITION BY f_src, f_dst, f_sport, f_dport, proto, fwd ORDER BY ord)),
flow0 AS (SELECT f_src AS src, f_dst AS dst, f_sport AS sport, f_dport AS dport, proto,
  count(*) FILTER (fwd) AS spkts, count(*) FILTER (NOT fwd) AS dpkts,
  coalesce(sum(len) FILTER (fwd), 0)::BIGINT AS sbytes, coalesce(sum(len) FILTER (NOT fwd), 0)::BIGINT AS dbytes,
  min_by(us, ord) FILTER (fwd) AS s_first, max_by(us, ord) FILTER (fwd) AS s_last,
  min_by(us, ord) FILTER (NOT fwd) AS d_first, max_by(us, ord) FILTER (NOT fwd) AS d_last,
  min_by(ttl, ord) FILTER (fwd) AS sttl, coalesce(min_by(ttl, ord) FILTER (NOT fwd AND ttl <> 0), 0) AS dttl,
  coalesce(min_by(CASE WHEN is_tcp THEN win ELSE 0 END, ord) FILTER (fwd), 0) AS swin,
  coalesce(min_by(win, ord) FILTER (NOT fwd AND is_tcp AND win <> 0), 0) AS dwin,
  count(*) FILTER (fwd AND is_tcp AND payload_len > 0 AND seq_nth > 1) AS sloss,
  count(*) FILTER (NOT fwd AND is_tcp AND payload_len > 0 AND seq_nth > 1) AS dloss,
  avg(gap) FILTER (fwd) AS s_gap, avg(gap) FILTER (NOT fwd) AS d_gap,
  avg(bend) FILTER (fwd) AS s_bend, avg(bend) FILTER (NOT fwd) AS d_bend,
  min_by(us, ord) FILTER (fwd AND is_tcp AND contains(flags, 'S') AND NOT contains(flags, 'A')) AS syn_us,
  min_by(us, ord) FILTER (ord = sa_ord) AS synack_us,
  min_by(us, ord) FILTER (fwd AND is_tcp AND contains(flags, 'A') AND NOT contains(flags, 'S') AND ord > sa_ord) AS ack_us
  FROM bends GROUP BY 1, 2, 3, 4, 5),
pflow AS (SELECT *, greatest(coalesce((synack_us - syn_us) / 1e6, 0), 0) AS synack,
  greatest(coalesce((ack_us - synack_us) / 1e6, 0), 0) AS ackdat,
  greatest(s_last, d_last) AS last_us FROM flow0)"""

ENDS = "src, dst, sport::BIGINT AS sport, dport::BIGINT AS dport, proto::BIGINT AS proto"
DUR = "greatest((greatest(s_last, d_last) - least(s_first, d_first)) / 1e6, 0)"
DUR_COMPAT = "greatest((greatest(s_last, coalesce(d_last, 0)) - least(s_first, coalesce(d_first, 0))) / 1e6, 0)"

# -- detection: alerts by one OR-join, then listed per flow

MATCHED = ctes("alerts") + """,
pairs AS (SELECT f.flow_id, a.alert_ord, a.signature_id, a.signature, a.severity FROM flows f JOIN alerts a ON
  ((f.src_ip IS NULL OR f.src_ip = a.src_ip) AND (f.dst_ip IS NULL OR f.dst_ip = a.dst_ip)
   AND (f.src_port IS NULL OR f.src_port = a.src_port) AND (f.dst_port IS NULL OR f.dst_port = a.dst_port))
  OR ((f.src_ip IS NULL OR f.src_ip = a.dst_ip) AND (f.dst_ip IS NULL OR f.dst_ip = a.src_ip)
   AND (f.src_port IS NULL OR f.src_port = a.dst_port) AND (f.dst_port IS NULL OR f.dst_port = a.src_port))),
per_rule AS (SELECT flow_id, signature_id, signature, count(*) AS hits, min(alert_ord) AS first_ord,
  max(severity) AS max_sev, min(severity) AS min_sev FROM pairs GROUP BY 1, 2, 3),
hits AS (SELECT flow_id, string_agg(concat('SID-', signature_id, ': ', signature), ';' ORDER BY first_ord) AS matched_rules,
  string_agg(concat('SID-', signature_id, ': ', signature), ' | ' ORDER BY first_ord) AS barred_rules,
  string_agg(hits::VARCHAR, ';' ORDER BY first_ord) AS rule_hits, sum(hits)::BIGINT AS n_alerts,
  min_by(concat('SID-', signature_id, ': ', signature), first_ord) AS first_rule,
  string_agg(concat(signature, ' (SID ', signature_id, ')'), ', ' ORDER BY first_ord) AS details,
  max(max_sev) AS max_sev, min(min_sev) AS min_sev FROM per_rule GROUP BY 1),
sig AS (SELECT f.flow_id, h.flow_id IS NOT NULL AS fired, coalesce(h.matched_rules, '') AS matched_rules,
  coalesce(h.barred_rules, '') AS barred_rules, coalesce(h.rule_hits, '') AS rule_hits, coalesce(h.n_alerts, 0) AS n_alerts,
  h.first_rule, coalesce(h.details, 'no matching alert') AS details,
  CASE WHEN h.flow_id IS NULL THEN 'NONE' WHEN max_sev = 1 THEN 'CRITICAL' WHEN max_sev = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS sig_severity,
  CASE WHEN h.flow_id IS NULL THEN 'NONE' WHEN min_sev = 1 THEN 'CRITICAL' WHEN min_sev = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS gravest
  FROM flows f LEFT JOIN hits h USING (flow_id))"""

JUDGED = MATCHED + f""",
judged0 AS (SELECT f.*, s.* EXCLUDE (flow_id), score >= 0.5 AS ml_flag FROM flows f JOIN sig s USING (flow_id)),
judged AS (SELECT *, ml_flag OR fired AS is_intrusion,
  CASE WHEN ml_flag AND fired THEN 'BOTH' WHEN ml_flag THEN 'ML' WHEN fired THEN 'SIGNATURE' ELSE 'NONE' END AS triggered_by,
  CASE WHEN ml_flag OR fired THEN 'INTRUSION' ELSE 'BENIGN' END AS final_verdict,
  CASE WHEN NOT (ml_flag OR fired) THEN 'LOW' WHEN fired THEN sig_severity ELSE {band('score')} END AS severity,
  concat('det-', md5(concat(analysis_id, ':', flow_id::VARCHAR))) AS detection_id,
  CASE WHEN fired THEN first_rule ELSE '' END AS signature FROM judged0),
hit AS (SELECT * FROM judged WHERE is_intrusion)"""

SUMMARY = JUDGED + """,
summary AS (SELECT analysis_id, count(*) AS flow_count, count(*) FILTER (is_intrusion) AS total_intrusions,
  count(*) FILTER (ml_flag) AS ml_attacks, count(*) FILTER (fired) AS signature_alerts,
  count(*) FILTER (ml_flag AND NOT fired) AS ml_only, count(*) FILTER (fired AND NOT ml_flag) AS sig_only,
  count(*) FILTER (ml_flag AND fired) AS hybrid,
  CASE WHEN bool_or(is_intrusion) THEN 'MALICIOUS' ELSE 'BENIGN' END AS verdict FROM judged GROUP BY 1)"""

FEATURE_NAMES = ["analysis_id", "dbytes", "dpkts", "dst_port", "dttl", "dur", "flow_id", "label", "last_us", "protocol",
                 "sbytes", "service", "spkts", "src_port", "state", "sttl"]
FEATURE_TEXT = "concat_ws(';', " + ", ".join(f"concat('{n}=', coalesce({n}::VARCHAR, 'null'))" for n in FEATURE_NAMES) + ")"

INCIDENT = JUDGED + f""",
incident AS (SELECT detection_id, strftime(make_timestamp(last_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, src_ip, dst_ip,
  coalesce(src_port, 0)::BIGINT AS src_port, dst_port::BIGINT AS dst_port, protocol::VARCHAR AS protocol,
  CASE WHEN ml_flag THEN 'ATTACK' ELSE 'BENIGN' END AS ml_prediction, {r('score')} AS ml_confidence,
  concat('engine=signatures; fired=', fired::VARCHAR, '; severity=', sig_severity, '; rules=', barred_rules) AS signature_result,
  {FEATURE_TEXT} AS feature_values,
  {NAME.replace('{n}', f"greatest({rank(band('score'))}, {rank('sig_severity')})")} AS severity,
  triggered_by, fired, first_rule, sig_severity FROM hit)"""

REPORT = INCIDENT + """,
reported AS (SELECT *, concat_ws(chr(10), 'Intrusion incident', '',
  '[summary]', 'time: ' || timestamp, 'severity: ' || severity, 'trigger: ' || triggered_by, '',
  '[flow]', concat('from: ', src_ip, ':', src_port), concat('to: ', dst_ip, ':', dst_port), 'protocol: ' || protocol, '',
  '[classifier]', 'prediction: ' || ml_prediction,
  concat('probability: ', printf('%.4f', ml_confidence), ' (', printf('%.1f', ml_confidence * 100), '%)'), '',
  '[signatures]', signature_result, '', '-- end --') AS report FROM incident)"""

# -- curves

CURVE = ctes("flows") + """,
groups AS (SELECT score, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM flows GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N,
  lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS nth
  FROM groups WINDOW w AS (ORDER BY score DESC))"""

COUNTS = "count(*) FILTER ({f} AND label = 1) AS tp, count(*) FILTER ({f} AND label = 0) AS fp, " \
         "count(*) FILTER (NOT ({f}) AND label = 1) AS fn, count(*) FILTER (NOT ({f}) AND label = 0) AS tn"


def counts(flag: str) -> str:
    return COUNTS.replace("{f}", flag)


QUALITY = f"""{r(ratio('tp + tn', 'tp + fp + fn + tn'))} AS accuracy, {r(ratio('tp', 'tp + fp'))} AS precision,
 {r(ratio('tp', 'tp + fn'))} AS recall, {r(ratio('2 * tp', '2 * tp + fp + fn'))} AS f1, {r(ratio('fp', 'fp + tn'))} AS fpr"""

AUC = "(SELECT sum(neg * ((tp - pos)::DOUBLE + pos / 2.0::DOUBLE)) / (max(P)::DOUBLE * max(N)) FROM cum)"

SWEEP_CTE = ctes("flows") + ", lines AS (" + " UNION ALL ".join(
    f"SELECT {round(t, 2)}::DOUBLE AS threshold, {counts(f'score >= {t!r}::DOUBLE')} FROM flows" for t in SWEEP) + \
    f"), sweep AS (SELECT threshold, {QUALITY} FROM lines)"


def report_line(name: str, p: str, rec: str, f: str, support: str) -> str:
    return f"SELECT '{name}' AS class_name, {r(p)} AS precision, {r(rec)} AS recall, {r(f)} AS f1_score, {support} AS support FROM c"


def class_report() -> str:
    b = [ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")]
    a = [ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn")]
    acc = ratio("tp + tn", "tp + tn + fp + fn")
    n = "(tp + tn + fp + fn)"
    macro = [f"(({x}) + ({y})) / 2" for x, y in zip(b, a)]
    weighted = [f"(({x}) * (tn + fp) + ({y}) * (tp + fn)) / {n}" for x, y in zip(b, a)]
    return ctes("flows") + f", c AS (SELECT {counts('score >= 0.5')} FROM flows) " + " UNION ALL ".join([
        report_line("BENIGN", *b, "tn + fp"), report_line("ATTACK", *a, "tp + fn"),
        report_line("accuracy", acc, acc, acc, n), report_line("macro avg", *macro, n),
        report_line("weighted avg", *weighted, n)])


def best(objective: str, order: str) -> str:
    return f"(SELECT '{objective}' AS objective, * FROM sweep ORDER BY {order}, threshold LIMIT 1)"


# -- order

SPLIT = ctes("flows") + """,
per_class AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM flows GROUP BY 1),
t1 AS (SELECT *, total - ceil(total * (0.15::DOUBLE + 0.15::DOUBLE)) AS draws FROM per_class),
t2 AS (SELECT *, n / total::DOUBLE * draws AS exact FROM t1),
t3 AS (SELECT *, floor(exact) AS low, draws - sum(floor(exact)) OVER () AS rest,
  row_number() OVER (ORDER BY floor(exact) - exact, label) AS turn FROM t2),
t4 AS (SELECT label, n, low + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS n_train FROM t3),
v1 AS (SELECT *, n - n_train AS held, sum(n - n_train) OVER () AS hold FROM t4),
v2 AS (SELECT *, hold - ceil(hold * 0.5::DOUBLE) AS draws FROM v1),
v3 AS (SELECT *, held / hold::DOUBLE * draws AS exact FROM v2),
v4 AS (SELECT *, floor(exact) AS low, draws - sum(floor(exact)) OVER () AS rest,
  row_number() OVER (ORDER BY floor(exact) - exact, label) AS turn FROM v3),
sizes AS (SELECT label, n_train, low + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS n_val FROM v4),
ranked AS (SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', flow_id::VARCHAR)), flow_id) AS nth FROM flows),
split AS (SELECT flow_id, label::BIGINT AS label, CASE WHEN nth <= n_train THEN 'train' WHEN nth <= n_train + n_val THEN 'validation'
  ELSE 'test' END AS split FROM ranked JOIN sizes USING (label))"""

_FEATURES = ["service", "state", "spkts", "dpkts", "sttl", "rate"]
_SAID = {name: said for name, said in descriptions_of(_FEATURES).items()}
PREP = ctes("flows") + ", p AS (SELECT service, state, spkts, dpkts, sttl, sbytes::DOUBLE / 7 AS rate FROM (FROM flows UNION ALL FROM flows WHERE flow_id % 3 = 0)) " + " UNION ALL ".join(
    [f"SELECT 'median' AS part, '{c}' AS name, '' AS value, {r(f'median({c}::DOUBLE)')} AS number FROM p" for c in ("spkts", "dpkts", "sttl", "rate")]
    + [f"SELECT 'code', '{c}', v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM p)" for c in ("service", "state")]
    + [f"SELECT 'feature', '{c}', '{_SAID.get(c, '')}', {i}::DOUBLE" for i, c in enumerate(_FEATURES)])

# The same split over what cleaning leaves: copies go, the least id stays.
PLANTED = ctes("flows") + """,
cleaned AS (SELECT min(flow_id) AS flow_id, label FROM (SELECT flow_id, (sttl = 128)::INT AS label, service, state, spkts, dpkts, sttl,
  round_even(sbytes::DOUBLE / 7 * 10000, 0) / 10000 AS rate FROM flows) GROUP BY label, service, state, spkts, dpkts, sttl, rate)""" + (
    SPLIT[len(ctes("flows")):].replace("FROM flows", "FROM cleaned"))
# Every fitted tree tells the planted label, so the test part is judged without a mistake.
PERFECT = PLANTED + """ SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1_score, 1.0::DOUBLE AS roc_auc, count(*) FILTER (label = 0) AS true_negatives,
  0::BIGINT AS false_positives, 0::BIGINT AS false_negatives, count(*) FILTER (label = 1) AS true_positives, count(*) AS total_samples FROM split WHERE split = 'test'"""

RAW_CLEAN = ctes("raw_flows") + f", clean AS (SELECT * REPLACE ({finite('flow_bytes_s')} AS flow_bytes_s) FROM raw_flows)"

CATEGORY = "coalesce({c}, 'nan')"


def profile(names: list[str], floats: set[str]) -> str:
    lines = []
    for n in names:
        missing = f"count(*) FILTER ({n} IS NULL" + (f" OR isnan({n}))" if n in floats else ")")
        infinite = f"count(*) FILTER (isinf({n}))" if n in floats else "0::BIGINT"
        lines.append(f"SELECT '{n}' AS column_name, {missing} AS missing, {infinite} AS infinite FROM raw_flows")
    body = " UNION ALL ".join(lines)
    return (ctes("raw_flows") + f", per AS ({body}) SELECT * FROM per UNION ALL "
            "SELECT '(total)', sum(missing)::BIGINT, sum(infinite)::BIGINT FROM per")


def encoded(c: str) -> str:
    return (f"coalesce((SELECT count(DISTINCT coalesce(k.{c}, 'nan')) FROM known k WHERE coalesce(k.{c}, 'nan') < coalesce(x.{c}, 'nan')) "
            f"* (SELECT count(*) > 0 FROM known k WHERE coalesce(k.{c}, 'nan') = coalesce(x.{c}, 'nan'))::BIGINT, 0)::BIGINT")


FLOW_NAMES = {"src": "src_ip", "dst": "dst_ip", "sport": "src_port", "dport": "dst_port"}

WINDOW_COUNTS = ctes("flows") + ", numbered AS (SELECT *, row_number() OVER (ORDER BY last_us, flow_id) AS rn FROM flows) " \
    "SELECT flow_id, rn, " + ", ".join(
        f"count(*) OVER (PARTITION BY {', '.join(FLOW_NAMES.get(c, c) for c in cols)} ORDER BY rn RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS {name}"
        for name, cols in COUNTERS.items()) + " FROM numbered"

APP = """,
conn_app AS (SELECT c.uid,
  coalesce((SELECT max_by(coalesce(trans_depth, 0), ord) FROM http h WHERE h.uid = c.uid), 0)::BIGINT AS trans_depth,
  coalesce((SELECT max_by(coalesce(response_body_len, 0), ord) FROM http h WHERE h.uid = c.uid), 0)::BIGINT AS response_body_len,
  (SELECT count(*) FROM http h WHERE h.uid = c.uid AND method <> '') AS ct_flw_http_mthd,
  (SELECT count(*) FROM ftp f WHERE f.uid = c.uid AND command <> '') AS ct_ftp_cmd,
  (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM ftp f WHERE f.uid = c.uid AND usr <> '')::BIGINT AS is_ftp_login
  FROM conn c)"""

CONN = """,
enriched AS (SELECT c.ord, c.uid, c.orig_h AS src, c.resp_h AS dst, c.orig_p AS sport, c.resp_p AS dport, c.proto,
  coalesce(c.service, '-') AS service, c.conn_state AS state,
  CASE WHEN {dur} <> 0 THEN {dur} ELSE c.duration END AS dur,
  coalesce(p.spkts, c.orig_pkts) AS spkts, coalesce(p.dpkts, c.resp_pkts) AS dpkts,
  coalesce(p.sbytes, c.orig_ip_bytes) AS sbytes, coalesce(p.dbytes, c.resp_ip_bytes) AS dbytes,
  coalesce(p.sttl, 0)::BIGINT AS sttl, coalesce(p.dttl, 0)::BIGINT AS dttl, coalesce(p.sloss, 0) AS sloss,
  coalesce(p.dloss, 0) AS dloss, coalesce(p.last_us, 0) AS last_us
  FROM conn c LEFT JOIN pflow p ON c.orig_h = p.src AND c.resp_h = p.dst AND c.orig_p = p.sport AND c.resp_p = p.dport
   AND p.proto = CASE lower(c.proto) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END)""".replace("{dur}", DUR)


def with_packets(*more: str) -> str:
    """The packet CTEs after the named fixture views."""
    return ctes("packets", *more) + PACKETS[len(ctes("packets")):]


LINEAR_TERMS = {"spkts": 0.01, "dpkts": -0.02, "dur": 0.5}

LINEAR = ctes("flows") + ", means AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}" for n in LINEAR_TERMS) + " FROM flows), items AS (" + \
    " UNION ALL ".join(f"SELECT flow_id, '{n}' AS feature, {w} * ({n}::DOUBLE - m_{n}) AS c FROM flows, means"
                       for n, w in LINEAR_TERMS.items()) + "), rounded AS (SELECT *, " + r("abs(c)") + " AS size FROM items)"

TOP = ctes("flows") + ", items AS (" + " UNION ALL ".join(
    f"SELECT flow_id, 'f{j:02d}' AS feature, CAST((flow_id * {j} * 31) % 201 - 100 AS DOUBLE) / 100 AS contribution FROM flows"
    for j in range(1, 21)) + "), nth AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY abs(contribution) DESC, feature) - 1 AS position, " \
    "max(abs(contribution)) OVER (PARTITION BY flow_id) AS biggest FROM items)"

ORACLE: dict[str, str] = {
    "conform_rename": wide(list(EXPORTER)) + " SELECT event_id, " + ", ".join(f'"{s}" AS "{n}"' for s, n in EXPORTER.items()) +
    ", concat('10.0.0.', event_id % 9) AS src_ip, dst_port, '6' AS protocol FROM wide",
    "json_flows": ctes("alert_json") + """ SELECT ord, line::JSON ->> '$.event_type' AS event_type, line::JSON ->> '$.src_ip' AS src_ip,
  line::JSON ->> '$.alert.signature_id' AS signature_id FROM alert_json WHERE json_valid(line)""",
    "json_rejects": ctes("alert_json") + " SELECT ord, line FROM alert_json WHERE NOT json_valid(line)",
    "alert_filter": ctes("alert_json") + """, parsed AS (SELECT ord, line::JSON AS j FROM alert_json WHERE json_valid(line))
 SELECT ord AS alert_ord, j ->> '$.src_ip' AS src_ip, j ->> '$.dest_ip' AS dst_ip, CAST(j ->> '$.src_port' AS BIGINT) AS src_port,
  CAST(j ->> '$.dest_port' AS BIGINT) AS dst_port, coalesce(j ->> '$.alert.signature', '') AS signature,
  coalesce(j ->> '$.alert.signature_id', 'unknown') AS signature_id, coalesce(CAST(j ->> '$.alert.severity' AS BIGINT), 3) AS severity
  FROM parsed WHERE j ->> '$.event_type' = 'alert' AND NOT contains(lower(coalesce(j ->> '$.alert.signature', '')), 'invalid checksum')""",
    "clean_flows": ctes("raw_flows") + f" SELECT ord, flow_duration, {r(finite('flow_bytes_s'), 9)} AS flow_bytes_s, fwd_packets, proto FROM raw_flows",
    "label_binary": ctes("raw_flows", "flows") + """ SELECT ord, CASE WHEN trim(label_text) = 'BENIGN' THEN 0 ELSE 1 END::BIGINT AS label, 'text' AS source FROM raw_flows
 UNION ALL SELECT flow_id, label::BIGINT, 'number' FROM flows""",
    "impute_median": RAW_CLEAN + f""" SELECT ord, coalesce(flow_duration, (SELECT median(flow_duration) FROM clean)) AS flow_duration,
  {r('coalesce(flow_bytes_s, (SELECT median(flow_bytes_s) FROM clean))')} AS flow_bytes_s, fwd_packets FROM clean""",
    "conform_features": ctes("flows") + f" SELECT flow_id, dbytes, spkts, 0::BIGINT AS no_such_feature, {r('dur')} AS dur FROM flows",
    "coerce_numeric": ctes("raw_flows") + """ SELECT ord, coalesce(TRY_CAST(text_num AS DOUBLE), 0) AS text_num,
  coalesce(TRY_CAST(proto AS DOUBLE), 0) AS proto FROM raw_flows""",
    "to_common_u": common("u"),
    "to_common_c": common("c"),
    "flow_rates": ctes("flows") + f""" SELECT flow_id, trunc({ratio('sbytes', 'spkts')})::BIGINT AS smean, trunc({ratio('dbytes', 'dpkts')})::BIGINT AS dmean,
  {r(ratio('spkts + dpkts', 'dur'))} AS rate, {r(ratio('sbytes * 8', 'dur'))} AS sload, {r(ratio('dbytes * 8', 'dur'))} AS dload,
  CASE WHEN src_ip IS NOT DISTINCT FROM dst_ip AND src_port IS NOT DISTINCT FROM dst_port THEN 1 ELSE 0 END::BIGINT AS is_sm_ips_ports FROM flows""",
    "flow_aliases": ctes("flows") + """ SELECT flow_id, src_ip, dst_ip, src_port::VARCHAR AS src_port, dst_port::BIGINT AS dst_port,
  protocol::BIGINT AS protocol, 0::BIGINT AS fwd_packet_count FROM flows""",
    "flow_metadata": ctes("flows") + """ SELECT flow_id, concat('dst_ip=', dst_ip, ';dst_port=', dst_port, ';protocol=', protocol, ';src_ip=', src_ip,
  ';src_port=', coalesce(src_port::VARCHAR, 'null')) AS metadata FROM flows""",
    "attack_sample": RAW_CLEAN + f""" SELECT ord, coalesce(flow_duration, 0) AS flow_duration, {r('coalesce(flow_bytes_s, 0)', 9)} AS flow_bytes_s,
  coalesce(fwd_packets, 0)::DOUBLE AS fwd_packets FROM clean WHERE trim(label_text) = 'DoS Hulk' ORDER BY ord LIMIT 5""",
    "union_flows": ctes("flows") + " SELECT flow_id, spkts::VARCHAR AS spkts, service, NULL::VARCHAR AS dpkts FROM flows UNION ALL SELECT flow_id, NULL, service, dpkts::VARCHAR FROM flows",
    "dedup_exact": ctes("raw_flows") + " SELECT min(ord) AS ord, fwd_packets, proto, label_text FROM raw_flows GROUP BY fwd_packets, proto, label_text",
    "dedup_near": RAW_CLEAN + f""", nth AS (SELECT *, row_number() OVER (PARTITION BY round_even(flow_duration * 10000, 0) / 10000,
  round_even(flow_bytes_s * 10000, 0) / 10000, fwd_packets, proto ORDER BY ord) AS n FROM clean)
 SELECT ord, flow_duration, {r('flow_bytes_s', 9)} AS flow_bytes_s, fwd_packets, proto FROM nth WHERE n = 1""",
    "fit_medians": RAW_CLEAN + """ SELECT 'flow_duration' AS column_name, median(flow_duration) AS value FROM clean
 UNION ALL SELECT 'flow_bytes_s', median(flow_bytes_s) FROM clean UNION ALL SELECT 'fwd_packets', median(fwd_packets) FROM clean""",
    "label_distribution": ctes("raw_flows") + " SELECT label_text, count(*) AS n FROM raw_flows GROUP BY 1",
    "profile_missing": profile(["flow_duration", "flow_bytes_s", "fwd_packets", "proto", "label_text"], {"flow_duration", "flow_bytes_s"}),
    "fit_encoder": ctes("raw_flows") + """, v AS (SELECT DISTINCT 'proto' AS column_name, coalesce(proto, 'nan') AS value FROM raw_flows
  UNION SELECT DISTINCT 'label_text', coalesce(label_text, 'nan') FROM raw_flows)
 SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS code FROM v""",
    "encode_categories": ctes("raw_flows") + f""", known AS (SELECT proto, label_text FROM raw_flows WHERE proto IS NOT NULL AND label_text <> 'PortScan'),
 v AS (SELECT proto, label_text, {encoded('proto')} AS c1, {encoded('label_text')} AS c2 FROM (SELECT DISTINCT proto, label_text FROM raw_flows) x)
 SELECT r.ord, c1 AS proto, c2 AS label_text FROM raw_flows r JOIN v ON r.proto IS NOT DISTINCT FROM v.proto AND r.label_text IS NOT DISTINCT FROM v.label_text""",
    "packets_to_flows": PACKETS + f""" SELECT {ENDS}, {r(DUR)} AS dur, sttl::BIGINT AS sttl, dttl::BIGINT AS dttl, sloss, dloss,
  {r('coalesce(s_gap / 1000, 0)', 3)} AS sinpkt, {r('coalesce(d_gap / 1000, 0)', 3)} AS dinpkt,
  {r('coalesce(s_bend / 1000, 0)', 3)} AS sjit, {r('coalesce(d_bend / 1000, 0)', 3)} AS djit,
  swin::BIGINT AS swin, dwin::BIGINT AS dwin, {r('synack + ackdat')} AS tcprtt, {r('synack')} AS synack, {r('ackdat')} AS ackdat,
  spkts, dpkts, sbytes, dbytes, {r('last_us / 1e6')} AS last_time, last_us FROM pflow""",
    "packets_to_flows_compat": PACKETS + f" SELECT {ENDS}, {r(DUR_COMPAT)} AS dur, {r('last_us / 1e6')} AS last_time FROM pflow",
    "packet_direction": PACKETS + " SELECT ord, fwd AS is_forward FROM directed",
    "inter_arrival": PACKETS + f" SELECT {ENDS}, {r('coalesce(s_gap / 1000, 0)', 3)} AS sinpkt, {r('coalesce(d_gap / 1000, 0)', 3)} AS dinpkt FROM pflow",
    "jitter": PACKETS + f" SELECT {ENDS}, {r('coalesce(s_bend / 1000, 0)', 3)} AS sjit, {r('coalesce(d_bend / 1000, 0)', 3)} AS djit FROM pflow",
    "retransmissions": PACKETS + f" SELECT {ENDS}, sloss, dloss FROM pflow",
    "handshake_times": PACKETS + f" SELECT {ENDS}, syn_us::VARCHAR AS syn_us, synack_us::VARCHAR AS synack_us, ack_us::VARCHAR AS ack_us, {r('synack')} AS synack, {r('ackdat')} AS ackdat, {r('synack + ackdat')} AS tcprtt FROM pflow",
    "conn_enrich": with_packets("conn") + CONN + f""" SELECT uid, src, dst, sport::BIGINT AS sport, dport::BIGINT AS dport, proto, service, state,
  {r('dur')} AS dur, spkts, dpkts, sbytes, dbytes, sttl, dttl, sloss, dloss, last_us FROM enriched""",
    "http_last": ctes("http") + """ SELECT uid, CASE WHEN m LIKE '-%' THEN NULL ELSE substr(m, 2) END AS method, trans_depth, response_body_len FROM (
  SELECT uid, max_by(CASE WHEN method IS NULL THEN '-' ELSE '+' || method END, ord) AS m, max_by(trans_depth, ord)::BIGINT AS trans_depth,
  max_by(response_body_len, ord) AS response_body_len FROM http GROUP BY uid)""",
    "app_counts": ctes("conn", "http", "ftp") + APP + " SELECT * FROM conn_app",
    "conn_window_counts": WINDOW_COUNTS,
    "extract_flows_u": with_packets("conn", "http", "ftp") + CONN + APP + f""",
 numbered AS (SELECT *, row_number() OVER (ORDER BY last_us, ord) AS rn FROM enriched JOIN conn_app USING (uid))
 SELECT ord AS flow_id, {r('dur')} AS dur, spkts, {r(ratio('spkts + dpkts', 'dur'))} AS rate, trans_depth, is_ftp_login, """ + ", ".join(
        f"count(*) OVER (PARTITION BY {', '.join(cols)} ORDER BY rn RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS {name}"
        for name, cols in COUNTERS.items()) + " FROM numbered",
    "split_stratified": SPLIT + " SELECT * FROM split",
    "split_summary": SPLIT + f""" SELECT split, count(*) AS n, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attack,
  {r('count(*) FILTER (label = 1)::DOUBLE / greatest(count(*) FILTER (label = 0), 1)')} AS attack_ratio FROM split GROUP BY 1""",
    "sample_n": ctes("flows") + " SELECT flow_id, score FROM flows ORDER BY md5(concat('42:', flow_id::VARCHAR)), flow_id LIMIT 1000",
    "class_weight": ctes("flows") + f" SELECT {r('count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1)')} AS scale_pos_weight FROM flows",
    "binary_metrics": CURVE + f""", c AS (SELECT {counts('score >= 0.5')} FROM flows)
 SELECT {r(ratio('tp + tn', 'tp + fp + fn + tn'))} AS accuracy, {r(ratio('tp', 'tp + fp'))} AS precision, {r(ratio('tp', 'tp + fn'))} AS recall,
  {r(ratio('2 * tp', '2 * tp + fp + fn'))} AS f1_score, {r(AUC)} AS roc_auc, {r(ratio('fp', 'fp + tn'))} AS false_positive_rate,
  {r(ratio('tp', 'tp + fn'))} AS true_positive_rate, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
  0.5::DOUBLE AS threshold, tp + fp + fn + tn AS total_samples FROM c""",
    "class_report": class_report(),
    "threshold_sweep": SWEEP_CTE + " SELECT * FROM sweep",
    "threshold_best": SWEEP_CTE + " " + " UNION ALL ".join(
        [best("best_f1", "f1 DESC"), best("best_recall", "recall DESC"), best("lowest_fpr", "fpr")]),
    "roc_curve": CURVE + f""" SELECT score AS threshold, {r(ratio('fp', 'N'))} AS fpr, {r(ratio('tp', 'P'))} AS tpr FROM cum
  WHERE nth = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
    "roc_auc": CURVE + f" SELECT {r(AUC)} AS roc_auc",
    "pr_curve": CURVE + f""" SELECT score AS threshold, {r(ratio('tp', 'tp + fp'))} AS precision, {r(ratio('tp', 'P'))} AS recall FROM cum
  UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""",
    "pr_auc": CURVE + f""", pts AS (SELECT tp / P::DOUBLE AS rec, tp::DOUBLE / (tp + fp) AS prec, score FROM cum),
 steps AS (SELECT rec, prec, coalesce(lag(rec) OVER (ORDER BY score DESC), 0) AS rec0, coalesce(lag(prec) OVER (ORDER BY score DESC), 1) AS prec0 FROM pts)
 SELECT {r('sum((rec - rec0) * (prec + prec0) / 2)')} AS pr_auc FROM steps""",
    "compare_detectors": JUDGED + ", lines AS (" + " UNION ALL ".join(
        f"SELECT '{d}' AS detector, {counts(f)} FROM judged" for d, f in
        (("ml", "ml_flag"), ("signature", "fired"), ("hybrid", "(ml_flag OR fired)"))) + f") SELECT detector, tp, tn, fp, fn, {QUALITY} FROM lines",
    "complementarity": JUDGED + """ SELECT count(*) FILTER (ml_flag AND NOT fired) AS ml_only, count(*) FILTER (NOT ml_flag AND fired) AS signature_only,
  count(*) FILTER (ml_flag AND fired) AS both, count(*) FILTER (NOT ml_flag AND NOT fired) AS neither FROM judged""",
    "flow_results": JUDGED + f""" SELECT flow_id, CASE label WHEN 1 THEN 'ATTACK' ELSE 'BENIGN' END AS ground_truth, {r('score')} AS ml_probability,
  CASE WHEN ml_flag THEN 'ATTACK' ELSE 'BENIGN' END AS ml_verdict, CASE WHEN fired THEN 'ATTACK' ELSE 'BENIGN' END AS signature_verdict,
  replace(matched_rules, ';', '; ') AS signature_rules, CASE WHEN is_intrusion THEN 'ATTACK' ELSE 'BENIGN' END AS hybrid_verdict,
  triggered_by AS hybrid_trigger, src_ip, dst_ip, src_port::VARCHAR AS src_port, dst_port::BIGINT AS dst_port, protocol::BIGINT AS protocol,
  {r('last_us / 1e6')} AS timestamp FROM judged""",
    "rule_signatures": ctes("flows") + """, f AS (SELECT flow_id, coalesce(dst_port = 445 OR src_port = 445, false) AS a, coalesce(dst_port = 23 OR src_port = 23, false) AS b,
  coalesce(dst_port = 21 OR src_port = 21, false) AS c, protocol = 6 AND spkts >= 500 AS d FROM flows)
 SELECT flow_id, a OR b OR c OR d AS is_intrusion, CASE WHEN a OR d THEN 'HIGH' WHEN b OR c THEN 'MEDIUM' ELSE 'NONE' END AS severity,
  concat_ws(';', CASE WHEN a THEN 'SIG-SMB-445' END, CASE WHEN b THEN 'SIG-TELNET-23' END, CASE WHEN c THEN 'SIG-FTP-21' END,
   CASE WHEN d THEN 'SIG-HIGH-VOLUME-TCP' END) AS matched_rules FROM f""",
    "rules_empty": ctes("flows") + " SELECT flow_id, false AS is_intrusion, 'NONE' AS severity FROM flows",
    "match_alerts": MATCHED + " SELECT flow_id, fired AS is_intrusion, matched_rules, rule_hits, n_alerts, sig_severity AS severity, first_rule, details FROM sig",
    "match_alerts_aliases": ctes("flows", "alerts") + """ SELECT f.flow_id, count(a.alert_ord) AS n_alerts, count(a.alert_ord) > 0 AS is_intrusion FROM flows f
  LEFT JOIN alerts a ON (f.src_ip = a.src_ip AND f.dst_ip = a.dst_ip AND f.dst_port = a.dst_port)
   OR (f.src_ip = a.dst_ip AND f.dst_ip = a.src_ip AND f.dst_port = a.src_port) GROUP BY f.flow_id""",
    "row_number_gaps": ctes("raw_flows") + """ SELECT ord, row_number() OVER (
  ORDER BY CASE WHEN flow_bytes_s IS NULL OR isnan(flow_bytes_s) THEN 0 ELSE flow_bytes_s END, ord) AS rn FROM raw_flows""",
    "metrics_unscored": ctes("flows") + f""", s AS (SELECT label, CASE WHEN flow_id % 9 < 2 THEN FALSE ELSE score >= 0.5000000000000001::DOUBLE END AS flag FROM flows),
 c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 1 AND flag) AS tp FROM s)
 SELECT 'metrics' AS source, {r('tp::DOUBLE / p')} AS recall, n FROM c UNION ALL SELECT 'report', {r('tp::DOUBLE / p')}, p FROM c
 UNION ALL SELECT 'sweep', {r('tp::DOUBLE / p')}, 0 FROM c""",
    "conn_log_lines": ctes("conn") + """ SELECT uid, orig_h, orig_p::BIGINT AS orig_p,
  CASE WHEN ord % 5 = 0 THEN -1 ELSE orig_pkts END AS orig_pkts FROM conn WHERE ord % 7 <> 0""",
    "attributions_add_up": ctes("flows") + " SELECT flow_id, TRUE AS adds_up FROM flows",
    "importance_total": "SELECT 11::BIGINT AS features, 1.0::DOUBLE AS total FROM events LIMIT 1",
    "explained_incidents": "SELECT unnest(['run-a', 'run-b']) AS analysis_id, 0::BIGINT AS surplus",
    "match_alerts_gravest": MATCHED + " SELECT flow_id, n_alerts, gravest AS severity FROM sig",
    "verdicts": ctes("flows") + f""", p AS (SELECT flow_id, score, CASE flow_id % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'c' ELSE 'other' END AS profile FROM flows),
 t AS (SELECT *, CASE profile WHEN 'u' THEN 0.5 WHEN 'c' THEN 0.75 ELSE 0.5 END::DOUBLE AS threshold FROM p)
 SELECT flow_id, profile, CASE WHEN score >= threshold THEN 'ATTACK' ELSE 'BENIGN' END AS prediction, {r('score')} AS probability, threshold,
  score >= threshold AS is_intrusion FROM t""",
    "fuse_verdicts": JUDGED + " SELECT flow_id, is_intrusion, triggered_by, final_verdict FROM judged",
    "severity_detection": JUDGED + " SELECT flow_id, severity FROM judged",
    "severity_incident": JUDGED + " SELECT flow_id, " + NAME.replace("{n}", f"greatest({rank(band('score'))}, {rank('sig_severity')})") + " AS incident_severity FROM judged",
    "detection_rows": JUDGED + f""" SELECT detection_id, analysis_id, flow_id, is_intrusion, final_verdict, triggered_by, severity,
  CASE WHEN ml_flag THEN 'ATTACK' ELSE 'BENIGN' END AS ml_verdict, {r('score')} AS ml_confidence,
  CASE WHEN fired THEN 'ALERT' ELSE 'BENIGN' END AS signature_verdict, signature, src_ip, dst_ip, src_port::VARCHAR AS src_port,
  dst_port::BIGINT AS dst_port, protocol::VARCHAR AS protocol, last_us AS flow_us FROM judged""",
    "run_summary": SUMMARY + " SELECT * FROM summary",
    "hybrid_detection": JUDGED + f""" SELECT flow_id, analysis_id, final_verdict, triggered_by, severity, {r('score')} AS probability, n_alerts, matched_rules FROM judged""",
    "detections_store": JUDGED + " SELECT detection_id, flow_id, analysis_id, triggered_by, severity FROM hit",
    "detection_lookup": SUMMARY + """ SELECT detection_id, flow_id, h.analysis_id, severity, flow_count FROM hit h JOIN summary USING (analysis_id)
 JOIN (SELECT analysis_id, min(detection_id) AS a, max(detection_id) AS z FROM hit GROUP BY 1) e ON e.analysis_id = h.analysis_id AND detection_id IN (a, z)""",
    "training_run": PERFECT, "evaluation_run": PERFECT,
    "csv_flows": ctes("flows") + """ SELECT flow_id, CASE WHEN flow_id // 1000 % 2 = 0 THEN dur END AS dur, service, sbytes AS total_length,
  row_number() OVER (ORDER BY flow_id // 1000 % 2, flow_id) - 1 AS ord FROM flows""",
    "csv_charsets": ctes("flows") + " SELECT flow_id, concat(CASE WHEN flow_id % 3 = 0 THEN 'Überfall é ' ELSE 'accès ' END, coalesce(service, '?')) AS said FROM flows",
    "headerless_flows": ctes("flows") + """ SELECT flow_id, src_ip AS srcip, src_port::VARCHAR AS sport, CASE WHEN protocol = 6 THEN 'tcp' ELSE 'udp' END AS proto, service, state, dur,
  sbytes, spkts, dpkts, label::BIGINT AS label, 49::BIGINT AS width FROM flows""",
    "presplit_flows": ctes("flows") + " SELECT flow_id AS id, dur, service, spkts, label::BIGINT AS label FROM flows",
    "prep_state": PREP,
    "profile_labels": ctes("raw_flows", "flows") + """ SELECT 'u' AS profile, flow_id AS id, label::BIGINT AS label FROM flows
 UNION ALL SELECT 'c', ord, CASE WHEN trim(label_text) = 'BENIGN' THEN 0 ELSE 1 END::BIGINT FROM raw_flows""",
    "kpi_totals": SUMMARY + " SELECT count(*) AS runs, sum(flow_count)::BIGINT AS flows, sum(total_intrusions)::BIGINT AS intrusions FROM summary",
    "kpi_severity": JUDGED + " SELECT severity, count(*) AS n FROM hit GROUP BY 1",
    "kpi_trigger": JUDGED + " SELECT triggered_by, count(*) AS n FROM hit GROUP BY 1",
    "breakdown_protocol": JUDGED + " SELECT protocol::VARCHAR AS protocol, count(*) AS n FROM hit GROUP BY 1",
    "top_src": JUDGED + " SELECT src_ip, count(*) AS n FROM hit GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 5",
    "top_dst": JUDGED + " SELECT dst_ip, count(*) AS n FROM hit GROUP BY 1 ORDER BY n DESC, dst_ip LIMIT 5",
    "recent_incidents": JUDGED + """ SELECT detection_id, concat(src_ip, ':', coalesce(src_port::VARCHAR, '*')) AS source,
  concat(dst_ip, ':', dst_port) AS destination, protocol::VARCHAR AS protocol, triggered_by, severity FROM hit
  ORDER BY last_us DESC, detection_id LIMIT 8""",
    "activity_series": JUDGED + f""" SELECT detection_id, CASE WHEN score = 0 THEN 1.0 ELSE {r('score')} END AS confidence FROM hit
  ORDER BY last_us DESC, detection_id LIMIT 30""",
    "incident_filter": JUDGED + """ SELECT detection_id, src_ip, dst_ip, severity, triggered_by FROM hit
  WHERE (contains(src_ip, '10.0.0.1') OR contains(dst_ip, '10.0.0.1')) AND severity = 'MEDIUM' AND triggered_by = 'BOTH'""",
    "incident_count": JUDGED + """ SELECT count(*) FILTER ((contains(src_ip, '10.0.0.1') OR contains(dst_ip, '10.0.0.1')) AND triggered_by = 'ML') AS shown,
  count(*) AS total FROM hit""",
    "incidents": INCIDENT + " SELECT * EXCLUDE (fired, first_rule, sig_severity) FROM incident",
    "incident_report": REPORT + " SELECT detection_id, report FROM reported",
    "run_report": SUMMARY + """ SELECT analysis_id, concat_ws(chr(10), 'Run report', 'verdict: ' || verdict, '', '[finding]',
  CASE WHEN total_intrusions = 0 THEN 'No flow of this run was judged malicious by the classifier or by a signature.'
   ELSE concat(total_intrusions, ' flows of this run were judged malicious.') END, '',
  '[traffic]', concat('flows: ', flow_count), concat('benign: ', flow_count - total_intrusions), concat('intrusions: ', total_intrusions), '',
  '[sources]', concat('classifier only: ', ml_only), concat('signature only: ', sig_only), concat('both: ', hybrid), '', '-- end --') AS report FROM summary""",
    "report_rows": REPORT + """ SELECT detection_id, ml_prediction AS prediction, fired AS matched, coalesce(first_rule, 'None') AS signature,
  length(report) AS report_length, dst_ip, severity, 'available' AS status FROM reported""",
    "top_features": TOP + f""" SELECT flow_id, position, feature, contribution, {r('''CASE WHEN biggest > 0
  THEN least(100.0, greatest(5.0, abs(contribution) / biggest * 100)) ELSE 5.0 END''')} AS share FROM nth WHERE position < 15""",
    "attributions_linear": LINEAR + f""" SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY size DESC, feature) - 1 AS position,
  feature, {r(r('c'), 4)} AS contribution, CASE WHEN c > 0 THEN 'attack' ELSE 'benign' END AS direction FROM rounded""",
    "global_attribution_linear": LINEAR + f" SELECT feature, {r(r('avg(size)'), 4)} AS mean_abs_contribution FROM rounded GROUP BY 1",
}

# The paths for large tables give the same rows.
ORACLE |= {other: ORACLE[name] for other, name in (
    ("flow_results_csv", "flow_results"), ("metrics_sink", "class_report"),
    ("fit_medians_narrowed", "fit_medians"), ("encode_categories_joined", "encode_categories"),
    ("packets_to_flows_blocks", "packets_to_flows"), ("conn_window_counts_blocks", "conn_window_counts"))}
