"""Column lists and types of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Flow-exporter column and the profile C name it becomes, in model order.
EXPORTER = {
    "dst_port": "Destination Port",
    "flow_duration": "Flow Duration",
    "tot_fwd_pkts": "Total Fwd Packets",
    "tot_bwd_pkts": "Total Backward Packets",
    "totlen_fwd_pkts": "Total Length of Fwd Packets",
    "totlen_bwd_pkts": "Total Length of Bwd Packets",
    "fwd_pkt_len_max": "Fwd Packet Length Max",
    "fwd_pkt_len_min": "Fwd Packet Length Min",
    "fwd_pkt_len_mean": "Fwd Packet Length Mean",
    "fwd_pkt_len_std": "Fwd Packet Length Std",
    "bwd_pkt_len_max": "Bwd Packet Length Max",
    "bwd_pkt_len_min": "Bwd Packet Length Min",
    "bwd_pkt_len_mean": "Bwd Packet Length Mean",
    "bwd_pkt_len_std": "Bwd Packet Length Std",
    "flow_byts_s": "Flow Bytes/s",
    "flow_pkts_s": "Flow Packets/s",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "fwd_iat_tot": "Fwd IAT Total",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "bwd_iat_tot": "Bwd IAT Total",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "fwd_header_len": "Fwd Header Length",
    "bwd_header_len": "Bwd Header Length",
    "fwd_pkts_s": "Fwd Packets/s",
    "bwd_pkts_s": "Bwd Packets/s",
    "pkt_len_min": "Min Packet Length",
    "pkt_len_max": "Max Packet Length",
    "pkt_len_mean": "Packet Length Mean",
    "pkt_len_std": "Packet Length Std",
    "pkt_len_var": "Packet Length Variance",
    "fin_flag_cnt": "FIN Flag Count",
    "syn_flag_cnt": "SYN Flag Count",
    "rst_flag_cnt": "RST Flag Count",
    "psh_flag_cnt": "PSH Flag Count",
    "ack_flag_cnt": "ACK Flag Count",
    "urg_flag_cnt": "URG Flag Count",
    "cwr_flag_count": "CWE Flag Count",
    "ece_flag_cnt": "ECE Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "pkt_size_avg": "Average Packet Size",
    "fwd_seg_size_avg": "Avg Fwd Segment Size",
    "bwd_seg_size_avg": "Avg Bwd Segment Size",
    "subflow_fwd_pkts": "Subflow Fwd Packets",
    "subflow_fwd_byts": "Subflow Fwd Bytes",
    "subflow_bwd_pkts": "Subflow Bwd Packets",
    "subflow_bwd_byts": "Subflow Bwd Bytes",
    "init_fwd_win_byts": "Init_Win_bytes_forward",
    "init_bwd_win_byts": "Init_Win_bytes_backward",
    "fwd_act_data_pkts": "act_data_pkt_fwd",
    "fwd_seg_size_min": "min_seg_size_forward",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
}

FEATURES_C = list(EXPORTER.values())

# Flow metadata an exporter file may carry beside the features.
EXPORTER_METADATA = {"src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int",
                     "protocol": "string", "timestamp": "string"}

# Column names of the headerless files of profile U, in file order.
RAW_U = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl", "dttl",
    "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin", "stcpb", "dtcpb",
    "smeansz", "dmeansz", "trans_depth", "res_bdy_len", "Sjit", "Djit", "Stime", "Ltime", "Sintpkt",
    "Dintpkt", "tcprtt", "synack", "ackdat", "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd",
    "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ ltm",
    "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "attack_cat", "Label"]

# Names of headerless columns that differ from the pre-split ones.
RAW_TO_PRESPLIT_U = {
    "Sload": "sload", "Dload": "dload", "Spkts": "spkts", "Dpkts": "dpkts", "smeansz": "smean",
    "dmeansz": "dmean", "res_bdy_len": "response_body_len", "Sjit": "sjit", "Djit": "djit",
    "Sintpkt": "sinpkt", "Dintpkt": "dinpkt", "ct_src_ ltm": "ct_src_ltm"}

TEXT_U = {"srcip", "dstip", "proto", "state", "service", "attack_cat"}
WHOLE_U = {"id", "stcpb", "dtcpb", "spkts", "dpkts", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "swin",
           "dwin", "smean", "dmean", "trans_depth", "response_body_len", "ct_srv_src", "ct_state_ttl", "ct_dst_ltm",
           "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "is_ftp_login", "ct_ftp_cmd",
           "ct_flw_http_mthd", "ct_src_ltm", "ct_srv_dst", "is_sm_ips_ports"}


def type_u(name: str) -> T.DataType:
    """Type of a profile U column, pre-split or headerless; ports may be hexadecimal text."""
    plain = RAW_TO_PRESPLIT_U.get(name, name)
    if plain in TEXT_U or plain in ("sport", "dsport"):
        return T.StringType()
    if plain in WHOLE_U or plain.lower() == "label":
        return T.LongType()
    return T.DoubleType()


def type_c(name: str) -> T.DataType:
    """Type of a profile C column: everything but names, addresses, times and labels is a number."""
    return T.StringType() if name in ("Label", "label", "Flow ID", "Source IP", "Destination IP", "Timestamp") else T.DoubleType()


# Numbers are read as text and converted later: a value of another type then costs that value only,
# not the whole line.
ALERT_LOG = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dest_ip", T.StringType()),
    T.StructField("src_port", T.StringType()), T.StructField("dest_port", T.StringType()),
    T.StructField("alert", T.StructType([
        T.StructField("signature", T.StringType()), T.StructField("signature_id", T.StringType()),
        T.StructField("severity", T.StringType())]))])

CONN_LOGS = {
    "conn": T.StructType([
        T.StructField("uid", T.StringType()),
        T.StructField("id.orig_h", T.StringType()), T.StructField("id.resp_h", T.StringType()),
        T.StructField("id.orig_p", T.IntegerType()), T.StructField("id.resp_p", T.IntegerType()),
        T.StructField("duration", T.DoubleType()), T.StructField("proto", T.StringType()),
        T.StructField("service", T.StringType()), T.StructField("conn_state", T.StringType()),
        T.StructField("orig_pkts", T.LongType()), T.StructField("resp_pkts", T.LongType()),
        T.StructField("orig_ip_bytes", T.LongType()), T.StructField("resp_ip_bytes", T.LongType())]),
    "http": T.StructType([
        T.StructField("uid", T.StringType()), T.StructField("method", T.StringType()),
        T.StructField("trans_depth", T.IntegerType()), T.StructField("response_body_len", T.LongType())]),
    "ftp": T.StructType([
        T.StructField("uid", T.StringType()), T.StructField("command", T.StringType()),
        T.StructField("user", T.StringType())]),
}

PACKETS = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("us", T.LongType()), T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()), T.StructField("sport", T.IntegerType()), T.StructField("dport", T.IntegerType()),
    T.StructField("proto", T.IntegerType()), T.StructField("ttl", T.IntegerType()), T.StructField("len", T.IntegerType()),
    T.StructField("is_tcp", T.BooleanType()), T.StructField("win", T.IntegerType()), T.StructField("seq", T.LongType()),
    T.StructField("flags", T.StringType()), T.StructField("payload_len", T.IntegerType())])
