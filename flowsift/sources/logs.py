"""Alert logs and connection logs in JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.scalars import q
from flowsift.operators.alerts import flatten_alerts, is_alert
from flowsift.sources.flows import path_exists
from flowsift.sources.schemas import ALERT_LOG, CONN_LOGS

BROKEN = "_broken"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that parse, with ``ord``, the position in the file; blank and malformed ones are skipped."""
    with_broken = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    parsed = F.from_json("value", with_broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("value"))
    rows = lines.filter("value <> ''").select("ord", parsed.alias("e")).filter(F.col(f"e.{BROKEN}").isNull())
    return rows.select("ord", *[F.col("e").getField(f.name).alias(f.name) for f in schema.fields])


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert table from an event log: alerts only, checksum noise dropped, defaults filled.

    A log that does not exist gives an empty table. ``alert_ord`` is taken on the scan and grows
    with the position in a file.
    """
    if path_exists(spark, path):
        events = read_json_lines(spark, path, ALERT_LOG)
    else:
        events = spark.createDataFrame([], T.StructType([T.StructField("ord", T.LongType()), *ALERT_LOG.fields]))
    return flatten_alerts(is_alert(events.withColumnRenamed("ord", "alert_ord")))


def parse_alert_lines(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """The same from a table with one line of text per row. A malformed line has no event type."""
    parsed = df.select(q(ordinal).alias("alert_ord"), F.from_json(q(column), ALERT_LOG).alias("e"))
    return flatten_alerts(is_alert(parsed.select("alert_ord", "e.*")))


def typed(field: T.StructField) -> Column:
    """A text field in its type; what doesn't fit is NULL and costs that field only."""
    c = q(field.name)
    if isinstance(field.dataType, T.StringType):
        return c
    kind = field.dataType.simpleString()
    number = c.try_cast(kind)
    if kind in ("int", "bigint"):
        number = F.coalesce(number, F.floor(c.try_cast("double")).try_cast(kind))
    return number.alias(field.name)


def read_conn_logs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """conn, http and ftp tables of a log folder, empty where a log is absent.

    Each has ``ord``, the position in its log; addresses and ports lose their ``id.`` prefix and
    the FTP user column is named usr.
    """
    out = {}
    for stem, schema in CONN_LOGS.items():
        path = f"{folder}/{stem}.log"
        empty = T.StructType([T.StructField("ord", T.LongType()), *schema.fields])
        if path_exists(spark, path):
            text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
            rows = read_json_lines(spark, path, text).select("ord", *[typed(f) for f in schema.fields])
        else:
            rows = spark.createDataFrame([], empty)
        out[stem] = rows.toDF(*[{"user": "usr"}.get(c, c.removeprefix("id.")) for c in rows.columns])
    return out
