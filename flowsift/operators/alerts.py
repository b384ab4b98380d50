"""Signature alerts: filtering, matching to flows in both directions, roll-up per flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalars import q
from flowsift.session import materialise

# Fixed value: alerts whose signature contains this text are noise of the capture point.
CHECKSUM_NOISE = "invalid checksum"

ENDS = ["src_ip", "dst_ip", "src_port", "dst_port"]
SWAPPED = ["dst_ip", "src_ip", "dst_port", "src_port"]
KEY = ["mask", *[f"k_{c}" for c in ENDS]]


def is_alert(df: DataFrame) -> DataFrame:
    """Rows of an alert log that are alerts and not checksum noise.

    Needs event_type and alert.signature; a missing signature counts as empty text.
    """
    signature = F.lower(F.coalesce(F.col("alert.signature"), F.lit("")))
    return df.filter((F.col("event_type") == "alert") & ~signature.contains(CHECKSUM_NOISE))


def flatten_alerts(df: DataFrame) -> DataFrame:
    """Alert log to the flat alert table, with defaults for severity (3) and id ('unknown')."""
    return df.select(
        "alert_ord", "src_ip", F.col("dest_ip").alias("dst_ip"), F.col("src_port").try_cast("int").alias("src_port"),
        F.col("dest_port").try_cast("int").alias("dst_port"),
        F.coalesce(F.col("alert.signature"), F.lit("")).alias("signature"),
        F.coalesce(F.col("alert.signature_id").cast("string"), F.lit("unknown")).alias("signature_id"),
        F.coalesce(F.col("alert.severity").try_cast("int"), F.lit(3)).alias("severity"))


# The other name an end field may have.
OTHER_NAMES = {"src_ip": "source_ip", "dst_ip": "destination_ip", "src_port": "source_port", "dst_port": "destination_port"}


def _ends(flows: DataFrame) -> dict[str, Column]:
    """The four end fields of a flow, from their name or their other name; an absent field is unknown."""
    out = {}
    for name in ENDS:
        source = next((n for n in (name, OTHER_NAMES[name]) if n in flows.columns), None)
        kind = "int" if name.endswith("port") else "string"
        out[name] = (q(source).try_cast(kind) if source else F.lit(None).cast(kind)).alias(name)
    return out


def _mask(ends: dict[str, Column]) -> Column:
    """Four bits telling which of a flow's end fields are known; an unknown field matches all."""
    return reduce(Column.__add__, [F.when(ends[c].isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(ENDS)])


def alert_index(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per key a flow can have, with the rules that hit it.

    Alerts are first counted per distinct (ends, rule). Each then announces itself under its own
    ends and under the swapped ends, for every combination of known fields that occurs among the
    flows (16 at most), and under a key only once even if both directions give it. Grouping by
    key and rule, then by key, leaves lists no longer than the rule set, however many alerts
    share a key.
    """
    rule = ["signature_id", "signature"]
    # An alert without an end field equals no known field of a flow, yet a NULL key would.
    distinct = (alerts.withColumn("signature_id", F.col("signature_id").cast("string"))
                .groupBy(*ENDS, *rule)
                .agg(F.count("*").alias("hits"), F.min("alert_ord").alias("first_ord"),
                     F.max("severity").alias("max_severity"), F.min("severity").alias("min_severity")))
    masks = flows.select(_mask(_ends(flows)).alias("mask")).distinct()

    def key(fields: list[str]) -> Column:
        cells = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(c)).alias(f"k_{ENDS[i]}")
                 for i, c in enumerate(fields)]
        known = [(F.col("mask").bitwiseAND(1 << i) == 0) | F.col(c).isNotNull() for i, c in enumerate(fields)]
        return F.when(reduce(Column.__and__, known), F.struct(*cells))

    # At most 16 masks exist, so their table is always small enough to broadcast.
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << len(ENDS)) - 1)))
    announced = (distinct.withColumn("mask", every).join(F.broadcast(masks), "mask", "left_semi")
                 .withColumn("key", F.explode(F.array_distinct(F.array(key(ENDS), key(SWAPPED)))))
                 .filter(F.col("key").isNotNull())
                 .select("mask", "key.*", *rule, "hits", "first_ord", "max_severity", "min_severity"))
    per_rule = (announced.groupBy(*KEY, *rule)
                .agg(F.sum("hits").alias("hits"), F.min("first_ord").alias("first_ord"),
                     F.max("max_severity").alias("max_severity"), F.min("min_severity").alias("min_severity")))
    entry = F.struct("first_ord", *rule, "hits")
    return per_rule.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(entry)).alias("rules"), F.sum("hits").alias("n_alerts"),
        F.max("max_severity").alias("max_severity"), F.min("min_severity").alias("min_severity"))


def severity_of(number: Column) -> Column:
    """Severity name of an alert number: 1 is the gravest."""
    return F.when(number == 1, "CRITICAL").when(number == 2, "HIGH").otherwise("MEDIUM")


SIG = ("struct<is_intrusion:boolean,matched_rules:array<string>,rule_hits:array<bigint>,n_alerts:bigint,"
       "severity:string,engine:string,details:string>")


def rollup_alerts(hits: DataFrame, gravest: bool = False, engine: str = "signatures") -> DataFrame:
    """Signature verdict ``sig`` from a list of rules that hit.

    Rules are listed once, in order of their first alert, with their number of hits beside them;
    the hit counts add up to the matched alerts. The severity comes from the greatest alert
    number, or from the least with ``gravest``.
    """
    number = F.greatest(F.lit(0), F.col("min_severity" if gravest else "max_severity"))

    def listed(form: str) -> Column:
        return F.transform("rules", lambda r: F.format_string(form, r["signature_id"], r["signature"]))

    sig = F.struct(
        F.lit(True).alias("is_intrusion"), listed("SID-%1$s: %2$s").alias("matched_rules"),
        F.transform("rules", lambda r: r["hits"]).alias("rule_hits"), F.col("n_alerts").alias("n_alerts"),
        severity_of(number).alias("severity"), F.lit(engine).alias("engine"),
        F.array_join(listed("%2$s (SID %1$s)"), ", ").alias("details"))
    return hits.withColumn("sig", sig.cast(SIG)).drop("rules", "n_alerts", "max_severity", "min_severity")


def no_match(engine: str = "signatures") -> Column:
    """Signature verdict of a flow without alerts."""
    return F.struct(F.lit(False), F.array().cast("array<string>"), F.array().cast("array<bigint>"), F.lit(0),
                    F.lit("NONE"), F.lit(engine), F.lit("no matching alert")).cast(SIG)


def match_alerts(flows: DataFrame, alerts: DataFrame, gravest: bool = False, engine: str = "signatures") -> DataFrame:
    """Flows with ``sig``: alerts whose ends equal the flow's, as they are or swapped.

    A flow field that is NULL or absent matches any value; fields may have their other names. Each flow has exactly one key and each key one
    row, so this is one left equi-join with as many rows as flows: no pair of flow and alert is
    ever formed, and the verdict is put together once per key. The index is written first, so
    Spark plans with its real size: a small one is broadcast and the flows are not shuffled at
    all; for a large one both sides are shuffled and a hot key is split on the flow side.
    """
    index = materialise(rollup_alerts(alert_index(flows, alerts), gravest, engine), "alert-index")
    ends = _ends(flows)
    keyed = flows.select(F.struct(*[q(c) for c in flows.columns]).alias("flow"), _mask(ends).alias("mask"), F.struct(*ends.values()).alias("e"))
    on = reduce(Column.__and__, [keyed[f"e.{c}"].eqNullSafe(index[f"k_{c}"]) for c in ENDS])
    joined = keyed.join(index, (keyed["mask"] == index["mask"]) & on, "left")
    return joined.select("flow.*", F.coalesce(index["sig"], no_match(engine)).alias("sig"))


def first_rule(rules: Column) -> Column:
    return F.try_element_at(rules, F.lit(1))
