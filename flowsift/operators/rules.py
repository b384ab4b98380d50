"""Rule signatures evaluated on the flow itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.severity import name_of, rank_of
from flowsift.operators.fuse import with_aliases


@dataclass(frozen=True)
class Rule:
    """A signature: fires where ``predicate()`` is true. The predicate is built when used, since
    a Column needs a running session."""

    id: str
    predicate: Callable[[], Column]
    severity: str


def _either_port(number: int) -> Callable[[], Column]:
    return lambda: (F.col("dst_port").try_cast("int") == number) | (F.col("src_port").try_cast("int") == number)


# Rule ids, ports, packet count and severities of the built-in rules.
DEFAULT_RULES = [
    Rule("SIG-SMB-445", _either_port(445), "HIGH"),
    Rule("SIG-TELNET-23", _either_port(23), "MEDIUM"),
    Rule("SIG-FTP-21", _either_port(21), "MEDIUM"),
    Rule("SIG-HIGH-VOLUME-TCP", lambda: (F.col("protocol").try_cast("int") == 6) & (F.col("fwd_packet_count") >= 500), "HIGH"),
]


def apply_rules(df: DataFrame, rules: Sequence[Rule] | None = None, engine: str = "rules") -> DataFrame:
    """Add ``sig``: fired rule ids in rule order and the highest severity among them.

    An empty rule list gives a detector that never fires.
    """
    rules = DEFAULT_RULES if rules is None else rules
    aliased = with_aliases(df, protocol=0)
    fired = [F.when(r.predicate(), F.lit(r.id)) for r in rules]
    matched = F.array_compact(F.array(*fired)) if rules else F.array().cast("array<string>")
    levels = [F.when(r.predicate(), rank_of(r.severity)).otherwise(0) for r in rules]
    top = F.greatest(F.lit(0), F.lit(0), *levels)
    sig = F.struct(
        (top > 0).alias("is_intrusion"), matched.alias("matched_rules"),
        F.transform(matched, lambda _: F.lit(1).cast("bigint")).alias("rule_hits"),
        F.size(matched).cast("bigint").alias("n_alerts"),
        F.coalesce(name_of(top), F.lit("NONE")).alias("severity"), F.lit(engine).alias("engine"),
        F.when(top > 0, F.concat(F.lit("rules fired: "), F.array_join(matched, ", "))).otherwise("no rule fired").alias("details"))
    return aliased.withColumn("sig", sig).select(*[F.col(f"`{c}`") for c in df.columns], "sig")
