"""Packets to bidirectional flows.

A packets table has: ord (unique, increasing with capture order), us (epoch microseconds), src,
dst, sport, dport, proto, ttl, len, is_tcp, win, seq, flags (letters such as S, SA, PA),
payload_len.

The two ends of a flow are put in a fixed order (low end, high end), so the side a packet was
sent from is known from the packet alone. Which side is "forward" is settled last, from the
flow's first packet. All measures are taken per (flow, block of ``block`` consecutive
ordinals) in one pass over the packets, which are shuffled once; what a block tells is written,
one row per flow, block and side, and stitched over a flow's blocks. A flow with a third
of all packets is many tasks' work, not one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.session import materialise

#: Ordinals of a block, and thus the most packets of a flow that one task holds together.
BLOCK = 1 << 18

FLOW = ["lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]

MEASURES = ["dur", "sttl", "dttl", "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin", "dwin",
            "tcprtt", "synack", "ackdat", "spkts", "dpkts", "sbytes", "dbytes", "last_time"]


def _canonical(packets: DataFrame) -> DataFrame:
    low_first = (F.col("src") < F.col("dst")) | ((F.col("src") == F.col("dst")) & (F.col("sport") <= F.col("dport")))

    def pick(low: str, high: str) -> Column:
        return F.when(low_first, F.col(low)).otherwise(F.col(high))

    return (packets
            .withColumn("lo_ip", pick("src", "dst")).withColumn("lo_port", pick("sport", "dport"))
            .withColumn("hi_ip", pick("dst", "src")).withColumn("hi_port", pick("dport", "sport"))
            .withColumn("side", F.when(low_first, "a").otherwise("b")))


def _to_self() -> Column:
    return (F.col("lo_ip") == F.col("hi_ip")) & (F.col("lo_port") == F.col("hi_port"))


def _flags() -> tuple[Column, Column, Column]:
    tcp = F.coalesce(F.col("is_tcp"), F.lit(False))
    s = F.coalesce(F.col("flags").contains("S"), F.lit(False))
    a = F.coalesce(F.col("flags").contains("A"), F.lit(False))
    # A time of 0 is "not seen yet" in the tracked state, so packets at 0 set nothing.
    usable = tcp & (F.col("us") > 0)
    return usable & s & ~a, usable & s & a, usable & a & ~s


def _first(value: str, cond: Column, name: str) -> list[Column]:
    """Ordinal and value of the first row where ``cond`` holds."""
    at = F.when(cond, F.col("ord"))
    return [F.min(at).alias(f"{name}_ord"), F.min_by(F.col(value), at).alias(name)]


def flow_segments(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (flow, block, side) with everything a block can tell about its packets.

    ``loss`` counts the packets with payload whose sequence number was seen before on the side in
    this block. ``numbers`` has each number that occurs, with 1 if its first packet had payload: that packet
    counts too if an earlier block has the number.

    In a flow from an endpoint to itself side a is the first packet of the block and side b the
    rest; ``_sided`` keeps side a only in the flow's first block.
    """
    syn, synack, ack = _flags()
    rows = _canonical(packets).withColumn("block", F.expr(f"ord div {block}"))
    in_block = Window.partitionBy(*FLOW, "block")
    sequence = Window.partitionBy(*FLOW, "block", "side").orderBy("ord")
    block_first = F.col("ord") == F.min("ord").over(in_block)
    rows = rows.withColumn("side", F.when(_to_self(), F.when(block_first, "a").otherwise("b")).otherwise(F.col("side")))
    mark = {side: F.min(F.when(synack & (F.col("side") == side), F.col("ord"))).over(in_block) for side in "ab"}
    rows = (rows
            .withColumn("peer_synack", F.when(F.col("side") == "a", mark["b"]).otherwise(mark["a"]))
            .withColumn("p1", F.lag("us", 1).over(sequence)).withColumn("p2", F.lag("us", 2).over(sequence))
            .withColumn("n1", F.lead("us", 1).over(sequence)).withColumn("n2", F.lead("us", 2).over(sequence)))
    tcp = F.coalesce(F.col("is_tcp"), F.lit(False))
    same_number = Window.partitionBy(*FLOW, "block", "side", "tcp", "seq").orderBy("ord")
    rows = (rows.withColumn("tcp", tcp).withColumn("loaded", F.coalesce(F.col("payload_len") > 0, F.lit(False)).cast("int"))
            .withColumn("nth", F.when(F.col("tcp"), F.row_number().over(same_number))))
    bend = F.abs(F.col("us") - 2 * F.col("p1") + F.col("p2"))
    return (rows.groupBy(*FLOW, "block", "side").agg(
        F.count("*").alias("n"), F.sum("len").alias("bytes"), F.sum(bend).alias("bends"),
        *_first("us", F.lit(True), "head"),
        F.min(F.when(F.col("p1").isNotNull() & F.col("p2").isNull(), F.col("us"))).alias("head2"),
        F.max(F.when(F.col("n1").isNull(), F.col("us"))).alias("tail"),
        F.max(F.when(F.col("n1").isNotNull() & F.col("n2").isNull(), F.col("us"))).alias("tail2"),
        *_first("ttl", F.lit(True), "head_ttl"),
        *_first("win", F.lit(True), "head_win"),
        *_first("ttl", F.col("ttl") != 0, "ttl"),
        *_first("win", F.col("is_tcp") & (F.col("win") != 0), "win"),
        *_first("us", syn, "syn"), *_first("us", synack, "synack"),
        *_first("us", ack, "ack"), *_first("us", ack & (F.col("ord") > F.col("peer_synack")), "ack_after"),
        F.sum(F.when(F.col("nth") > 1, F.col("loaded")).otherwise(0)).alias("loss"),
        F.collect_list(F.when(F.col("nth") == 1, F.struct("seq", "loaded"))).alias("numbers"),
    ).drop("head_ttl_ord", "head_win_ord", "ack_ord", "ack_after_ord"))


def _sided(segments: DataFrame) -> DataFrame:
    """Segments with their final side: behind the first block a flow to itself has side b only."""
    later = _to_self() & (F.col("block") > F.min("block").over(Window.partitionBy(*FLOW)))
    return segments.withColumn("side", F.when(later, "b").otherwise(F.col("side")))


def _repeated_across(segments: DataFrame) -> DataFrame:
    """Retransmitted packets (again_a, again_b) that only an earlier segment of the side reveals.

    Only numbers of sides with several segments are taken up. Counts combine map-side, so neither a flow
    nor a number gathers its packets in one task.
    """
    several = F.count("*").over(Window.partitionBy(*FLOW, "side")) > 1
    numbers = (_sided(segments.select(*FLOW, "block", "side", "head_ord", "numbers")).withColumn("several", several).where("several")
               .select(*FLOW, "side", "head_ord", F.explode("numbers").alias("number")))
    per_number = (numbers.groupBy(*FLOW, "side", F.col("number.seq").alias("seq"))
                  .agg((F.sum("number.loaded") - F.min_by("number.loaded", "head_ord")).alias("again")))
    return per_number.groupBy(*FLOW).agg(*[F.sum(F.when(F.col("side") == side, F.col("again"))).alias(f"again_{side}") for side in "ab"])


def _stitched(segments: DataFrame) -> DataFrame:
    """One row per flow with both sides' totals (suffix _a, _b)."""
    flow = Window.partitionBy(*FLOW)
    per_side = Window.partitionBy(*FLOW, "side").orderBy("head_ord")
    segments = _sided(segments.drop("numbers"))
    synack_block = {side: F.min(F.when((F.col("side") == side) & F.col("synack_ord").isNotNull(), F.col("block")))
                    .over(flow) for side in "ab"}
    # Blocks follow the ordinal, so the first SYN+ACK lies in the first block that has one.
    rows = segments.withColumn("peer_block", F.when(F.col("side") == "a", synack_block["b"]).otherwise(synack_block["a"]))
    rows = rows.withColumn("ack_time", F.when(F.col("block") == F.col("peer_block"), F.col("ack_after"))
                           .when(F.col("block") > F.col("peer_block"), F.col("ack")))
    # The last two packets of the side before this block, then the bends across the border.
    rows = rows.withColumn("before", F.lag("tail").over(per_side))
    rows = rows.withColumn("second_last", F.when(F.col("n") >= 2, F.col("tail2")).otherwise(F.col("before")))
    rows = rows.withColumn("before2", F.lag("second_last").over(per_side))
    border = (F.coalesce(F.abs(F.col("head") - 2 * F.col("before") + F.col("before2")), F.lit(0))
              + F.coalesce(F.abs(F.col("head2") - 2 * F.col("head") + F.col("before")), F.lit(0)))
    rows = rows.withColumn("bends", F.coalesce("bends", F.lit(0)) + border)

    aggs: list[Column] = []
    for side in "ab":
        own = F.col("side") == side
        position = F.when(own, F.col("head_ord"))

        def first(name: str, order: Column = position) -> Column:
            return F.min_by(F.col(name), order).alias(f"{name}_{side}")

        aggs += [F.sum(F.when(own, F.col(c))).alias(f"{c}_{side}") for c in ("n", "bytes", "bends", "loss")]
        aggs += [F.min(F.when(own, F.col("head_ord"))).alias(f"head_ord_{side}")]
        aggs += [first(c) for c in ("head", "head_ttl", "head_win")]
        aggs += [first(c, F.when(own, F.col(f"{c}_ord"))) for c in ("ttl", "win", "syn", "synack")]
        aggs += [F.max_by(F.col("tail"), position).alias(f"tail_{side}"),
                 first("ack_time", F.when(F.col("ack_time").isNotNull(), position))]
    return rows.groupBy(*FLOW).agg(*aggs)


def _oriented(packets: DataFrame, block: int) -> DataFrame:
    """Flow rows with s_* (first-seen direction) and d_* columns."""
    segments = materialise(flow_segments(packets, block), "segments")
    flows = _stitched(segments).join(_repeated_across(segments), FLOW, "left")
    for side in "ab":
        flows = flows.withColumn(f"loss_{side}", F.coalesce(f"loss_{side}", F.lit(0)) + F.coalesce(f"again_{side}", F.lit(0)))
    forward_low = F.coalesce(F.col("head_ord_a") < F.col("head_ord_b"), F.col("head_ord_a").isNotNull())
    # A flow from an endpoint to itself has its first packet on side a by construction.
    names = ["n", "bytes", "bends", "head_ord", "head", "head_ttl", "head_win", "ttl", "win", "syn", "synack",
             "tail", "ack_time", "loss"]
    out = []
    for name in names:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        out.append(F.when(forward_low, a).otherwise(b).alias(f"s_{name}"))
        out.append(F.when(forward_low, b).otherwise(a).alias(f"d_{name}"))
    lo_ip, lo_port, hi_ip, hi_port = (F.col(c) for c in FLOW[:4])
    return flows.select(
        F.when(forward_low, lo_ip).otherwise(hi_ip).alias("src"), F.when(forward_low, hi_ip).otherwise(lo_ip).alias("dst"),
        F.when(forward_low, lo_port).otherwise(hi_port).alias("sport"),
        F.when(forward_low, hi_port).otherwise(lo_port).alias("dport"), "proto", *out)


def _gap_ms(side: str) -> Column:
    """Mean gap between packets: gaps add up to last - first."""
    span = (F.col(f"{side}_tail") - F.col(f"{side}_head")).cast("double")
    return F.when(F.col(f"{side}_n") >= 2, span / (F.col(f"{side}_n") - 1) / 1000).otherwise(0.0)


def _jitter_ms(side: str) -> Column:
    return F.when(F.col(f"{side}_n") >= 3,
                  F.col(f"{side}_bends").cast("double") / (F.col(f"{side}_n") - 2) / 1000).otherwise(0.0)


def _after(later: str, earlier: str) -> Column:
    """Seconds between two marks, at least 0; 0 if either is missing."""
    return F.greatest(F.coalesce((F.col(later) - F.col(earlier)) / 1e6, F.lit(0.0)), F.lit(0.0))


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def packets_to_flows(packets: DataFrame, compat: bool = False, block: int = BLOCK) -> DataFrame:
    """Bidirectional flow aggregate: src, dst, sport, dport, proto and 19 measures.

    ``dur`` is last minus first time over the packets that exist. With ``compat`` a side without
    packets counts as time 0, which makes the duration of a one-way flow its last timestamp.
    """
    last_us = F.greatest(F.col("s_tail"), F.col("d_tail"))
    if compat:
        begin = F.least(F.col("s_head"), F.coalesce("d_head", F.lit(0)))
        end = F.greatest(F.col("s_tail"), F.coalesce("d_tail", F.lit(0)))
    else:
        begin, end = F.least(F.col("s_head"), F.col("d_head")), last_us
    synack, ackdat = _after("d_synack", "s_syn"), _after("s_ack_time", "d_synack")
    return _oriented(packets, block).select(
        "src", "dst", "sport", "dport", "proto",
        F.greatest((end - begin) / 1e6, F.lit(0.0)).alias("dur"),
        F.col("s_head_ttl").alias("sttl"), _or_zero("d_ttl").alias("dttl"),
        _or_zero("s_loss").alias("sloss"), _or_zero("d_loss").alias("dloss"),
        _gap_ms("s").alias("sinpkt"), _gap_ms("d").alias("dinpkt"),
        _jitter_ms("s").alias("sjit"), _jitter_ms("d").alias("djit"),
        _or_zero("s_head_win").alias("swin"), _or_zero("d_win").alias("dwin"),
        (synack + ackdat).alias("tcprtt"), synack.alias("synack"), ackdat.alias("ackdat"),
        F.col("s_n").alias("spkts"), _or_zero("d_n").alias("dpkts"),
        F.col("s_bytes").alias("sbytes"), _or_zero("d_bytes").alias("dbytes"),
        (last_us / 1e6).alias("last_time"), last_us.alias("last_us"))


_ENDS = ["src", "dst", "sport", "dport", "proto"]


def first_seen_direction(packets: DataFrame) -> DataFrame:
    """Packets with ``is_forward``: sent from the endpoint that sent the flow's first packet.

    In a flow from an endpoint to itself only the first packet is forward. The first packet per
    flow is a combinable minimum; the join back is left to Spark, which splits a hot flow.
    """
    canonical = _canonical(packets)
    first = canonical.groupBy(*FLOW).agg(F.min("ord").alias("first_ord"), F.min_by("side", "ord").alias("first_side"))
    forward = F.when(_to_self(), F.col("ord") == F.col("first_ord")).otherwise(F.col("side") == F.col("first_side"))
    return canonical.join(first, FLOW).select(*packets.columns, forward.alias("is_forward"))


def inter_arrival(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mean gap between consecutive packets of each direction, in ms."""
    return packets_to_flows(packets, block=block).select(*_ENDS, "sinpkt", "dinpkt")


def jitter(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mean absolute change between consecutive gaps of each direction, in ms."""
    return packets_to_flows(packets, block=block).select(*_ENDS, "sjit", "djit")


def retransmissions(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Packets with payload whose sequence number was seen before in their direction."""
    return packets_to_flows(packets, block=block).select(*_ENDS, "sloss", "dloss")


def handshake(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """First SYN, first SYN+ACK of the answering side, first ACK after it, and their gaps (s)."""
    synack, ackdat = _after("d_synack", "s_syn"), _after("s_ack_time", "d_synack")
    return _oriented(packets, block).select(
        *_ENDS, F.col("s_syn").alias("syn_us"), F.col("d_synack").alias("synack_us"),
        F.col("s_ack_time").alias("ack_us"),
        synack.alias("synack"), ackdat.alias("ackdat"), (synack + ackdat).alias("tcprtt"))
