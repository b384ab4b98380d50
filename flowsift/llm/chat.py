"""Chat formatting by event-sourced reconstruction.

A log of events per conversation is sorted by sequence and folded: ``start`` opens a message, ``delta`` appends
to it, ``edit`` replaces it, ``regenerate`` empties it for a new attempt, ``delete`` removes it. The final
messages are then rendered. Tasks stream over sorted logs and hold one conversation at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Control strings of the template. A turn is one of the forms in ``_TURN``.
_OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
_CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
_NAMES = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|<NAME>>"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_NAMES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_NAMES})")
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>"
                   r"|<<ROLE>>(?P<role>.*?)<<NAME>>(?P<other>.*?)<</ROLE>>", re.S)


def escape(text: str) -> str:
    """Control strings get a backslash behind their first sign; those that have some already get one more."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """(formatted, starts, ends of what the loss covers: the assistant's texts)."""
    out, at, starts, ends = [], 0, [], []
    for role, text in messages:
        body = escape(text)
        head, tail = ((_OPEN[role], _CLOSE[role]) if role in _OPEN else (f"<<ROLE>>{escape(role)}<<NAME>>", "<</ROLE>>"))
        out += [head, body, tail]
        if role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        at += len(head) + len(body) + len(tail)
    return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a rendered conversation."""
    out = []
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
    return out


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) of the messages, in the order in which they first appear; events are (message, event, role, text)."""
    held: dict = {}
    for message, event, role, text in events:
        if event == "delete":
            held.pop(message, None)
            continue
        if event not in ("start", "delta", "edit", "regenerate"):
            continue  # unknown events change nothing
        if message not in held:
            held[message] = [role or "", []]
        entry = held[message]
        if event in ("edit", "regenerate", "start"):
            entry[1] = []
        if role is not None:
            entry[0] = role
        if text:
            entry[1].append(text)
    return [(role, "".join(parts)) for role, parts in held.values()]


def format_chats(events: DataFrame, order: list[str], key: str = "conv_id") -> DataFrame:
    """(key, n_turns, formatted, loss_starts, loss_ends) per conversation.

    ``events`` has key, message, event, role and text, and is folded in the order of the columns ``order``. A missing
    text adds nothing, a missing role is the empty role unless an earlier event of the message named one, unknown or
    missing events change nothing, and rows without a key form one conversation without a key. A conversation whose
    messages are all deleted is empty. Repeated events are applied again. Other columns are ignored; an empty table
    gives an empty table.
    """
    kind = events.schema[key].dataType.simpleString()
    sort = [f"o{i}" for i in range(len(order))]
    rows = events.select(F.col(key).alias("key"), "message", "event", "role", "text", *(F.col(c).alias(s) for c, s in zip(order, sort)))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.grouped(batches, ["key"]):
            messages = fold(zip(*(table.column(c).to_pylist() for c in ("message", "event", "role", "text"))))
            formatted, starts, ends = render(messages)
            yield pa.record_batch([table.column("key").combine_chunks().slice(0, 1), pa.array([len(messages)], pa.int64()), pa.array([formatted], pa.string()),
                                   pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))],
                                  ["key", "n_turns", "formatted", "loss_starts", "loss_ends"])

    out = (rows.repartition("key").sortWithinPartitions("key", *sort).select("key", "message", "event", "role", "text")
           .mapInArrow(rendered, f"key {kind}, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"))
    return out.withColumnRenamed("key", key)


def event_log(turns: DataFrame, piece: int = 400, draft: int = 40) -> DataFrame:
    """The log that produces finished turns (conv_id, turn, role, text): a start, a draft of the assistant that is
    regenerated, and deltas of ``piece`` characters. Rows of one turn follow each other by role and text."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    event = lambda name, step, body: F.struct(F.lit(name).alias("event"), step.cast("long").alias("step"), body.alias("text"))
    steps = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / piece).cast("int"))).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(steps, lambda i: event("delta", i + 3, F.substring(text, i * piece + 1, F.lit(piece))))
    attempt = F.when((F.col("role") == "assistant") & (size > 0), F.array(
        event("delta", F.lit(1), F.substring(text, 1, draft)), event("regenerate", F.lit(2), F.lit("")))).otherwise(F.array().cast(
            "array<struct<event:string,step:bigint,text:string>>"))
    return (turns.select("conv_id", "turn", F.col("role"), text.alias("text")).withColumn("place", F.md5("text"))
            .withColumn("message", F.monotonically_increasing_id())
            .select("conv_id", "turn", "role", "place", "message", F.explode(F.concat(F.array(event("start", F.lit(0), F.lit(""))), attempt, deltas)).alias("e"))
            .select("conv_id", "turn", "role", "place", "message", "e.event", "e.step", "e.text"))


LOG_ORDER = ["turn", "role", "place", "message", "step"]


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what the rendered conversations say: turns, and the text that the loss covers, unescaped."""
    import hashlib

    kind = chats.schema[key].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends"))):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends))
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([batch.column("key"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))],
                                  ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return (chats.select(F.col(key).alias("key"), "formatted", "loss_starts", "loss_ends").mapInArrow(
        digests, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
        .withColumnRenamed("key", key))
