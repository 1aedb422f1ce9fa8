"""Chat formatting with a grammar that can be read back exactly.

Grammar. A turn is ``<|role|m|>body</s>``; a role is escaped always, ``m`` is ``0`` for a body as it is
and ``1`` for an escaped one. A body as it is holds none of CONTROLS; an escaped body has ``\\`` and the
first character of each control string written as ``\\`` and a letter, which makes every control string
vanish. A turn is first rendered as it is and parsed again; only if that doesn't give the same turn back,
its body is escaped, and the parse is compared once more.

Cases. Null texts and roles are empty strings. Turns are ordered by turn (null first), then role, then
text, so ties and repeated rows have one order. A null conv_id is a conversation of its own. Only the role
``assistant`` is under the loss mask. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import record_batch

# Strings that mark structure in this template or in others that models are trained on.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPES = {"\\": "\\\\", "<": "\\l", "|": "\\p", "[": "\\b"}
_PLAIN = {v: k for k, v in _ESCAPES.items()}
_HEAD = re.compile(r"<\|((?:[^<|\[\\]|\\.)*)\|([01])\|>", re.S)

PART_SCHEMA = "conv_id long, block long, part int, formatted string"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

PART_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("formatted", pa.string())])
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return re.sub(r"[\\<|\[]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], text, flags=re.S)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the span of the body of each turn; raises ValueError where the grammar doesn't fit."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        stop = _CONTROL.search(formatted, head.end()) if head else None
        if not stop or stop[0] != "</s>":
            raise ValueError(f"no turn at character {at}")
        body = formatted[head.end() : stop.start()]
        yield unescape(head[1]), unescape(body) if head[2] == "1" else body, head.end(), stop.start()
        at = stop.end()


def render(role: str, text: str) -> str:
    """One turn; escaped only if the plain form doesn't come back identical."""
    for mode, body in (("0", text), ("1", escape(text))):
        out = f"<|{escape(role)}|{mode}|>{body}</s>"
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError(f"a turn can't be rendered: {role!r}")


def format_conversations(conversations: DataFrame, *, turns_per_block: int = 1024, part_chars: int = 1 << 20) -> DataFrame:
    """Formatted text by conversation (PART_SCHEMA), in order of block and part.

    Turns are dealt out by conversation and block of turn numbers, so one endless conversation is
    spread over tasks; a part closes at ``part_chars``, so a row stays small. A usual conversation
    is a single part.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / turns_per_block), F.lit(-(1 << 62))))
    turns = turns.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, held, size, rows = None, 0, [], 0, []

        def close() -> None:
            nonlocal held, size
            if held:
                rows.append((*key, part, "".join(held)))
            held, size = [], 0

        def out() -> pa.RecordBatch:
            return record_batch(rows, PART_ARROW)

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["conv_id"], row["block"]):
                    close()
                    key, part = (row["conv_id"], row["block"]), 0
                elif size >= part_chars:
                    close()
                    part += 1
                held.append(render(row["role"], row["text"]))
                size += len(held[-1])
            if rows:
                yield out()
                rows = []
        close()
        if rows:
            yield out()

    return turns.mapInArrow(pack, PART_SCHEMA)


def digest_formatted(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row per conversation (DIGEST_SCHEMA) from formatted text alone: turns parsed, loss mask applied.

    A digest runs over a conversation from its first byte to its last, so one task reads its parts in
    turn; it keeps hash states, not text.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, state = [], None

        def close() -> None:
            if state:
                rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out() -> pa.RecordBatch:
            return record_batch(rows, DIGEST_ARROW)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(row["formatted"])
                for role, text, _, _ in parse(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        state[3] += len(text)
                        state[4].update(text.encode())
            if rows:
                yield out()
                rows = []
        close()
        if rows:
            yield out()

    return dealt.mapInArrow(digest, DIGEST_SCHEMA)
