"""Chat formatting by schema fingerprints.

A record is JSON of some layout: prompt and completion, instruction and output, a list of messages, or one turn of
a conversation. The paths of its nested fields, but for those that no mapping knows, are hashed into a fingerprint,
which selects a declarative mapping to canonical turns (role and text). Turns are then formatted as

    <|role|>\\n text <|end|>\\n        (without the blanks)

with a backslash put before each backslash and inside each control string (of this template and of other common
ones) of texts and roles, so that a mark is never found inside a text and reading back gives the same turns. The
loss mask of a turn is the span of an assistant's text.

Defined cases: a null text or role is an empty one; fields of other types are read as their JSON; a record of unknown
layout, or that isn't JSON, gives one row of layout null with the record as its text, and is left out of the formatted
output; turns with equal numbers are ordered by place, role and text, and repeated rows are turns each; null numbers come
first; a conversation without turns doesn't come out; texts of any length are formatted whole. The report takes four columns
of conversations and ignores others; of an empty table it has the one conversation -7 that it adds, which is one
with a conversation of that id in the table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_limits, partitions

CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>)|\|(?=>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
END = "<|end|>\n"


@dataclass(frozen=True)
class Mapping:
    """A layout: turns made of fields in order, or one turn for each element of a list, or one turn itself."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    #: Role and the fields whose non-empty texts, with a blank line between, are the turn.
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: The list, and the element's fields of role and text.
    each: tuple[str, str, str] | None = None
    #: The record's fields of conversation, number, role and text.
    row: tuple[str, str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


MAPPINGS = [
    Mapping("turn", ("conv_id", "turn", "role", "text"), row=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Mapping("shared", ("conversations[].from", "conversations[].value"), ("system",), turns=(("system", ("system",)),), each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("completion", ("prompt", "completion"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", ("prompt", "response"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("question", "answer"), ("context",), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("nested", ("data.prompt", "data.completion"), turns=(("user", ("data.prompt",)), ("assistant", ("data.completion",)))),
]


def paths(value: Any, at: str = "") -> set[str]:
    """Paths of the fields that hold values; a list adds [], an empty list or object is a field itself."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint_of(found: set[str], known: frozenset[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found & known)).encode(), digest_size=8).hexdigest()


def lookup(mappings: list[Mapping]) -> tuple[dict[str, Mapping], frozenset[str]]:
    """Fingerprint -> mapping, for each choice of optional fields; and the paths that count."""
    known = frozenset(p for m in mappings for p in (*m.required, *m.optional, *([m.each[0]] if m.each else [])))
    table = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for some in combinations(m.optional, n):
                table.setdefault(fingerprint_of({*m.required, *some}, known), m)
                if m.each:
                    table.setdefault(fingerprint_of({m.each[0], *some}, known), m)
    return table, known


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _field(record: Any, path: str) -> Any:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def turns_of(m: Mapping, record: dict) -> list[tuple[str, str]]:
    found = []
    for role, fields in m.turns:
        if any(_field(record, f) is not None for f in fields):
            found.append((role, "\n\n".join(t for f in fields if (t := _text(_field(record, f))))))
    if m.each:
        for item in _field(record, m.each[0]) or []:
            role = _text(_field(item, m.each[1]))
            found.append((m.roles.get(role, role), _text(_field(item, m.each[2]))))
    if m.row:
        found.append((_text(_field(record, m.row[2])), _text(_field(record, m.row[3]))))
    return found


TURN = "conv_id long, turn long, place int, role string, text string, layout string, fingerprint string"


def canonical_turns(records: DataFrame, mappings: list[Mapping] | None = None) -> DataFrame:
    """Turns of the records (record_id, payload); conv_id is the payload's own where the layout has one."""
    table, known = lookup(mappings or MAPPINGS)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record_id, payload in zip(batch["record_id"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                try:
                    record = json.loads(payload or "null")
                except ValueError:
                    record = None
                mark = fingerprint_of(paths(record), known) if isinstance(record, dict) else None
                m = table.get(mark)
                if m is None:
                    out.append((record_id, None, 0, None, payload, None, mark))
                    continue
                own, number = (_field(record, m.row[0]), _field(record, m.row[1])) if m.row else (record_id, 0)
                out += [(own, number, k, role, text, m.name, mark) for k, (role, text) in enumerate(turns_of(m, record))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()])], names=[x.split()[0] for x in TURN.split(", ")])

    arrow_limits(records.sparkSession)
    return records.select(F.col("record_id").cast("long"), F.col("payload").cast("string")).mapInArrow(turns, TURN)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as text, and the span of it that counts for the loss."""
    head, body = f"<|{escape(role)}|>\n", escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == "assistant" else 0)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text."""
    found = []
    for part in formatted.split(END)[:-1]:
        role, _, body = part[2:].partition("|>\n")
        found.append((unescape(role), unescape(body)))
    return found


FORMATTED = "conv_id long, turn long, place int, chunk string, loss_start int, loss_end int"


def formatted(turns: DataFrame) -> DataFrame:
    """Formatted text of each canonical turn; a conversation is its turns' chunks in order."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [formatted_turn(r or "", t or "") for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            new = [pa.array([m[k] for m in made], t) for k, t in enumerate([pa.string(), pa.int32(), pa.int32()])]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["place"], *new], names=[x.split()[0] for x in FORMATTED.split(", ")])

    return turns.where(F.col("layout").isNotNull()).select("conv_id", "turn", "place", "role", "text").mapInArrow(chunks, FORMATTED)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted chunks; a conversation streams through its task."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv = False, None
        for batch in batches:
            done = []
            for own, chunk, low, high in zip(batch["conv_id"].to_pylist(), batch["chunk"].to_pylist(), batch["loss_start"].to_pylist(), batch["loss_end"].to_pylist(), strict=True):
                if not started or own != conv:
                    if started:
                        done.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), size))
                    started, conv, n, whole, chars, loss, size = True, own, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text in read_turns(chunk):
                    n += 1
                    whole.update(f"{role}\n{text}\n".encode())
                masked = unescape(chunk[low:high])
                chars += len(masked)
                loss.update(masked.encode())
                size += len(chunk)
            yield report(done)
        if started:
            yield report([(conv, n, whole.hexdigest(), chars, loss.hexdigest(), size)])

    def report(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (2, 4) else pa.int64()) for k in range(6)], names=[x.split()[0] for x in REPORT.split(", ")])

    arrow_limits(chunks.sparkSession)
    return chunks.repartition(partitions(chunks.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "place", "chunk").mapInArrow(digests, REPORT)


def conversation_report(conversations: DataFrame) -> DataFrame:
    """Formats rows (conv_id, turn, role, text), and one conversation more of control strings; reads them back."""
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    rows = conversations.select(F.col("conv_id").cast("long").alias("record_id"), record.alias("payload"))
    odd = json.dumps({"messages": [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]})
    one = conversations.sparkSession.range(1).select(F.lit(-7).cast("long").alias("record_id"), F.lit(odd).alias("payload"))
    return read_back(formatted(canonical_turns(rows.union(one))))
