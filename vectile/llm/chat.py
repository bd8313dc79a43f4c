"""Chat formatting of heterogeneous records by schema fingerprints.

The field paths that a record fills, of those that any mapping knows, are hashed; the hash selects a declarative mapping, which says
where ids, roles and texts lie. Each turn becomes one segment of the formatted conversation, which is the
concatenation of its segments in order, so no conversation is ever gathered to be written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>\n"
# Control strings of this template and of common others; a backslash goes between their first character and the rest.
OPENING, REST = r"([<\[])(\\*)", r"(\||/?s>|/?INST\]|</?SYS>>)"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that records fill, those they may leave null, and where its turns come from.

    ``turns`` are either (role, path) pairs in order, or one (role path, text path) below an array; ``order`` is the path
    of a turn's number where every record is one turn.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    array: str | None = None
    order: str | None = None

    def fingerprints(self) -> list[int]:
        some = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [fingerprint([*self.required, *c]) for c in some]


MAPPINGS = (
    Mapping("turn rows", (), ("turn", "role", "text"), (("role", "text"),), order="turn"),
    Mapping("messages", ("messages[].role", "messages[].content"), (), (("role", "content"),), array="messages"),
    Mapping("speakers", ("conversations[].from", "conversations[].value"), (), (("from", "value"),), array="conversations"),
    Mapping("prompt and response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
ROLES = {"human": "user", "prompter": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def fingerprint(paths: list[str]) -> int:
    """The signed XXH64 of the sorted paths, as Spark's ``xxhash64`` gives it."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def paths_of(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, column) of every leaf of a schema; ``[]`` marks the elements of an array."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += [(p, f.name if not prefix else c) for p, c in paths_of(kind.elementType, f"{path}[].")] if not prefix else []
        elif isinstance(kind, T.StructType) and not prefix:
            out += paths_of(kind, f"{path}.")
        else:
            out.append((path, path if "[]" not in prefix else prefix.split("[]")[0]))
    return out


def with_layout(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout``, the name of the first mapping whose own filled paths select it; null where there is none.

    Paths of other mappings do not matter, but a record without any of a mapping's paths is one of its own only if it
    fills no path that any mapping knows.
    """
    known = {p for m in mappings for p in (*m.required, *m.optional)}
    columns = sorted((path, column) for path, column in paths_of(records.schema) if path in known)

    def print_of(paths: set[str]) -> Column:
        filled = [F.when(F.col(column).isNotNull(), F.lit(path)) for path, column in columns if path in paths]
        return F.xxhash64(F.array_join(F.array_compact(F.array(*filled)) if filled else F.array().cast("array<string>"), "\n"))

    layout, blank = F.lit(None).cast("string"), fingerprint([])
    for m in reversed(mappings):
        own = print_of({*m.required, *m.optional})
        layout = F.when(own.isin(m.fingerprints()) & ((own != blank) | (print_of(known) == blank)), F.lit(m.name)).otherwise(layout)
    return records.withColumn("layout", layout)


def unmatched_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The remainder that ``canonical_turns`` gives no turns of, as it is: records that select no mapping."""
    return with_layout(records.drop("layout"), mappings).where("layout IS NULL").drop("layout")


def canonical_turns(records: DataFrame, conv_id: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of all records whose layout is known; ``unmatched_records`` has the others.

    A record of turn rows keeps its own number; elsewhere turns count from 0, and fields left null are no turns. Null roles
    and texts are empty. Roles of other conventions get their common names. Other columns are not read.
    """
    have = {p for p, _ in paths_of(records.schema)}
    rows = with_layout(records.drop("layout"), mappings)
    out = []
    role = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.coalesce(c, F.lit(""))), c, F.lit(""))
    for m in mappings:
        if not all(p in have for p in m.required) or not m.required and not any(p in have for p in m.optional):
            continue
        own = rows.where(F.col("layout") == m.name)
        there = lambda name: F.col(name).cast("string") if name in records.columns else F.lit(None).cast("string")
        if m.order:
            number = F.col(m.order).cast("long") if m.order in have else F.lit(None).cast("long")
            shape = own.select(F.col(conv_id).alias("conv_id"), number.alias("turn"), there(m.turns[0][0]).alias("said_by"), there(m.turns[0][1]).alias("said"))
        elif m.array:
            each = own.select(F.col(conv_id).alias("conv_id"), F.posexplode(m.array).alias("at", "item"))
            shape = each.select("conv_id", F.col("at").cast("long").alias("turn"), F.col(f"item.{m.turns[0][0]}").cast("string").alias("said_by"), F.col(f"item.{m.turns[0][1]}").cast("string").alias("said"))
        else:
            items = F.filter(F.array(*[F.struct(F.lit(r).alias("said_by"), there(p).alias("said")) for r, p in m.turns]), lambda t: t["said"].isNotNull())
            each = own.select(F.col(conv_id).alias("conv_id"), F.posexplode(items).alias("at", "item"))
            shape = each.select("conv_id", F.col("at").cast("long").alias("turn"), "item.said_by", "item.said")
        out.append(shape.select("conv_id", "turn", role(F.col("said_by")).alias("role"), F.coalesce("said", F.lit("")).alias("text")))
    if not out:
        return records.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def escape(text: Column) -> Column:
    """No control string remains in the result, and ``unescape`` gives the text back whatever it was."""
    return F.regexp_replace(text, OPENING + REST, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, OPENING + r"\\" + REST, "$1$2$3")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end): the marked turn, and the span of it that the loss is taken on.

    Spans are code points, end exclusive; only texts of the assistant have one, other turns have null. Each row is formatted
    where it is. A conversation is its segments by turn, then by role and text.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    body = escape(F.col("text"))
    learned = F.col("role") == ASSISTANT
    parts = turns.select("conv_id", "turn", head.alias("head"), body.alias("body"), learned.alias("learned"))
    start = F.when(F.col("learned"), F.length("head"))
    return parts.select("conv_id", "turn", F.concat("head", "body", F.lit(DONE)).alias("segment"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, segment_chars) from formatted segments alone."""
    inner = F.substring("segment", len(TURN) + 1, F.length("segment") - len(TURN) - len(DONE))
    sides = F.split(inner, r"<\|says\|>", 2)
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("segment"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    return formatted.select("conv_id", "turn", unescape(F.get(sides, 0)).alias("role"), unescape(F.get(sides, 1)).alias("text"), loss.alias("loss_text"), F.length("segment").cast("long").alias("segment_chars"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of ``formatted``: its turns and the text under the loss mask, as counts and digests.

    Rows are dealt by conversation, sorted and hashed as they come, so a conversation of any length is read through but
    never held. A null id is a conversation of its own; repeated turns count as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, out = None, None, []
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        close = lambda: out.append((here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            for conv, role, text, loss, chars in zip(*(batch[c] for c in ("conv_id", "role", "text", "loss_text", "segment_chars"))):
                conv, loss = conv.as_py(), loss.as_py()
                if state is None or conv != here:
                    if state is not None:
                        close()
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role.as_py()}\n{text.as_py()}\n".encode())
                state[4] += chars.as_py()
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
            if out:
                yield batch_of()
                out.clear()
        if state is not None:
            close()
            yield batch_of()

    rows = read_turns(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(run, DIGESTS)
