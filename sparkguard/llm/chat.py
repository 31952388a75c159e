"""Chat records of any known layout as formatted, reversible training text.

A record's nested field paths are hashed; the hash names the declarative mapping that reads its turns. Turns are then formatted one by one,
with built-in expressions: markers around role and text, and a backslash that keeps any control string inside a text from being one. Reading
back undoes both. A conversation's digests are chains over its turns, so its rows stream through one task in order and only
the state of the hashes is held, however long it is.

Defined results: a null record, role or text is an empty one; fields that no mapping knows are ignored; a record without a known mapping gives no
turns and is counted by ``unmapped``; of two layouts in one record the one with more of its fields is read; equal places are ordered by role and text; a null conversation id is a conversation; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.llm.common import text_of

# The markers of a turn, and the strings that mean something to common chat templates.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# Names of roles in layouts that say from and value; others keep their roles as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Turns of a record: (role, path) for plain fields, then a list's path with the fields of role and text; "[]" is the record itself."""

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None


# A system text beside the turns, and the names of answers.
SYSTEM = (("system", "system"),)
ANSWERS = ("output", "response", "completion")
LAYOUTS = (
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), SYSTEM, ("messages", "role", "content")),
    Layout("conversations", ("conversations[].from",), ("conversations[].value", "system"), SYSTEM, ("conversations", "from", "value")),
    Layout("list of messages", ("[].role",), ("[].content",), items=("[]", "role", "content")),
    Layout("list of conversations", ("[].from",), ("[].value",), items=("[]", "from", "value")),
    Layout("list of turns", ("[].role",), ("[].text",), items=("[]", "role", "text")),
    Layout("instruction", ("instruction",), ("system", "input", *ANSWERS), fields=(*SYSTEM, ("user", "instruction"), ("user", "input"), *[("assistant", x) for x in ANSWERS])),
    Layout("prompt", ("prompt",), ("system", "input", *ANSWERS), fields=(*SYSTEM, ("user", "prompt"), ("user", "input"), *[("assistant", x) for x in ANSWERS])),
    Layout("turn", ("role",), ("text",), items=("", "role", "text")),
    Layout("text only", ("text",), items=("", "role", "text")),
    Layout("no messages", ("messages[0]",), ("system",), SYSTEM, ("messages", "role", "content")),
    Layout("no conversations", ("conversations[0]",), ("system",), SYSTEM, ("conversations", "from", "value")),
    Layout("empty list", ("[0]",), items=("[]", "role", "content")),
)
_KNOWN = frozenset(p for x in LAYOUTS for p in (*x.needed, *x.optional))


def paths(value, at: str = "") -> Iterator[str]:
    """Paths of the leaves of a parsed record; list members share a path, an empty list ends in [0]."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        if not value:
            yield f"{at}[0]"
        for v in value:
            yield from paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(found) -> str:
    """Hash of the paths that any mapping knows."""
    return hashlib.sha256("\n".join(sorted(_KNOWN.intersection(found))).encode()).hexdigest()[:16]


MAPPINGS = {
    fingerprint((*x.needed, *chosen)): x for x in reversed(LAYOUTS) for n in range(len(x.optional) + 1) for chosen in combinations(x.optional, n)
}


def layout_of(found) -> Layout | None:
    """The mapping of exactly these paths, or else the one with the most of them whose needed paths are all there."""
    known = _KNOWN.intersection(found)
    fitting = (x for x in LAYOUTS if known.issuperset(x.needed))
    return MAPPINGS.get(fingerprint(known)) or max(fitting, key=lambda x: len(known.intersection((*x.needed, *x.optional))), default=None)


def _plain(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: str | None) -> list[tuple[str, str]] | None:
    """(role, text) of a record's turns, or None if no mapping fits."""
    try:
        value = json.loads(record) if record else {}
    except ValueError:
        return None
    if value == {}:
        return [("", "")]
    layout = layout_of(paths(value))
    if layout is None:
        return None
    turns = [(role, _plain(value[path])) for role, path in layout.fields if value.get(path) is not None]
    if layout.items:
        at, role, text = layout.items
        members = value if at == "[]" else value[at] if at else [value]
        renamed = ROLES if role == "from" else {}
        turns += [(renamed.get(r := _plain(x.get(role)), r), _plain(x.get(text))) for x in members if isinstance(x, dict)]
    return turns


def canonical(records: DataFrame, id_col: str, order_col: str, record_col: str) -> DataFrame:
    """conv_id, turn (the record's order), part (the turn's number in it), role, text, unmapped; a record without turns is one row of part -1."""
    kinds = {c: records.schema[c].dataType.simpleString() for c in (id_col, order_col)}
    read = records.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{order_col}`").alias("turn"), F.col(f"`{record_col}`").alias("record"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, record in enumerate(b.column(2).to_pylist()):
                turns = turns_of(record)
                rows += [(i, k, role, text, False) for k, (role, text) in enumerate(turns)] if turns else [(i, -1, "", "", turns is None)]
            source, part, role, text, unmapped = ([r[k] for r in rows] for k in range(5))
            at = pa.array(source, pa.int64())
            columns = [b.column(0).take(at), b.column(1).take(at), pa.array(part, pa.int32()), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(unmapped, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "part", "role", "text", "unmapped"])

    return read.mapInArrow(convert, f"conv_id {kinds[id_col]}, turn {kinds[order_col]}, part int, role string, text string, unmapped boolean")


def escaped(text: Column) -> Column:
    """Every backslash doubled, and one put behind the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """Adds ``block``, a turn's part of its conversation's text, and the loss mask within it, [loss_from, loss_to)."""
    role = F.replace(escaped(text_of("role")), F.lit("\n"), F.lit("\\\n"))
    text = escaped(text_of("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    start, assistant = F.length(head), F.coalesce(F.col("role"), F.lit("")) == "assistant"
    return turns.select(
        "*", F.concat(head, text, F.lit(END)).alias("block"), start.alias("loss_from"), F.when(assistant, start + F.length(text)).otherwise(start).alias("loss_to")
    )


_BLOCK = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parsed(output: str) -> list[tuple[str, str]]:
    """(role, text) of formatted text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _BLOCK.finditer(output)]


def read_back(blocks: DataFrame) -> DataFrame:
    """Digests of every conversation from its formatted blocks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, unmapped.

    ``unmapped`` counts the records without a known mapping; a conversation of them alone has no turns.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "part", "role", "text"]
    ordered = blocks.repartition("conv_id").sortWithinPartitions(*order)
    rows = ordered.select("conv_id", "block", "loss_from", "loss_to", "part", "unmapped")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, state = None, None

        def close() -> None:
            turns, loss, n, loss_chars, chars, without = state
            done.append((current[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, without))

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "unmapped"]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
            done.clear()
            return out

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for conv, block, a, z, part, without in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if current != (conv,):
                    if current is not None:
                        close()
                    current, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                if part < 0:
                    state[5] += without
                    continue
                for role, text in parsed(block):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[2] += 1
                masked = unescaped(block[a:z])
                state[1].update(masked.encode())
                state[3] += len(masked)
                state[4] += len(block)
            if done:
                yield flush()
        if current is not None:
            close()
            yield flush()

    return rows.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, unmapped long")
