"""Chat formatting by schema fingerprints.

A record's nested field paths, without list positions, are hashed into a
fingerprint of its layout. Each known layout is a declarative mapping from
paths to turns; its fingerprints (with and without optional fields) are known
beforehand, so that a record's mapping is one lookup. Where that finds nothing,
fields that no mapping knows are left out of a second fingerprint: ids, names
and other extra fields don't hide a layout. Records become canonical
turns, and turns become one text in which markers stand around every turn and
control strings inside roles and texts are escaped reversibly. The loss mask
is the spans of the assistant's texts.

Null records, broken or too deeply nested JSON, lists that mix messages with
anything else, and unknown layouts give no turns and the layout `unknown`. Null
texts are empty and null roles too. Halves of surrogate pairs become U+FFFD. Turns are in the order of
`turn`, then role and text where that ties or is null (nulls first); repeated
rows are turns of their own. Null conv_ids form one conversation. An empty
table gives an empty result. Other columns are ignored."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: Other names of canonical roles in layouts that use them.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: (role, paths) where the paths' texts, joined by blank lines, are one
    turn; or a list path with the names of role and text in its items."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    renames: bool = False


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",),
            (("system", ("system",)),), ("conversations", "from", "value"), True),
    Mapping("prompt", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", ("question", "answer"), ("system",), (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)


_NAME = re.compile(r"[\\.\[\]]")


def field_paths(record: object) -> set[str]:
    """Paths of all leaves, list positions left out; empty lists and objects have
    none. Signs of a path are escaped where a field's name holds them."""
    found, open_ = set(), [(record, "")]
    while open_:
        value, at = open_.pop()
        if isinstance(value, dict):
            for name, inner in value.items():
                name = _NAME.sub(r"\\\g<0>", name)
                open_.append((inner, f"{at}.{name}" if at else name))
        elif isinstance(value, list):
            open_ += [(inner, f"{at}[]") for inner in value]
        else:
            found.add(at)
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def known_layouts(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    found: dict[str, Mapping] = {}
    for mapping in mappings:
        for n in range(len(mapping.optional) + 1):
            for more in itertools.combinations(mapping.optional, n):
                found[fingerprint({*mapping.required, *more})] = mapping
    return found


def known_paths(layouts: dict[str, Mapping]) -> set[str]:
    return {path for mapping in layouts.values() for path in (*mapping.required, *mapping.optional)}


def mapping_of(paths: set[str], layouts: dict[str, Mapping]) -> Mapping | None:
    """By the whole fingerprint, by that of the known paths, or else the first
    mapping whose required paths are all there."""
    exact = layouts.get(fingerprint(paths)) or layouts.get(fingerprint(paths & known_paths(layouts)))
    return exact or next((m for m in layouts.values() if paths.issuperset(m.required)), None)


def _text(value: object) -> str:
    if isinstance(value, str):
        return value if value.isprintable() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None, layouts: dict[str, Mapping]) -> tuple[str, str, list[tuple[str, str]]]:
    """Fingerprint, layout and turns of one JSON record."""
    try:
        value = json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return "", "unknown", []
    paths = field_paths(value)
    mark, mapping = fingerprint(paths), mapping_of(paths, layouts)
    if mapping is None:
        return mark, "unknown", []
    turns = []
    for role, parts in mapping.turns:
        said = [_text(value[p]) for p in parts if p in paths]
        said = [said[0], *(p for p in said[1:] if p)] if said else []
        if said:
            turns.append((role, "\n\n".join(said)))
    if mapping.items:
        name, role, text = mapping.items
        if not all(isinstance(item, dict) for item in value[name]):
            return mark, "unknown", []
        for item in value[name]:
            cells = [item.get(role), item.get(text)]
            if any(isinstance(cell, dict | list) for cell in cells):
                return mark, "unknown", []
            said = _text(cells[0])
            turns.append((ROLES.get(said, said) if mapping.renames else said, _text(cells[1])))
    return mark, mapping.name, turns


#: `<turn ` opens a turn and `</turn>` closes it. Backslashes are doubled and the
#: `<` of a control string becomes `\l`, so neither occurs inside a text.
_CONTROL = re.compile(r"<(?=/?turn)")
_ROLE = {"\\": "\\\\", "<": "\\l", ">": "\\g", "\n": "\\n"}
_BACK = {"\\\\": "\\", "\\l": "<", "\\g": ">", "\\n": "\n"}
_ESCAPED = re.compile(r"\\[\\lgn]")
_TURN = re.compile(r"<turn ([^>]*)>\n(.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\l", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m.group()], text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the loss mask as spans of code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"<turn {''.join(_ROLE.get(c, c) for c in role)}>\n"
        body = escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


FORMATTED = (
    "conv_id long, schema_id string, layout string, formatted string, loss_spans array<struct<start:int,stop:int>>"
)


def format_chats(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records: conv_id and record, a JSON text of any known layout."""
    layouts = known_layouts(mappings)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    names = ["conv_id", "schema_id", "layout", "formatted", "loss_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mark, layout, turns = canonical(record.as_py(), layouts)
                text, spans = render(turns)
                rows.append((conv_id, mark, layout, text, [{"start": a, "stop": b} for a, b in spans]))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return in_small_batches(records).select(F.col("conv_id").cast("long"), "record").mapInArrow(run, FORMATTED)


READ = "turns array<struct<role:string,text:string>>, learned array<string>"


def read_back(formatted: Column, spans: Column) -> Column:
    """The turns of a formatted text, and the unescaped texts under its mask."""

    @F.pandas_udf(READ)
    def read(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
        turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in formatted]
        learned = [[unescape(x[s["start"] : s["stop"]]) for s in each] for x, each in zip(formatted, spans, strict=True)]
        return pd.DataFrame({"turns": turns, "learned": learned})

    return read(formatted, spans)


def from_rows(conversations: DataFrame) -> DataFrame:
    """conv_id and record, from one row per turn. A question and its answer are a
    `prompt` record, with a system turn before them an `instruction` record; all
    others are `messages`."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(said)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    whole = conversations.groupBy("conv_id").agg(messages.alias("messages"))
    roles = F.transform("messages", lambda x: x["role"])
    is_made_of = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda i: F.col("messages")[i]["content"]
    record = (
        F.when(is_made_of("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(is_made_of("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .otherwise(F.to_json(F.struct("messages")))
    )
    return whole.select("conv_id", record.alias("record"))


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)
