"""Chat formatting by schema fingerprints.

Records arrive as JSON in whatever layout. The paths of a record's nested fields (array places
left out) are hashed with the kind of what they lead to; of these, the ones that mappings name
make the record's fingerprint, which picks a declarative mapping: a list of turns with role and
text fields, or fixed fields with fixed roles. So further fields (an id, a source, a name in one
message) do not hide a layout. Of the mappings whose fields a record has, the one that names most
fields wins, then the first. Records of a layout without a mapping keep their JSON and no turns
(``mapped`` false), so that mappings can be added; none is dropped.

The template marks each turn as ``### Role: text</turn>`` and a line feed. Within roles and
texts a backslash, ``###`` and ``</turn>`` are escaped, so a text cannot make a turn and
``parse`` gives back what went in. The loss mask covers the texts of assistant turns only.

Turns of a conversation are ordered by turn (null first), then role, then text; repeated rows
stay as repeated turns. Null texts are empty, null roles are the empty role, null elements in a
list of turns are turns of an empty role and text. Each row without a conversation's id is a
conversation of its own. Records that are no JSON objects, or nested too deeply to be read, have
no layout. Lone surrogates become U+FFFD. Very long texts are formatted whole. An empty table gives
no rows. Columns of ``keep`` that are named as results are replaced by them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mappings: either ("list", path, role field, text field, role names) or ("fields", ((path, role), ...)).
#: Paths have one field a part. ``a+b`` joins two fields' texts; those after ? may be missing.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS: tuple[tuple, ...] = (
    ("list", "messages", "role", "content", {}),
    ("list", "conversations", "from", "value", ROLES),
    ("list", "dialog", "speaker", "text", ROLES),
    ("fields", (("prompt", "user"), ("response", "assistant"))),
    ("fields", (("prompt", "user"), ("completion", "assistant"))),
    ("fields", (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    ("fields", (("instruction", "user"), ("output", "assistant"))),
    ("fields", (("instruction+input", "user"), ("output", "assistant"))),
    ("fields", (("question", "user"), ("answer", "assistant"))),
    ("fields", (("data.question", "user"), ("data.answer", "assistant"))),
)
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}
BACK = {v: k for k, v in ROLE_ESCAPES.items()}
_OUT = re.compile(r"\\|###|</turn>")
_ROLE_OUT = re.compile(r"\\|###|</turn>|:")
_IN = re.compile(r"\\[\\hec]")
_TURN = re.compile(r"### ((?:[^:\\]|\\.)*): (.*?)</turn>\n", re.S)


LIST, RECORD = "[]", "{}"
Path = tuple[str, ...]


def paths(value) -> set[Path]:
    """All paths of fields of a nested value, part by part; LIST stands for the places of
    an array, RECORD below it says that one of them holds fields."""
    found: set[Path] = set()
    todo: list[tuple[Path, object]] = [((), value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                found.add((*at, k))
                todo.append(((*at, k), x))
        elif isinstance(v, list):
            found.add((*at, LIST))
            if any(isinstance(x, dict) for x in v):
                found.add((*at, LIST, RECORD))
            todo += [((*at, LIST), x) for x in v if isinstance(x, dict | list)]
    return found


def fingerprint(found: set[Path]) -> str:
    """A hash of field paths, in which no two sets look alike."""
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()[:16]


def named(mapping: tuple) -> set[Path]:
    """The paths that a mapping needs."""
    if mapping[0] == "list":
        return {(*mapping[1].split("."), LIST)}
    return {tuple(p.split(".")) for path, _ in mapping[1] for p in path.split("+")}


class Mappings:
    """Picks the mapping of a record by its fingerprint over the paths that mappings name."""

    def __init__(self, layouts: tuple[tuple, ...]):
        self.layouts = [(m, named(m), self.turn_fields(m)) for m in layouts]
        self.known = {p for _, need, more in self.layouts for p in need | more}
        self.made: dict[str, tuple | None] = {}

    @staticmethod
    def turn_fields(mapping: tuple) -> set[Path]:
        return {(*mapping[1].split("."), LIST, f) for f in (*mapping[2:4], RECORD)} if mapping[0] == "list" else set()

    def pick(self, record) -> tuple[str, tuple | None]:
        found = paths(record) & self.known if isinstance(record, dict) else set()
        mark = fingerprint(found)
        if mark not in self.made:
            # turns that hold fields must hold their text; a list may also be empty or of texts or nulls alone
            fits = [(len(need) + len(more & found), -i, m) for i, (m, need, more) in enumerate(self.layouts) if need <= found and (not more & found or any(p[-1] == m[3] for p in more & found))]
            self.made[mark] = max(fits)[2] if fits else None
        return mark, self.made[mark]


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _clean(s: str) -> str:
    """Lone surrogates have no UTF-8."""
    return s.encode("utf-8", "replace").decode() if not s.isascii() and any("\ud800" <= c <= "\udfff" for c in s) else s


def _get(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def turns_of(record, mapping: tuple) -> list[tuple[str, str]]:
    if mapping[0] == "list":
        _, path, role, text, names = mapping
        turns = [t if isinstance(t, dict) else {text: t} for t in _get(record, path)]
        return [(names.get(_text(t.get(role)), _text(t.get(role))), _text(t.get(text))) for t in turns]
    out = []
    for path, role in mapping[1]:
        parts = [_text(_get(record, p)) for p in path.split("+")]
        text = "\n\n".join(p for p in parts if p)
        if text or role != "system":
            out.append((role, text))
    return out


def escape(s: str) -> str:
    return _OUT.sub(lambda m: ESCAPES[m[0]], s)


def unescape(s: str) -> str:
    return _IN.sub(lambda m: BACK[m[0]], s)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans under the loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {_ROLE_OUT.sub(lambda m: ROLE_ESCAPES[m[0]], role)}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        part = f"{head}{body}</turn>\n"
        out.append(part)
        at += len(part)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


OUT = "fingerprint string, mapped boolean, formatted string, loss_mask array<struct<start:bigint,stop:bigint>>"


def format_records(records: DataFrame, *, keep: list[str], record: str = "record", layouts: tuple[tuple, ...] = LAYOUTS) -> DataFrame:
    """One row for each JSON record: ``keep``, fingerprint, mapped, formatted, loss_mask (code
    points). ``layouts`` are the mappings, to which others can be added."""
    keep = [c for c in keep if c not in ("fingerprint", "mapped", "formatted", "loss_mask")]
    src = records.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{record}`").alias("__record"))
    schema = src.drop("__record").schema
    for f in records.sparkSession.createDataFrame([], OUT).schema:
        schema = schema.add(f)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappings = Mappings(layouts)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(len(keep)).to_pylist():
                try:
                    value = json.loads(text or "")
                    mark, mapping = mappings.pick(value)
                    turns = [(_clean(r), _clean(t)) for r, t in turns_of(value, mapping)] if mapping else []
                except (ValueError, RecursionError):
                    (mark, mapping), turns = mappings.pick(None), []
                formatted, mask = render(turns) if mapping else (text, [])
                for col, v in zip(cols, (mark, mapping is not None, formatted, [{"start": a, "stop": b} for a, b in mask]), strict=True):
                    col.append(v)
            made = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(cols[3], span)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def conversation_records(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): turns of a conversation as a JSON record of messages. A record is one
    conversation, so its size is that of the conversation."""
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("content"))
    named_rows = rows.where(F.col(f"`{conv_id}`").isNotNull())
    turns = named_rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    alone = rows.where(F.col(f"`{conv_id}`").isNull()).select(F.col(f"`{conv_id}`").alias("conv_id"), F.array(one).alias("t"))
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return turns.unionByName(alone).select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    made = format_records(conversation_records(rows.unionByName(more)), keep=["conv_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for formatted, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[m["start"] : m["stop"]]) for m in mask)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                for col, v in zip(cols, (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], names=names)

    return made.select("conv_id", "formatted", "loss_mask").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
