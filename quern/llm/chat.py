"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is a set of nested field paths, of a record or of a table's schema, and its hash is the
fingerprint. A registry holds the fingerprints of all declared layouts, with and without their optional
fields, and the mapping of each: where the turns are and which fields hold role and text. Turns are
then written with a template whose control strings are escaped inside texts, so that the
formatted stream can be read back exactly, with a loss mask over assistant texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm._spark import map_partitions

#: Marks of the template; and control strings of common templates, escaped as well.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Role names of other layouts and their canonical form.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"(?s)\\(.)")


def escape(text: str) -> str:
    """Backslashes doubled, and a backslash put behind the first character of control strings."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\!" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "" if m[1] == "!" else m[1], text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{BODY}{escape(text)}{END}"


_TURN = re.compile(f"(?s){re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}")


def read_turns(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, text, place of the escaped text) of every turn of a formatted stream."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2]), m.span(2)


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """The loss mask: places of assistant texts."""
    return [span for role, _, span in read_turns(formatted) if role == "assistant"]


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a decoded JSON value; list elements add ``[]``, nulls add nothing."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at} if value is not None else set()


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same of a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {at}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Declares where the turns of a layout are.

    With ``turns`` that field lists the turns and ``role`` and ``text`` are fields of each;
    without, ``fixed`` lists (role, fields) in order, the present fields joined by a newline.
    ``needs`` are the paths that make the layout, ``may`` those it may have besides.
    """

    needs: frozenset[str]
    may: frozenset[str] = frozenset()
    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def apply(self, record: dict) -> list[tuple[str, str]]:
        if self.turns:
            return [(canonical_role(x.get(self.role)), _text(x.get(self.text))) for x in record.get(self.turns) or [] if isinstance(x, dict)]
        found = []
        for role, fields in self.fixed:
            present = [_text(record[f]) for f in fields if record.get(f) not in (None, "")]
            if present or role == "assistant":
                found.append((role, "\n".join(present)))
        return found

    def fingerprints(self) -> Iterator[str]:
        """Of the layout with each choice of its optional paths."""
        for n in range(len(self.may) + 1):
            for chosen in combinations(sorted(self.may), n):
                yield fingerprint(self.needs.union(chosen))


def canonical_role(role) -> str:
    role = "" if role is None else str(role)
    return ROLES.get(role, role)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _listed(turns: str, role: str, text: str) -> Mapping:
    return Mapping(frozenset({f"{turns}[].{role}", f"{turns}[].{text}"}), turns=turns, role=role, text=text)


def _fields(*fixed: tuple[str, tuple[str, ...]]) -> Mapping:
    """The last field of user and assistant must be there, all others may."""
    needs = frozenset(fields[-1] for role, fields in fixed if role != "system")
    return Mapping(needs, frozenset(f for _, fields in fixed for f in fields) - needs, fixed=fixed)


#: Layouts of records. A record may have further fields of any other name.
MAPPINGS = (
    _listed("messages", "role", "content"),
    _listed("conversations", "from", "value"),
    _listed("turns", "role", "text"),
    _fields(("system", ("system",)), ("user", ("input", "instruction")), ("assistant", ("output",))),
    _fields(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))),
    _fields(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))),
    _fields(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
)


@dataclass(frozen=True)
class Columns:
    """A table's layout with one row per turn: the columns of conversation, order, role and text."""

    conv: str
    turn: str
    role: str
    text: str

    @property
    def needs(self) -> frozenset[str]:
        return frozenset((self.conv, self.turn, self.role, self.text))

    def fingerprints(self) -> Iterator[str]:
        yield fingerprint(self.needs)


#: Layouts of tables. A table may have further columns of any other name.
ROW_MAPPINGS = (Columns("conv_id", "turn", "role", "text"), Columns("conversation_id", "position", "from", "value"), Columns("thread_id", "message_index", "role", "content"))


class Registry:
    """Mappings by fingerprint.

    Paths that no declared layout has are left out before they are hashed, so further fields
    don't matter. What is left is looked up by its hash. A hash that isn't there has fields of several
    layouts, or not all of one: of the layouts it has in full the one of most needed fields counts, the
    first declared among equals, and is remembered under the hash.
    """

    def __init__(self, mappings: Iterable = MAPPINGS):
        self.mappings = tuple(mappings)
        self.vocabulary = frozenset().union(*(m.needs | getattr(m, "may", frozenset()) for m in self.mappings))
        self.known: dict[str, object] = {}
        for m in self.mappings:
            for f in m.fingerprints():
                self.known.setdefault(f, m)
        self.declared = len(self.known)

    def select(self, paths: set[str]):
        """The mapping of a layout, None where no declared one is there in full."""
        paths = self.vocabulary.intersection(paths)
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) > self.declared + 10_000:
                self.__init__(self.mappings)
            self.known[key] = max((m for m in self.mappings if m.needs <= paths), key=lambda m: len(m.needs), default=None)
        return self.known[key]


def canonical_turns(records: DataFrame, key: str = "id", record: str = "record") -> DataFrame:
    """(id, layout, turn, role, text) from JSON records of mixed layouts, one row per turn.

    ``layout`` is the fingerprint of all the record's paths. A record of an unknown layout, a null one or one
    that is no JSON object gives one row with null turn, role and text, so nothing is dropped.
    """

    def run(batches):
        registry = Registry()
        for batch in batches:
            rows: list[tuple] = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    value = json.loads(raw.as_py() or "")
                except ValueError:
                    value = None
                paths = field_paths(value) if isinstance(value, dict) else set()
                mapping = registry.select(paths) if paths else None
                turns = mapping.apply(value) if mapping else []
                layout = fingerprint(paths)
                rows += [(i, layout, k, r, t) for k, (r, t) in enumerate(turns)] or [(i, layout, None, None, None)]
            columns = zip(*rows) if rows else ([],) * 5
            kinds = (batch.column(0).type, pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "layout", "turn", "role", "text"])

    kind = records.schema[key].dataType.simpleString()
    return map_partitions(records.select(key, record), run, f"id {kind}, layout string, turn long, role string, text string")


def table_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table with one row per turn, its mapping found by its schema's fingerprint.

    Further columns are ignored. Of two layouts that are there in full the one declared first
    counts; an unknown layout is an error.
    """
    paths = schema_paths(rows.schema)
    found = Registry(ROW_MAPPINGS).select(paths)
    if found is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return rows.select(F.col(found.conv).cast("long").alias("conv_id"), F.col(found.turn).cast("long").alias("turn"), F.col(found.role).alias("role"), F.col(found.text).alias("text"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted) in the template: ``turns`` (conv_id, turn, role, text) row by row.

    A conversation's stream is its rows' ``formatted`` in order of turn, so a long one is never
    held as a whole. Null roles and texts are empty.
    """

    def run(batches):
        for b in batches:
            texts = [format_turn(r.as_py() or "", t.as_py() or "") for r, t in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string())], ["conv_id", "turn", "role", "formatted"])

    return map_partitions(turns.select("conv_id", "turn", "role", "text"), run, "conv_id long, turn long, role string, formatted string")


class _Reader:
    """Running digests of one conversation, read back from its formatted turns."""

    def __init__(self):
        self.turns = self.loss = self.size = 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.size += len(formatted)
        for role, text, _ in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for a, b in loss_spans(formatted):
            text = unescape(formatted[a:b])
            self.loss += len(text)
            self.learned.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.size


def formatted_digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output.

    Rows are dealt by conversation and sorted by turn (ties: role, then text), then formatted
    and read as a stream: a task holds one Arrow batch and one conversation's running
    digests, however long the conversation. A digest of a conversation's turns in order is sequential,
    so one conversation is one task's; its sort spills to disk.
    """
    formatted = format_conversations(
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        current, reader, rows = None, None, []
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(3)):
                if reader is None or conv != current:
                    if reader is not None:
                        rows.append((current, *reader.row()))
                    current, reader = conv, _Reader()
                reader.add(text.as_py())
            if rows:
                yield table(rows)
                rows = []
        if reader is not None:
            yield table([(current, *reader.row())])

    return map_partitions(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def sql() -> str:
    """DuckDB SQL for the query over ``conversations`` and conversation -7."""
    escaped = "replace({}, chr(92), chr(92) || chr(92))"
    extra = " + ".join(f"2 * ((length(t) - length(replace(t, '{c}', ''))) // {len(c)})" for c in CONTROL)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length({escaped.format("t")}) + {extra} + length(role) + {len(TURN + BODY + END)} AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
