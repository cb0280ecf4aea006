"""Chat formatting by incremental black-box rendering.

A template is a function from the turns of a conversation to one text; nothing else is known of it.  Successive
prefixes of a conversation are rendered and neighbouring outputs compared: what the longer one adds is the turn's
span, and a second rendering with a probe in place of the turn's text tells markup from text inside the span.  Where
the longer output does not begin with the shorter one, the template has rewritten history at that turn; texts are then
located in the final output, by probes alone, and a text that cannot be located is left out of the loss mask.

``Template`` may state how many earlier turns a turn's markup depends on (``context``); its conversations stream
through a task whatever their length, as prefixes longer than WINDOW turns start anew.  Without that statement every
prefix is rendered whole, which takes time in the square of a conversation's length, and a conversation must fit into
memory, as the row that holds it must.

``MARKED`` is the template of the query.  It marks every turn, and puts a backslash behind the first character of each
control string inside a text and before each backslash, so texts can neither end a turn nor start one and are read
back as they were.

Edge cases: a null text is empty, a null role is the empty role; a null conv_id names one conversation; rows go by
turn (null first), of equal turn by role and text, and repeated rows are turns of their own; further columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import table

Turn = tuple[str, str]
LEARNED = "assistant"
#: Turns that are rendered from their conversation's start before a template of stated context starts anew.
WINDOW = 64
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_READ = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>", re.DOTALL)


@dataclass(frozen=True)
class Template:
    """render: turns to text; unescape: undoes what it does to a text; context: the earlier turns that a turn's markup depends on."""

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str] = str
    context: int | None = None


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render_marked(turns: list[Turn]) -> str:
    parts = ["<s>"]
    for role, text in turns:
        text = escape(text)
        if role == "system":
            parts.append(f"[SYS]{text}[/SYS]")
        elif role == "user":
            parts.append(f"[INST]{text}[/INST]")
        elif role == "assistant":
            parts.append(f"{text}</s>")
        else:
            parts.append(f"[ROLE]{escape(role)}[/ROLE]{text}</s>")
    return "".join(parts)


def read_marked(formatted: str) -> list[Turn]:
    """The turns of an output of ``MARKED``, or of some of its spans."""
    at, out = 3 if formatted.startswith("<s>") else 0, []
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        if m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["other"])))
        else:
            out.append((m.lastgroup, unescape(m[m.lastgroup])))
        at = m.end()
    return out


MARKED = Template(render_marked, unescape, 0)


def _probe(text: str) -> str:
    """A character of private use that the text lacks."""
    return next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)


def _between(other: str, probe: str, whole: str, least: int = 0) -> tuple[int, int] | None:
    """Where ``whole`` has what ``other`` has the probe for; none if they differ elsewhere."""
    at = other.find(probe, least)
    if at < 0:
        return None
    end = len(whole) - (len(other) - at - len(probe))
    return (at, end) if end >= at and whole[:at] == other[:at] and whole[end:] == other[at + len(probe) :] else None


class Rendering:
    """One conversation, rendered prefix by prefix. ``add`` gives a turn's span as (part, start, text start, text end)."""

    def __init__(self, template: Template):
        self.template, self.turns = template, []
        self.out = template.render([])
        self.chars, self.count = len(self.out), 0
        self.rewritten: list[int] = []

    def add(self, role: str, text: str) -> tuple[str, int, int | None, int | None]:
        render, before = self.template.render, self.out
        after = render([*self.turns, (role, text)])
        if not after.startswith(before):
            if self.template.context is not None:
                raise ValueError("a template of stated context rewrites history")
            self.rewritten.append(self.count)
        probe = _probe(before)
        found = _between(render([*self.turns, (role, probe)]), probe, after, min(len(before), len(after)) if not self.rewritten else 0)
        start = self.chars
        move = start - len(before)
        part = after[len(before) :]
        self.turns.append((role, text))
        self.out, self.chars, self.count = after, start + len(part), self.count + 1
        if self.template.context is not None and len(self.turns) > WINDOW + self.template.context:
            self.turns = self.turns[len(self.turns) - self.template.context :]
            self.out = render(self.turns)
        return part, start, *((found[0] + move, found[1] + move) if found else (None, None))


def format_conversation(template: Template, turns: list[Turn]) -> tuple[str, list[tuple], list[int]]:
    """The output, each turn's (role, start, end, text start, text end), and the turns at which history was rewritten.

    With rewritten history a turn's span is that of its text, null where it cannot be located.
    """
    r = Rendering(template)
    first, parts, spans = r.out, [], []
    for role, text in turns:
        part, start, a, b = r.add(role, text)
        parts.append(part)
        spans.append((role, start, start + len(part), a, b))
    if not r.rewritten:
        return first + "".join(parts), spans, []
    whole = r.out
    probe, spans = _probe(whole), []
    for k, (role, _) in enumerate(turns):
        found = _between(template.render([*turns[:k], (role, probe), *turns[k + 1 :]]), probe, whole) or (None, None)
        spans.append((role, *found, *found))
    return whole, spans, r.rewritten


def _ordered(chats: DataFrame) -> DataFrame:
    """conv_id, role, text: conversations dealt to tasks, the turns of each in order."""
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable[[], object]) -> Iterator[tuple[object, object]]:
    """(conv_id, state) of each conversation, its turns given to state.add in order."""
    now, state = None, None
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or conv != now:
                if state is not None:
                    yield now, state
                now, state = conv, start()
            state.add(role, text)
    if state is not None:
        yield now, state


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


class _Held:
    def __init__(self):
        self.turns: list[Turn] = []

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))


def format_chats(chats: DataFrame, template: Template = MARKED) -> DataFrame:
    """conv_id, formatted, spans (role, start, end, text_start, text_end, learned) and rewritten, a row for each conversation.

    Bounds are in code points; the loss mask is the text of the spans that are ``learned``.
    """
    kind = chats.schema["conv_id"].dataType.simpleString()
    ints = ("start", "end", "text_start", "text_end")
    span = pa.struct([("role", pa.string()), *[(c, pa.int64()) for c in ints], ("learned", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(conv_type):
            for conv, held in _conversations(batches, _Held):
                text, spans, rewritten = format_conversation(template, held.turns)
                yield conv, text, [dict(zip(("role", *ints), s)) | {"learned": s[0] == LEARNED and s[3] is not None} for s in spans], rewritten

        shape = pa.schema([("conv_id", conv_arrow), ("formatted", pa.string()), ("spans", pa.list_(span)), ("rewritten", pa.list_(pa.int32()))])
        yield from _batched(rows(conv_arrow), shape)

    conv_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    out = f"conv_id {kind}, formatted string, spans array<struct<role string, {', '.join(f'{c} bigint' for c in ints)}, learned boolean>>, rewritten array<int>"
    return _ordered(chats).mapInArrow(run, out)


class _Digest:
    """Reads a conversation back from its output, span by span: sums and digests of turns and of what is learned."""

    def __init__(self, template: Template = MARKED):
        self.rendering = Rendering(template)
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars = 0, 0

    def add(self, role: str, text: str) -> None:
        part, start, a, b = self.rendering.add(role, text)
        for role_read, text_read in read_marked(part):
            self.n += 1
            self.all.update(f"{role_read}\n{text_read}\n".encode("utf-8", "surrogatepass"))
            if role_read == LEARNED and a is not None:
                learned = unescape(part[a - start : b - start])
                self.loss_chars += len(learned)
                self.loss.update(learned.encode("utf-8", "surrogatepass"))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation's output under ``MARKED``.

    Turns stream through their task; no conversation is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, d.n, d.all.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.rendering.chars) for c, d in _conversations(batches, _Digest))
        yield from _batched(rows, shape, 4096)

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    shape = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    return _ordered(chats).mapInArrow(run, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'bigint'}" for n in names))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def _sql() -> str:
    length = "replace(text, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        length = f"replace({length}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    role = length.replace("(text,", "(role,", 1)
    return f"""
WITH chats AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length({length}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
    ELSE 17 + length({role}) END AS n FROM chats)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


SQL = _sql()
