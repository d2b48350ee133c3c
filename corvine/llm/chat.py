"""Operator 12: chat formatting by incremental black-box rendering.

A template is a function from a list of turns to one text; nothing is known of what it does inside. For each turn
the turns before it and the same turns with it are rendered, and the two outputs compared: where the longer one
continues the shorter one, what is new is the turn's span; where it does not, the template rewrites history. A
second rendering, with one rare character in place of the turn's text, shows where in the span the text stands,
which gives the loss mask of the roles that are learned.

A template may state its `lookback`: how many turns before a turn decide what it adds. Then only those are
rendered again, so that work and memory do not grow with a conversation's length. Without it all earlier turns
are. A stated lookback is checked against whole renderings of every conversation of up to CHECKED turns.

Rows are dealt to tasks by ranges of (conv_id, turn), so that one conversation of any length is spread over tasks
like any other rows. A task formats all it can: what it cannot know, because a conversation may have begun in the
task before it, are the first `lookback` turns of its first conversation. These travel raw, with the formatted
parts of its first and its last conversation, to one place for each conversation, where the parts are joined in
order; all others are complete after the first task.

Cases: rows are in order of turn, then role, then text; NULL turns come first. NULL roles and texts are empty. Rows
that repeat a turn are turns of their own. Rows with NULL conv_id are one conversation. A table without rows
gives none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from corvine.llm.textkit import batches_of

Turn = tuple[str, str]

#: A character that stands for a turn's text while its place is looked for; texts may hold it all the same.
PROBE = "\ue000"
#: Turns up to which a stated lookback is checked against the rendering of the whole conversation.
CHECKED = 16
#: Characters from which a long conversation is cut into parts, at the ends of turns.
PART_CHARS = 1 << 21
#: Rows of output of a task that are handed on at once.
BATCH_ROWS = 512


@dataclass(frozen=True)
class Template:
    """render: turns to text. unescape: what the template does to a text inside a turn, undone. lookback: see above."""

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str] = str
    lookback: int | None = None


# --- a template: [INST] marks, control strings in texts escaped ---

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
_ESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROLS))
_ENDS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": (" ", "</s>")}
_OTHER_END = "[/TURN]"


def escape(text: str) -> str:
    """One more backslash inside each control string, however many there are."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render_inst(turns: list[Turn]) -> str:
    out, before = [], "assistant"
    for role, text in turns:
        if before == "assistant":
            out.append("<s>")
        head, tail = _ENDS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", _OTHER_END)
        out += [head, escape(text), tail]
        before = role
    return "".join(out)


def parse_inst(text: str) -> Iterator[Turn]:
    """The turns of a formatted text, by its marks alone."""
    at = 0
    while at < len(text):
        if text.startswith("<s>", at):
            at += 3
        role, head, tail = "assistant", *_ENDS["assistant"]
        for name in ("user", "system"):
            if text.startswith(_ENDS[name][0], at):
                role, (head, tail) = name, _ENDS[name]
        if text.startswith("[ROLE]", at):
            end = text.index("[/ROLE]", at)
            role, head, tail = unescape(text[at + 6 : end]), text[at : end + 7], _OTHER_END
        start = at + len(head)
        end = text.index(tail, start)
        yield role, unescape(text[start:end])
        at = end + len(tail)


INST = Template(render_inst, unescape, lookback=1)


# --- rendering ---


class Renderer:
    """Formats turns that follow each other: the text so far, a span for each turn, the turns that decide the next."""

    def __init__(self, template: Template, before: list[Turn], number: int) -> None:
        """before: the turns ahead of the first one, `lookback` of them or all. number: that of the first, from 0;
        only what it is told of rewriting depends on it."""
        self.template, self.context, self.number = template, before, number
        self.text, self.spans, self.turns, self.rewrites = "", [], 0, None

    def add(self, turn: Turn) -> None:
        t = self.template
        before, now = t.render(self.context) if self.context else "", [*self.context, turn]
        after = t.render(now)
        if after.startswith(before):
            piece, base = after[len(before) :], len(self.text)
            place = self._place(before, turn[0], piece)
            self.spans.append((turn[0], base, base + len(piece), *[None if p is None else base + p for p in place]))
            self.text += piece
        elif t.lookback is not None:
            raise ValueError("a template with a lookback must not rewrite earlier turns")
        else:  # what was known of earlier places no longer holds
            self.rewrites = self.number + self.turns if self.rewrites is None else self.rewrites
            self.text, self.spans = after, []
        self.turns += 1
        self.context = now if t.lookback is None else now[max(0, len(now) - t.lookback) :]

    def _place(self, before: str, role: str, piece: str) -> tuple:
        """Where in its span the turn's text stands; NULLs where the rest of the span changes with the text."""
        shown = self.template.render([*self.context, (role, PROBE)])
        head, probe, tail = shown[len(before) :].partition(PROBE)
        fits = shown.startswith(before) and probe and len(piece) >= len(head) + len(tail)
        return (len(head), len(piece) - len(tail)) if fits and piece.startswith(head) and piece.endswith(tail) else (None, None)


_SPAN = ("role", "start", "end", "text_start", "text_end")
_SPANS = pa.list_(pa.struct([(k, pa.string() if k == "role" else pa.int64()) for k in _SPAN]))
_PART = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("first_turn", pa.int64()),
        ("seq", pa.int64()),  # order of the parts of one task
        ("complete", pa.bool_()),  # the whole conversation
        ("raw", pa.string()),  # turns ahead of the text that lack their context, as JSON
        ("tail", pa.string()),  # the last turns, which decide what the next one adds
        ("text", pa.string()),
        ("spans", _SPANS),
        ("n_turns", pa.int64()),
        ("rewrites", pa.int64()),
    ]
)
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), *list(_PART)[6:]])
_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_READ = pa.schema([*_PART, *list(_DIGESTS)[2:]])


def _ddl(schema: pa.Schema) -> T.StructType:
    return from_arrow_schema(schema)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "")
        if len(held) >= BATCH_ROWS or size >= PART_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _parts_of(conv_id: int | None, turns: Iterator[tuple], template: Template, edge: bool, last: Callable[[], bool]) -> Iterator[dict]:
    """Parts of one conversation's turns in a task. edge: it may have begun in another; last: tells, when the turns
    have ended, whether it may go on in another."""
    look, raw, seen, first = template.lookback, [], [], None
    render, seq = Renderer(template, [], 0), 0

    def part(complete: bool) -> dict:
        return {
            "conv_id": conv_id,
            "first_turn": first,
            "seq": seq,
            "complete": complete,
            "raw": json.dumps(raw) if raw else None,
            "tail": None if complete else json.dumps(render.context),
            "text": render.text,
            "spans": [dict(zip(_SPAN, s, strict=True)) for s in render.spans],
            "n_turns": len(raw) + render.turns,
            "rewrites": render.rewrites,
        }

    for turn, said in turns:
        if look is not None and len(render.text) >= PART_CHARS:
            yield part(False)
            seq, raw, render = seq + 1, [], Renderer(template, render.context, 0)
        if not render.text and not raw:
            first = turn
        if len(seen) <= CHECKED:
            seen.append(said)
        if edge and len(raw) < look and not seq:  # its context is in another task
            raw.append(said)
            render = Renderer(template, list(raw), 0)
        else:
            render.add(said)
    complete = not (edge or seq or last())
    if complete and look is not None and len(seen) <= CHECKED and template.render(seen) != render.text:
        raise ValueError(f"the template does not keep to its lookback of {look}")
    yield part(complete)


def _format_task(template: Template) -> Callable:
    """Sorted turns of a task to parts. The first conversation may have begun, and the last may go on, in another
    task, unless the rows were dealt by conversation, as they are without a lookback."""
    whole = template.lookback is None

    def turns(batches) -> Iterator[tuple]:
        for batch in batches_of(batches, 3):
            ids, turn, roles, texts = (c.to_pylist() for c in batch.columns)
            for i, n, r, t in zip(ids, turn, roles, texts, strict=True):
                yield i, n, (r or "", t or "")

    def rows(batches) -> Iterator[dict]:
        ahead = turns(batches)
        row, edge = next(ahead, None), not whole
        while row is not None:
            conv_id = row[0]

            def own():
                nonlocal row
                while row is not None and row[0] == conv_id:  # noqa: B023  used up within this round
                    yield row[1:]
                    row = next(ahead, None)

            yield from _parts_of(conv_id, own(), template, edge, lambda: not whole and row is None)
            edge = False

    return lambda batches: _batches(rows(batches), _PART)


def _joined(rows: Iterator[dict], template: Template) -> Iterator[dict]:
    """Parts in order, with the place of each in its conversation; raw turns get their context from the part before."""
    now, tail, number, chars, turns = (), [], 0, 0, 0
    for r in rows:
        if r["conv_id"] != now:
            now, tail, number, chars, turns = r["conv_id"], [], 0, 0, 0
        if r["raw"]:
            render = Renderer(template, tail, turns)
            for said in json.loads(r["raw"]):
                render.add(tuple(said))
            shift = len(render.text)
            moved = [{k: v if k == "role" or v is None else v + shift for k, v in s.items()} for s in r["spans"]]
            r["text"], r["spans"] = render.text + r["text"], [dict(zip(_SPAN, s, strict=True)) for s in render.spans] + moved
            held = [*tail, *map(tuple, json.loads(r["raw"]))]
            if len(r["spans"]) == render.turns:  # nothing but raw turns: fewer than the lookback, perhaps
                r["tail"] = json.dumps(held[max(0, len(held) - template.lookback) :])
        tail = [tuple(x) for x in json.loads(r["tail"] or "[]")]
        yield r | {"part": number, "start": chars}
        number, chars, turns = number + 1, chars + len(r["text"] or ""), turns + r["n_turns"]


def _parts(conversations: DataFrame, template: Template) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartition("conv_id") if template.lookback is None else rows.repartitionByRange("conv_id", "turn")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format_task(template), _ddl(_PART))


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def format_conversations(conversations: DataFrame, template: Template = INST) -> DataFrame:
    """conversations: conv_id, turn, role, text. A row for each conversation, or for each part of a long one: conv_id,
    part (from 0), start (its first character in the whole), text, spans (role, start, end of each turn, and of its
    text, in this text), n_turns, and rewrites: the first turn, from 0, that changed what was rendered before it;
    there the text is that of all turns, and spans holds only the turns after the last such change."""
    parts = _parts(conversations, template)
    if template.lookback is not None:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "seq")
    return parts.mapInArrow(lambda batches: _batches(_joined(_rows(batches), template), _FORMATTED), _ddl(_FORMATTED))


class _Reading:
    """What formatted texts say when they are read back: turns, and what is learned from."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def read(self, text: str, spans: list[dict], template: Template, parse: Callable, learned: tuple[str, ...]) -> _Reading:
        for role, said in parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for s in spans:
            if s["role"] in learned:
                if s["text_start"] is None:
                    raise ValueError("the template changes marks with the text, so there is no loss mask")
                said = template.unescape(text[s["text_start"] : s["text_end"]])
                self.loss_chars += len(said)
                self.loss.update(said.encode())
        self.chars += len(text)
        return self

    def row(self) -> dict:
        return {
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


def read_back(
    conversations: DataFrame, template: Template = INST, parse: Callable = parse_inst, learned: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """What format_conversations makes, read back and digested: conv_id, n_turns, turns_sha256 (of role, line end,
    text, line end of each turn), loss_chars and loss_sha256 (of the texts of the learned roles), formatted_chars.
    Conversations that are complete in their first task are read there, so only their digests travel on."""

    def read_complete(batches):
        def rows():
            for r in _rows(batches):
                if r["complete"]:
                    r |= _Reading().read(r["text"], r["spans"], template, parse, learned).row()
                    r["text"] = r["spans"] = None
                yield r

        return _batches(rows(), _READ)

    def read_rest(batches):
        def rows():
            now, reading = (), None
            for r in _joined(_rows(batches), template):
                if reading and r["conv_id"] != now:
                    yield {"conv_id": now} | reading.row()
                    reading = None
                if r["complete"]:
                    yield r
                    continue
                now, reading = r["conv_id"], reading or _Reading()
                reading.read(r["text"], r["spans"], template, parse, learned)
            if reading:
                yield {"conv_id": now} | reading.row()

        return _batches(({k: r[k] for k in _DIGESTS.names} for r in rows()), _DIGESTS)

    read = _parts(conversations, template).mapInArrow(read_complete, _ddl(_READ))
    placed = read.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "seq")
    return placed.mapInArrow(read_rest, _ddl(_DIGESTS))


#: A conversation of texts that look like marks; it has to come back as it is.
TRAP = "</s>[INST] ok [/INST]"


def with_trap(spark: SparkSession, conversations: DataFrame, conv_id: int = -7) -> DataFrame:
    rows = [(conv_id, 0, "user", TRAP), (conv_id, 1, "assistant", TRAP)]
    trap = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(trap)
