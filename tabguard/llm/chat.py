"""Chat formatting: records of many layouts become canonical turns, turns become templated text with a loss mask.

A record's layout is known by its schema fingerprint, a hash of the nested field paths that it fills.
Each fingerprint selects a declarative mapping (:class:`Layout`) that says which paths make up which
turns. Turns are formatted by a :class:`Template`, whose marks are escaped inside texts, so that
:func:`read_back` returns exactly the turns that went in.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import query, small_batches, table
from tabguard.session import write_and_reread

#: Characters after which a conversation goes on in another part; a turn is never split.
PART_CHARS = 1 << 16


# --- layouts -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fields:
    """One turn of a fixed role, its text joined from the paths that are filled; no turn where none is."""

    role: str
    paths: tuple[str, ...]
    joiner: str = "\n\n"


@dataclass(frozen=True)
class Each:
    """A turn for each element of the array at ``path``; role and text are paths inside the element."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Row:
    """The record is one turn of a longer conversation, named by paths of its own."""

    conversation: str
    turn: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """A mapping of records to turns. ``optional`` paths of it may be missing or null; all others must be filled."""

    name: str
    parts: tuple
    optional: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()

    @cached_property
    def paths(self) -> frozenset[str]:
        found = set()
        for part in self.parts:
            if isinstance(part, Fields):
                found.update(part.paths)
            elif isinstance(part, Each):
                found.update([f"{part.path}[]", f"{part.path}[].{part.role}", f"{part.path}[].{part.text}"])
            else:
                found.update([part.conversation, part.turn, part.role, part.text])
        # The arrays on the way to a path are filled where the path is.
        for path in list(found):
            found.update(path[:m.end()] for m in re.finditer(r"\[\]", path))
        return frozenset(found)

    def fingerprints(self):
        needed = self.paths - set(self.optional)
        for n in range(len(self.optional) + 1):
            for chosen in itertools.combinations(sorted(self.optional), n):
                if needed or chosen:
                    yield fingerprint(needed | set(chosen))


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
TURN_ROW = Layout("turn_row", (Row("conv_id", "turn", "role", "text"),), ("conv_id", "turn", "role", "text"))
LAYOUTS = (
    TURN_ROW,
    Layout("prompt_completion", (Fields("system", ("system",)), Fields("user", ("prompt",)), Fields("assistant", ("completion",))), ("system", "completion")),
    Layout("prompt_response", (Fields("system", ("system",)), Fields("user", ("prompt",)), Fields("assistant", ("response",))), ("system",)),
    Layout("question_answer", (Fields("user", ("context", "question")), Fields("assistant", ("answer",))), ("context",)),
    Layout("instruction_output", (Fields("system", ("system",)), Fields("user", ("instruction", "input")), Fields("assistant", ("output",))), ("system", "input")),
    Layout("messages", (Fields("system", ("system",)), Each("messages", "role", "content")), ("system", "messages[].role", "messages[].content"), SPEAKERS),
    Layout("message_parts", (Fields("system", ("system",)), Each("messages", "role", "content[].text")),
           ("system", "messages[].role", "messages[].content[].text"), SPEAKERS),
    Layout("from_value", (Fields("system", ("system",)), Each("conversations", "from", "value")),
           ("system", "conversations[].from", "conversations[].value"), SPEAKERS),
)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths, such as ``messages[].role``."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def filled_paths(value, known: frozenset[str], prefix: str = "") -> set[str]:
    """Paths of ``known`` at which ``value`` holds something; null counts as missing, an array as filled even if empty."""
    found = set()
    if isinstance(value, dict):
        for name, inner in value.items():
            found |= filled_paths(inner, known, f"{prefix}.{name}" if prefix else name)
    elif isinstance(value, list):
        found.add(f"{prefix}[]")
        for inner in value:
            found |= filled_paths(inner, known, f"{prefix}[]")
    elif value is not None:
        found.add(prefix)
    return found & known


def registry(layouts=LAYOUTS) -> tuple[dict[str, Layout], frozenset[str]]:
    """Layout by fingerprint, and all paths that any layout names; two layouts may not claim one fingerprint."""
    found: dict[str, Layout] = {}
    for layout in layouts:
        for key in layout.fingerprints():
            if found.setdefault(key, layout) is not layout:
                raise ValueError(f"layouts {found[key].name} and {layout.name} share a fingerprint")
    return found, frozenset().union(*(layout.paths for layout in layouts))


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, default=str)


def _at(value, path: str):
    """What stands at a path: the value itself, or the texts of all array elements one after the other."""
    steps = path.split(".")
    for n, step in enumerate(steps):
        if step.endswith("[]"):
            inner = value.get(step[:-2]) if isinstance(value, dict) else None
            rest = ".".join(steps[n + 1:])
            return "".join(_text(_at(x, rest) if rest else x) for x in inner or [])
        value = value.get(step) if isinstance(value, dict) else None
    return value


def turns_of(record: dict, layout: Layout, conversation):
    """(conversation, turn, role, text) of each turn of a record."""
    if isinstance(layout.parts[0], Row):
        row = layout.parts[0]
        return [(_at(record, row.conversation), _at(record, row.turn), _text(_at(record, row.role)), _text(_at(record, row.text)))]
    names, turns = dict(layout.aliases), []
    for part in layout.parts:
        if isinstance(part, Fields):
            held = [_text(v) for v in (_at(record, p) for p in part.paths) if v is not None]
            if held:
                turns.append((part.role, part.joiner.join(held)))
        else:
            for element in record[part.path]:
                role = _text(_at(element, part.role))
                turns.append((names.get(role, role), _text(_at(element, part.text))))
    return [(conversation, n, role, text) for n, (role, text) in enumerate(turns)]


def canonical_turns(records: DataFrame, record: str = "record", id_column: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text, layout): the turns of every record, a JSON string or a struct.

    The conversation is ``id_column`` (null without it), unless the layout takes it from the record.
    Paths that no layout names don't count for the fingerprint. A record that is null, not an object,
    no valid JSON, empty or of an unknown fingerprint gives one row whose layout, role and text are
    null, so that nothing goes unnoticed. Missing roles and texts of known layouts are empty strings.
    """
    small_batches(records.sparkSession)
    by_key, known = registry(layouts)
    name = F.col(id_column).cast("long") if id_column else F.lit(None).cast("long")

    def read(value):
        if isinstance(value, str):
            try:
                return json.loads(value)
            except ValueError:
                return None
        return value

    def run(batches):
        for batch in batches:
            rows = []
            for conversation, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = read(value)
                layout = by_key.get(fingerprint(filled_paths(value, known))) if isinstance(value, dict) else None
                if layout is None:
                    rows.append((conversation, None, None, None, None))
                else:
                    rows.extend((*turn, layout.name) for turn in turns_of(value, layout, conversation))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "role", "text", "layout"])

    return records.select(name.alias("id"), F.col(record).alias("record")).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


# --- template ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """``open`` role ``middle`` text ``close`` for each turn; ``controls`` get a backslash before each place they start at in a text."""

    open: str = "### "
    middle: str = ": "
    close: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    learnt: str = "assistant"

    def __post_init__(self):
        if not any(self.close.startswith(c) for c in self.controls):
            raise ValueError("the end of a turn has to start with a control string")

    @cached_property
    def _special(self):
        return re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))

    @cached_property
    def _special_in_role(self):
        return re.compile(f"{self._special.pattern}|{re.escape(self.middle[0])}")

    @cached_property
    def _turn(self):
        end, rest, stop = re.escape(self.close[0]), re.escape(self.close[1:]), re.escape(self.middle[0])
        role = rf"((?:[^\\{stop}]++|\\.)*+)"
        text = rf"((?:[^\\{end}]++|\\.|{end}(?!{rest}))*+)"
        return re.compile(f"{re.escape(self.open)}{role}{re.escape(self.middle)}{text}{re.escape(self.close)}", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._special.sub(r"\\\g<0>", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """The formatted turn and where its text stands in it."""
        head = self.open + self._special_in_role.sub(r"\\\g<0>", role) + self.middle
        body = self.escape(text)
        return head + body + self.close, len(head), len(head) + len(body)

    def turns(self, formatted: str):
        """(role, text) of each turn; fails where the text was not made by this template."""
        at = 0
        while at < len(formatted):
            found = self._turn.match(formatted, at)
            if found is None:
                raise ValueError(f"no turn at character {at}")
            yield self.unescape(found[1]), self.unescape(found[2])
            at = found.end()


TEMPLATE = Template()
_FORMATTED = "conv_id long, task int, number long, whole boolean, formatted string, loss array<struct<start:int,end:int>>"


def format_chats(turns: DataFrame, template: Template = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations: (conv_id, task, number, whole, formatted, loss).

    ``turns`` holds conv_id, turn, role and text. Turns stand in the order of ``turn`` (nulls first);
    turns that share a number in the order of the MD5 of role and text. ``loss`` lists the
    stretches of ``formatted``, in code points, that hold the texts of the learnt role.

    Rows are dealt out by ranges of (conversation, turn), so a conversation of any length is spread
    over tasks. One that lies inside a task is a row with ``whole`` true; others, and those above
    ``part_chars``, are several rows, in the order of (task, number). Null roles and texts are empty;
    turns without a conv_id make up one conversation.
    """
    small_batches(turns.sparkSession)
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    keyed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keyed = keyed.withColumn("tie", F.md5(F.concat_ws("\n", "role", "text")))
    order = ["conv_id", "turn", "tie"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches):
        task = TaskContext.get().partitionId()
        rows, number, current, any_row = [], 0, None, False
        texts, size, loss, inner, first = [], 0, [], False, True

        def close(ended):
            nonlocal texts, size, loss, number, inner
            rows.append((current, task, number, inner and ended, "".join(texts), loss))
            texts, size, loss, number, inner = [], 0, [], number + 1, False

        def drain():
            columns = list(zip(*rows))
            out = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.bool_()),
                   pa.array(columns[4], pa.string()), pa.array(columns[5], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["conv_id", "task", "number", "whole", "formatted", "loss"])

        for batch in batches:
            for conversation, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if any_row and conversation != current:
                    if texts:
                        close(True)
                    first, inner = False, True
                any_row, current = True, conversation
                turn, start, end = template.turn(role, text)
                if role == template.learnt:
                    loss.append({"start": size + start, "end": size + end})
                texts.append(turn)
                size += len(turn)
                if size >= part_chars:
                    close(False)
            if rows:
                yield drain()
        if texts:
            # The last conversation of a task may go on in the next one.
            close(False)
        if rows:
            yield drain()

    return dealt.mapInArrow(run, _FORMATTED)


class _Digests:
    """Running digests of one conversation, fed part by part."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, formatted: str, spans, template: Template) -> None:
        for role, text in template.turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in spans:
            learnt = template.unescape(formatted[span["start"]:span["end"]])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.chars += len(formatted)

    def row(self):
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the formatted text and its mask.

    Whole conversations are read where they stand. The parts of the others are sorted by
    conversation and read as a stream: a task holds one part at a time, however long the conversation.
    A digest runs over its text in order, so it is the one thing here that takes one task for a conversation.
    """
    small_batches(formatted.sparkSession)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        current, digests = None, None
        for batch in batches:
            rows = []
            for conversation, whole, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if digests is not None and (whole or conversation != current):
                    rows.append((current, *digests.row()))
                    digests = None
                if digests is None:
                    current, digests = conversation, _Digests()
                digests.feed(text, spans, template)
            if rows:
                yield _digest_batch(rows)
        if digests is not None:
            yield _digest_batch([(current, *digests.row())])

    columns = ["conv_id", "whole", "formatted", "loss"]
    inside = formatted.where("whole").select(*columns)
    parts = formatted.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "number").select(*columns)
    return inside.mapInArrow(run, schema).unionByName(parts.mapInArrow(run, schema))


def _digest_batch(rows) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def chats_digest(records: DataFrame, record: str = "record", id_column: str | None = None) -> DataFrame:
    """Digests of all conversations of ``records``, formatted to a written table and read back from it."""
    turns = canonical_turns(records, record, id_column).where("layout is not null")
    return read_back(write_and_reread(format_chats(turns), "chats"))


#: A conversation whose texts hold the template's own marks; the contract adds it to the table.
MARKED = (-7, "\\### Assistant: </turn> ok")


@query(sql=r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL OR turn IS NOT NULL OR role IS NOT NULL OR text IS NOT NULL
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    keyed AS (
        SELECT *, md5(role || chr(10) || text) AS tie,
               length(text) - length(replace(text, '\', ''))
               + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
               + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS text_marks,
               length(role) - length(replace(replace(role, '\', ''), ':', ''))
               + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0)
               + (length(role) - length(replace(role, '</turn>', ''))) // 7 AS role_marks
        FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(14 + length(role) + role_marks + length(text) + text_marks) AS BIGINT) AS formatted_chars
    FROM keyed GROUP BY conv_id
""")
def op12_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(MARKED[0], 0, "user", MARKED[1]), (MARKED[0], 1, "assistant", MARKED[1])], "conv_id long, turn long, role string, text string")
    records = rows.unionByName(marked).select(F.struct("conv_id", "turn", "role", "text").alias("record"))
    return chats_digest(records)
