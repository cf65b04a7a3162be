"""Chat formatting by schema fingerprints: any known record layout becomes canonical turns, then one template.

A record's fingerprint is the hash of its nested field paths. A registry maps fingerprints to
declarative layouts, each of which says where turns, roles and texts lie. Canonical turns are then
written with a template whose marks are escaped inside texts, so the output can be read back.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    `turns` is the path of a list of messages with `role` and `text` fields; or None, and `fixed`
    lists (role, paths) whose texts, joined by a blank line, are one turn each; or the record is
    itself one turn with `role` and `text` fields and its place in `order` (null if it has none,
    which comes first). `paths` must all be present, any of `optional` may be. `names` translates role names.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    names: dict[str, str] = field(default_factory=dict, hash=False)


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn", ("role", "text", "turn"), text="text", order="turn"),
    Layout("turn_without_text", ("role", "turn"), text="text", order="turn"),
    Layout("turn_without_role", ("text", "turn"), text="text", order="turn"),
    Layout("turn_bare", ("turn",), text="text", order="turn"),
    Layout("turn_without_place", ("role", "text"), text="text", order="turn"),
    Layout("turn_text_alone", ("text",), text="text", order="turn"),
    Layout("turn_role_alone", ("role",), text="text", order="turn"),
    Layout("turn_empty", (), text="text", order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), ("system", "id", "messages[].name"), turns="messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system", "id"), turns="conversations", role="from", text="value", names=NAMES),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "response"), ("system",), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("completion", ("prompt", "completion"), ("system",), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", ("question", "answer"), ("context", "system"), fixed=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(value: object, path: str = "") -> set[str]:
    """Paths of all leaves; list items share one path. A null or empty value has no path."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[field_paths(v, f"{path}[]") for v in value])
    return set() if value is None else {path}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprints of every layout with every choice of its optional paths; the first of two wins."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for size in range(len(layout.optional) + 1):
            for chosen in itertools.combinations(layout.optional, size):
                out.setdefault(fingerprint([*layout.paths, *chosen]), layout)
    return out


def _turns(layout: Layout, record: dict) -> list[tuple[int | None, str, str]]:
    """(place, role, text) of a record; a null text or role is empty."""
    if layout.order is not None:
        place = record.get(layout.order)
        return [(place if place is None else int(place), record.get(layout.role) or "", record.get(layout.text) or "")]
    if layout.turns is None:
        texts = [(role, "\n\n".join(str(record[p]) for p in paths if record.get(p))) for role, paths in layout.fixed]
        return list(enumerate_turns((role, text) for role, text in texts if text or role != "system"))
    first = [("system", str(record["system"]))] if record.get("system") and "system" in layout.optional else []
    rest = [(m.get(layout.role) or "", m.get(layout.text) or "") for m in record[layout.turns]]
    return list(enumerate_turns((layout.names.get(role, role), str(text)) for role, text in [*first, *rest]))


def enumerate_turns(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[int, str, str]]:
    return ((i, role, text) for i, (role, text) in enumerate(turns))


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the strings that must not stand in a text unescaped.

    The escape puts a backslash after the first character of each control string and doubles
    backslashes, so a text holds no control string and every backslash means the next character.
    """

    begin: str = "### "
    named: str = ":\n"
    end: str = "</turn>\n"
    controls: tuple[str, ...] = ("### ", "</turn>", "<|")

    def escape(self, text: str) -> str:
        pattern = "|".join([r"\\", *[re.escape(c) for c in self.controls]])
        return re.sub(pattern, lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    @staticmethod
    def escape_role(role: str) -> str:
        return re.sub(r"[\\:#<\n]", lambda m: "\\" + m[0], role)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def write(self, role: str, text: str) -> tuple[str, int, int]:
        """A formatted turn, and where its escaped text begins and ends in it."""
        head = f"{self.begin}{self.escape_role(role)}{self.named}"
        body = self.escape(text)
        return f"{head}{body}{self.end}", len(head), len(head) + len(body)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted string, as they were written."""
        turn = re.compile(
            re.escape(self.begin) + r"((?:[^\\:]|\\.)*?)" + re.escape(self.named) + r"(.*?)" + re.escape(self.end), re.DOTALL
        )
        out, at = [], 0
        while met := turn.match(formatted, at):
            out.append((self.unescape(met[1]), self.unescape(met[2])))
            at = met.end()
        if at != len(formatted):
            raise ValueError(f"not a formatted turn at {at}")
        return out


TURN_TYPE = "conv_id long, place long, layout string, role string, content string"


def canonical_turns(
    records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """(conv_id, place, layout, role, content) from JSON records of mixed layouts.

    A record whose fingerprint is not registered, or that is no JSON object (null, broken), gives
    one row with layout `unknown:` and its fingerprint, and null role and content, so it can be
    counted and mapped later. Repeated records give repeated turns.
    """
    known = registry(layouts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv_id, text in zip(batch.column("id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    record = None
                mark = fingerprint(field_paths(record)) if isinstance(record, dict) else "none"
                layout = known.get(mark)
                if layout is not None and not layout.paths and not {layout.role, layout.text, layout.order} >= set(record):
                    layout = None
                if layout is None:
                    rows.append((conv_id, 0, f"unknown:{mark}", None, None))
                else:
                    rows += [(conv_id, place, layout.name, role, t) for place, role, t in _turns(layout, record)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["conv_id", "place", "layout", "role", "content"],
            )

    narrow = records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).cast("string").alias("record"))
    return narrow.mapInArrow(run, TURN_TYPE)


def formatted_turns(turns: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Canonical turns with `formatted` and the loss mask in it (mask_begin, mask_end; null where nothing is learned).

    A conversation is its turns' strings one after the other, by place, then role, then text; it
    stays a row per turn, so no conversation has to fit into one row. Unknown records stay as rows
    with null role, content and formatted.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                template.write(role, text) if role is not None else (None, None, None)
                for role, text in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist(), strict=True)
            ]
            masked = [role in learn for role in batch.column("role").to_pylist()]
            spans = [(a, b) if m else (None, None) for (_, a, b), m in zip(made, masked, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv_id", "place", "role", "content")]
                + [
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([a for a, _ in spans], pa.int64()),
                    pa.array([b for _, b in spans], pa.int64()),
                ],
                names=["conv_id", "place", "role", "content", "formatted", "mask_begin", "mask_end"],
            )

    return turns.select("conv_id", "place", "role", "content").mapInArrow(
        run,
        "conv_id long, place long, role string, content string, formatted string, mask_begin long, mask_end long",
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the formatted conversations say, read from `formatted` and the mask alone.

    One row per conversation: conv_id, n_turns, turns_sha256 (role, line end, text, line end of each
    turn), loss_chars and loss_sha256 (unescaped text under the mask), formatted_chars, n_unknown
    (records in no layout, which are in none of the others). Turns pass in order through running hashes, so a conversation of any length takes the memory of a batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done(finished: list) -> tuple:
            conv_id, count, turns, loss_chars, loss, chars, unknown = finished
            return conv_id, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, unknown

        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_begin", "mask_end")]
            for conv_id, text, begin, end in zip(*columns, strict=True):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        rows.append(done(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if text is None:
                    state[6] += 1
                    continue
                for role, said in template.read(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                if begin is not None:
                    learned = template.unescape(text[begin:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            yield _digests(rows)
        if state is not None:
            yield _digests([done(state)])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_unknown"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "role", "content")
        .select("conv_id", "formatted", "mask_begin", "mask_end")
        .mapInArrow(
            run,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unknown long",
        )
    )
