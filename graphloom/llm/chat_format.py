"""Chat formatting by rendering growing prefixes of a conversation with a template seen only from outside.

``locate`` renders the first k turns for k = 0, 1, 2, ...; what render k adds to render k-1 is turn k's span. A template
that changes what it wrote before (render k doesn't start with render k-1) is reported as one that rewrites history.
Where in its span a turn's text stands is found by rendering that turn once more with each of two one-letter texts: the
two differ at the first character of the text and at no other, which gives the lengths of what precedes and follows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The strings that control chat templates, none of which a rendered text may contain.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
_RISKY = re.compile("|".join([r"\\", *(re.escape(c) for c in CONTROLS)]))
_QUOTED = re.compile(r"\\(.)", re.S)


class HistoryRewritten(ValueError):
    """The template's output for more turns doesn't start with its output for fewer."""


def escape(text: str) -> str:
    """The text without control strings: a backslash goes after the first character of each and before each backslash."""
    return _RISKY.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _QUOTED.sub(lambda m: m[1], text)


def marked_turns(turns: list[Turn]) -> str:
    """The house template: each turn between marks, its role on the first line. Newlines in roles are escaped too."""
    return "".join([_marked(r, t) for r, t in turns])


@lru_cache(maxsize=1 << 12)
def _marked(role: str, text: str) -> str:
    return f"<|im_start|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}<|im_end|>\n"


_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(output: str) -> list[Turn]:
    """The turns that ``marked_turns`` wrote, from its output alone."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(output)]


@dataclass(frozen=True)
class Span:
    """One turn in the output: all that it added, and its (escaped) text inside that."""

    start: int
    end: int
    text_start: int
    text_end: int


def locate(template: Template, turns: list[Turn], wanted: Callable[[str], bool] = lambda role: True) -> tuple[str, list[Span]]:
    """The output and each turn's span; a turn whose role isn't wanted has an empty text span at its end.

    Raises HistoryRewritten if a longer prefix's output doesn't start with the shorter's, and ValueError if the place
    of a text can't be told (the template drops or trims one-letter texts).
    """
    spans: list[Span] = []
    before = template([])
    for k, (role, _) in enumerate(turns):
        output = template(turns[: k + 1])
        if not output.startswith(before):
            raise HistoryRewritten(f"turn {k} changes what was rendered before it")
        end = len(output)
        if wanted(role):
            a, b = (template([*turns[:k], (role, letter)]) for letter in "xy")
            at = len(before)
            while at < len(a) and at < len(b) and a[at] == b[at]:
                at += 1
            if a[:at] + "x" + a[at + 1 :] != a or a[at + 1 :] != b[at + 1 :] or a[at : at + 1] != "x" or b[at : at + 1] != "y":
                raise ValueError(f"the place of turn {k}'s text can't be told")
            tail = len(a) - at - 1
            if output[:at] != a[:at] or (tail and output[-tail:] != a[-tail:]) or at + tail > end:
                raise ValueError(f"turn {k}'s marks depend on its text")
            spans.append(Span(len(before), end, at, end - tail))
        else:
            spans.append(Span(len(before), end, end, end))
        before = output
    return before, spans


def format_conversations(df: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, formatted (string), turn_spans and loss_spans (arrays of [start, end) in code points), problem.

    Turns are in the order of turn (null first), then role and text, so ties and repeated rows have a defined place.
    A null text or role is empty; rows with a null id are a conversation of their own. A template that rewrites history
    or hides texts gives a null ``formatted`` and says why in ``problem``. Other columns are not read.

    Rows are dealt by id and sorted on disk by Spark; one conversation at a time is in memory, as its output is one row.
    """
    order = F.coalesce(df[turn_col].cast("long"), F.lit(-(2**63)))
    source = df.select(df[id_col].alias("id"), order.alias("turn"), F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    dealt = source.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    kind = dict(source.dtypes)["id"]

    def finish(key: object, turns: list[Turn]) -> dict:
        try:
            output, spans = locate(template, turns, lambda role: role in loss_roles)
        except ValueError as e:
            return {id_col: key, "formatted": None, "turn_spans": None, "loss_spans": None, "problem": str(e)}
        loss = [[s.text_start, s.text_end] for s, (role, _) in zip(spans, turns) if role in loss_roles]
        return {id_col: key, "formatted": output, "turn_spans": [[s.start, s.end] for s in spans], "loss_spans": loss, "problem": None}

    schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal schema
        key, turns, done, size, began = None, [], [], 0, False
        for batch in batches:
            if schema is None:
                spans = pa.list_(pa.list_(pa.int64()))
                schema = pa.schema([(id_col, batch.schema.field("id").type), ("formatted", pa.string()), ("turn_spans", spans), ("loss_spans", spans), ("problem", pa.string())])
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text"))):
                if began and i != key:
                    done.append(finish(key, turns))
                    size += sum(len(t) for _, t in turns)
                    turns = []
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done, size = [], 0
                key, began = i, True
                turns.append((role, text))
        if began:
            done.append(finish(key, turns))
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    spans = "array<array<bigint>>"
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, formatted string, turn_spans {spans}, loss_spans {spans}, problem string")


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the output says of itself: turns read back from it, and the text under the loss spans, as counts and hashes.

    A null output has nulls; null spans are none. Repeated rows stay, other columns are not read, an empty table gives an
    empty one.
    """
    kind = dict(formatted.dtypes)[id_col]
    source = formatted.select(formatted[id_col].alias("id"), "formatted", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for output, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                if output is None:
                    rows.append((None,) * 5)
                    continue
                turns = read_turns(output)
                loss = "".join(unescape(output[a:b]) for a, b in spans or ())
                rows.append((len(turns), _hex("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _hex(loss), len(output)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
