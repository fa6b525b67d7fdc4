"""Operator 9: chat formatting with a grammar round trip.

A conversation is rendered by a template, reparsed by a deterministic parser,
and the recovered turns are compared to the source. Turns that do not come
back identical are escaped, and the text is rendered again, until it reads
back identical.

Grammar (the control strings are case-sensitive)::

    conversation := "<s>" turn*
    turn         := "<<SYS>>" text "<</SYS>>"           role system
                  | "[INST] " text " [/INST]"           role user
                  | " " text "</s>"                     role assistant
                  | "[ROLE]" role "[AS]" text "[/ROLE]" any other role

In an escaped text ``\\`` is doubled and a ``\\`` breaks every control string
after its first character; the parser undoes this in every text.

Turns are ordered by turn number, then role and text; null roles and texts are
empty, a null conversation id is a conversation of its own. Rows are streamed
in order, so a conversation's rows are never gathered as a group, only its
formatted text is.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[AS]", "[/ROLE]"]
_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
BEGIN = "<s>"
#: role: what stands before and after its text
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("[ROLE]", "[AS]", "[/ROLE]")


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the ranges of code points that the loss covers (assistant texts)."""
    parts, at, mask = [BEGIN], len(BEGIN), []
    for (role, text), esc in zip(turns, escaped):
        body = escape(text) if esc else text
        if role in MARKS:
            before, after = MARKS[role]
        else:
            before, after = OTHER[0] + (escape(role) if esc else role) + OTHER[1], OTHER[2]
        if role == "assistant":
            mask.append((at + len(before), at + len(before) + len(body)))
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises GrammarError where it does not follow the grammar."""
    if not formatted.startswith(BEGIN):
        raise GrammarError("no begin mark")
    at, turns = len(BEGIN), []

    def upto(mark: str) -> str:
        nonlocal at
        end = formatted.find(mark, at)
        if end < 0:
            raise GrammarError(f"no {mark!r} after {at}")
        got, at = formatted[at:end], end + len(mark)
        if _BREAK.search(got):
            raise GrammarError(f"a control string in a text before {end}")
        return unescape(got)

    while at < len(formatted):
        for role, (before, after) in MARKS.items():
            if formatted.startswith(before, at):
                at += len(before)
                turns.append((role, upto(after)))
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise GrammarError(f"no turn at {at}")
            at += len(OTHER[0])
            role = upto(OTHER[1])
            turns.append((role, upto(OTHER[2])))
    return turns


def _reads_back(turns, escaped) -> bool:
    try:
        return parse(render(turns, escaped)[0]) == turns
    except GrammarError:
        return False


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Render so that the parser gives exactly ``turns``; escapes only turns that need it."""
    escaped = [False] * len(turns)
    if not _reads_back(turns, escaped):
        escaped = [not _reads_back([t], [False]) for t in turns]
        if not _reads_back(turns, escaped):
            escaped = [True] * len(turns)
            if not _reads_back(turns, escaped):
                raise GrammarError("the escaped text does not read back")
    return render(turns, escaped)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_mask`` (ranges of code points)."""
    kind = rows.schema[conv].dataType.simpleString()
    ordered = (rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                           F.coalesce(F.col(role), F.lit("")).alias("role"),
                           F.coalesce(F.col(text), F.lit("")).alias("text"))
               .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"))

    def fmt(batches):
        import pyarrow as pa

        def batch(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], ids), pa.array([o[1] for o in out], pa.string()),
                 pa.array([[{"start": a, "end": z} for a, z in o[2]] for o in out],
                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[conv, "formatted", "loss_mask"])

        open_id, turns = None, None
        for b in batches:
            out, ids = [], b.schema.field("conv").type
            for c, r, t in zip(*(b.column(n).to_pylist() for n in ("conv", "role", "text"))):
                if turns is not None and c != open_id:
                    out.append((open_id, *format_turns(turns)))
                    turns = None
                if turns is None:
                    open_id, turns = c, []
                turns.append((r, t))
            if out:
                yield batch(out)
        if turns is not None:
            yield batch([(open_id, *format_turns(turns))])

    return ordered.mapInArrow(fmt, f"`{conv}` {kind}, formatted string, loss_mask array<struct<start: long, end: long>>")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Parse formatted conversations: one row each with digests of the turns and of the text under the loss mask."""
    kind = formatted.schema[conv].dataType.simpleString()

    def read(batches):
        import pyarrow as pa
        for b in batches:
            out = []
            for s, mask in zip(b.column("formatted").to_pylist(), b.column("loss_mask").to_pylist()):
                h = hashlib.sha256()
                turns = parse(s)
                for r, t in turns:
                    h.update(f"{r}\n{t}\n".encode())
                loss = "".join(unescape(s[m["start"]:m["end"]]) for m in mask)
                out.append((len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(conv)] + [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(conv, "formatted", "loss_mask").mapInArrow(
        read, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
