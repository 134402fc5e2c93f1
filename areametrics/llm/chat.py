r"""Chat formatting in budgeted windows.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. In texts and roles every ``<`` that some
backslashes and a ``|`` follow gets one backslash more, so that no control string can stand inside
them, and taking one away gives the text back. A line feed in a role is written ``<|lf|>``.

A conversation is written into windows of whole turns. Running sums of the tokens of turns as they are
written, marks and escapes included, say which turns still fit the budget; a window starts with the
system turn (the first turn, if its role is ``system``) and the last turns before it that fit the
history budget, and then goes on with new turns. Repeated turns are not under the loss mask again:
each assistant text is a target once. A turn longer than the budget has a window to itself; the system
turn is not repeated where it leaves no room for a new turn. So only such a turn's window is over.

Tokens are counted before conversations are brought together, on whatever tasks read the rows. Turns
then stream through a partition in order of conversation and turn, so a task holds one window at a
time, however long a conversation is.

Null text and role are empty; a null conversation id or turn number sorts first and is an id like
any other; ties in the turn number go by role and text; repeated rows are turns of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areametrics.llm.common import groups, text_bytes
from areametrics.llm.units import units_of

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|lf|>"

_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def written(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where its own text starts and ends in it."""
    head = START + escape(role).replace("\n", LINE) + "\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(window: str) -> list[tuple[str, str, int]]:
    """The turns of a window: role, text, and where the text starts."""
    return [
        (unescape(m[1].replace(LINE, "\n")), unescape(m[2]), m.start(2))
        for m in _TURN.finditer(window)
    ]


def counted(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` (``conv_id``, ``turn``, ``role``, ``text``) with ``tokens`` of each turn as written. A
    turn starts and ends where the tokenizer always cuts, so a window has the sum of its turns."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        units = units_of(tokenizer)
        for batch in batches:
            said = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            data, offsets = text_bytes(pa.array([written(who, what)[0] for who, what in said], pa.large_string()))
            tokens = np.concatenate([
                units.group(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1]
                for i, j in groups(offsets)
            ] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tokens, pa.int64())], [*batch.schema.names, "tokens"]
            )

    return rows.mapInArrow(run, f"{schema}, tokens long")


def windows(
    df: DataFrame, tokenizer: str, budget: int = 2048, history: int = 512, conv: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per window: ``conv_id``, ``window``, ``text``, ``tokens``, ``repeated`` (how many
    leading turns are repeated) and ``loss`` (ranges of ``text`` under the loss mask)."""
    rows = (
        df.select(
            F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
    )
    rows = (
        counted(rows, tokenizer)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text", "tokens")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        out, own_kind = [], pa.int64()
        state = None  # conv, window, system turn, turns, tokens, repeated

        def close():
            conv_id, number, _, turns, tokens, repeated = state
            pieces, loss, at = [], [], 0
            for i, (who, said, _) in enumerate(turns):
                piece, a, b = written(who, said)
                if i >= repeated and who == "assistant":
                    loss.append({"start": at + a, "end": at + b})
                pieces.append(piece)
                at += len(piece)
            out.append((conv_id, number, "".join(pieces), tokens, repeated, loss))

        def flush():
            columns = list(zip(*out)) or [()] * 6
            kinds = [own_kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), span]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["conv_id", "window", "text", "tokens", "repeated", "loss"],
            )

        for batch in batches:
            own_kind = batch.schema.field(0).type
            for conv_id, who, said, n in zip(*(c.to_pylist() for c in batch.columns)):
                new = (who, said, n)
                if state is None or state[0] != conv_id:
                    if state:
                        close()
                    system = new if who == "system" else None
                    state = [conv_id, 0, system, [new], n, 0]
                    continue
                if state[4] + n > budget and len(state[3]) > state[5]:
                    close()
                    _, number, system, turns, _, _ = state
                    lead = [system] if system and system[2] + n <= budget else []
                    fixed = sum(t[2] for t in lead)
                    back, held = [], 0
                    # From the window's own turns, the system turn at its head aside.
                    for t in reversed(turns[1 if turns[0] is system else 0 :]):
                        if held + t[2] > history or fixed + held + t[2] + n > budget:
                            break
                        back.append(t)
                        held += t[2]
                    lead += reversed(back)
                    state = [conv_id, number + 1, system, lead, fixed + held, len(lead)]
                state[3].append(new)
                state[4] += n
            if out:
                yield flush()
        if state:
            close()
            yield flush()

    return rows.mapInArrow(
        run, f"conv_id {kind}, window long, text string, tokens long, repeated long, "
        "loss array<struct<start: long, end: long>>",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation from its windows alone: ``n_turns``, ``turns_sha256`` of role, line
    feed, text, line feed per turn, ``loss_chars`` and ``loss_sha256`` of the text under the loss
    mask, and ``formatted_chars`` of all windows."""
    rows = (
        formatted.select("conv_id", "window", "text", "repeated", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "window")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        out, own_kind = [], pa.int64()
        state = None  # conv, turns, hash, loss chars, loss hash, formatted chars

        def flush():
            columns = list(zip(*out)) or [()] * 6
            kinds = [own_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def close():
            out.append((*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            own_kind = batch.schema.field(0).type
            for row in batch.drop_columns(["window"]).to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for who, said, _ in parsed(row["text"])[row["repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{who}\n{said}\n".encode())
                for part in row["loss"]:
                    said = unescape(row["text"][part["start"] : part["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(row["text"])
            if out:
                yield flush()
        if state:
            close()
            yield flush()

    return rows.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )
