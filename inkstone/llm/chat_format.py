r"""Chat formatting of typed content parts.

A visitor flattens a turn's text, image, audio and document parts into one string with ordered placeholders, recording
what each refers to and how many tokens it expands to.  The template writes a turn as ``### Role: text</turn>\n``; in
texts a backslash, and the first character of any control string, are escaped with a backslash, so reading back gives
every text as it was.  A conversation's turns are formatted apart and read back as a stream: however long it is, one
turn at a time is held.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

END_OF_TURN = "</turn>"
HEAD = "### "
PLACEHOLDER = "<|"
_control = re.compile(r"\\|### |</turn>|<\|")
_escaped = re.compile(r"\\(.)", re.DOTALL)
#: A turn of the output: a role, and a text in which every escape is taken as a pair.
_turn = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


@dataclass
class Flattened:
    """What the visitor has gathered: the text so far, attachments in order, and tokens that they expand to."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0


class PartVisitor:
    """Flattens parts in order.  A part is a dict with ``type`` and, by type, ``text`` or ``ref`` and its sizes.

    image: width, height; one token for each patch begun.  audio: seconds; tokens for each second begun.  document: the
    pages are nested ``parts``, visited in place between its opening and closing placeholders.  An unknown type raises.
    """

    def __init__(self, patch: int = 28, audio_tokens_a_second: int = 25):
        self.patch, self.audio = patch, audio_tokens_a_second

    def visit(self, part: dict, out: Flattened) -> None:
        method: Callable | None = getattr(self, f"visit_{part.get('type')}", None)
        if method is None:
            raise ValueError(f"unknown part type {part.get('type')!r}")
        method(part, out)

    def _placeholder(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        n = len(out.attachments)
        out.text.append(f"{PLACEHOLDER}{kind}:{n}|>")
        out.attachments.append({"n": n, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        out.tokens += tokens

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.text.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict, out: Flattened) -> None:
        w, h = part.get("width") or 0, part.get("height") or 0
        self._placeholder("image", part, -(-w // self.patch) * -(-h // self.patch), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._placeholder("audio", part, self.audio * math.ceil(part.get("seconds") or 0), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._placeholder("document", part, 0, out)
        for p in part.get("parts") or ():
            self.visit(p, out)
        out.text.append(f"{PLACEHOLDER}/document|>")


def format_turn(role: str | None, parts: list[dict], visitor: PartVisitor | None = None) -> tuple[str, Flattened]:
    """A turn of the template, and what its parts refer to."""
    out = Flattened()
    for p in parts:
        (visitor or PartVisitor()).visit(p, out)
    return f"{HEAD}{escape_role(role or '')}: {''.join(out.text)}{END_OF_TURN}\n", out


class Reader:
    """Reads a formatted stream back, in pieces of any size, turn by turn."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, the text as it stands in the output) for each turn that is complete."""
        self.rest += piece
        at = 0
        while m := _turn.match(self.rest, at):
            yield unescape(m[1]), unescape(m[2]), m[2]
            at = m.end()
        self.rest = self.rest[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError("the stream ends within a turn")


def format_turns(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """(conv_id, turn, role, formatted, attachments, attachment_tokens) for each row of a table of turns.

    parts_col: a JSON list of parts; where it is absent or null, ``text`` is the one part (null: empty).  Null ids and turns
    stay null, a null role is empty, repeated rows each come back, and an empty table gives no rows.  Other columns are not
    read.
    """
    tune(turns.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visitor = PartVisitor()
        for pdf in batches:
            rows = []
            for c, t, r, text, parts in zip(pdf.conv_id, pdf.turn, pdf.role, pdf.text, pdf.parts, strict=True):
                s, got = format_turn(r, json.loads(parts) if parts else [{"type": "text", "text": text}], visitor)
                rows.append((c, t, r, s, json.dumps(got.attachments), got.tokens))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "formatted", "attachments", "attachment_tokens"]).astype({"conv_id": "Int64", "turn": "Int64"})

    parts = F.col(parts_col).cast("string") if parts_col else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))
    return rows.mapInPandas(run, "conv_id long, turn long, role string, formatted string, attachments string, attachment_tokens long")


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachment_tokens) per conversation.

    The formatted turns of a conversation are streamed in order of turn, then role, then output, through one reader; a
    task holds one batch and running digests, so a conversation may be of any length.  loss_*: the texts under the loss
    mask, which is what stands between the head and the end of turns of ``loss_role``.  Rows with a null id make up one
    conversation with a null id; repeated rows are turns of their own; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def result():
            state["reader"].close()
            return (now, state["n"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["tokens"])

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]
        for pdf in batches:
            rows = []
            for c, s, tokens in zip(pdf.conv_id.astype("Int64"), pdf.formatted, pdf.attachment_tokens, strict=True):
                c = None if pd.isna(c) else int(c)
                if state is None or c != now:
                    if state is not None:
                        rows.append(result())
                    now, state = c, {"reader": Reader(), "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0}
                state["chars"] += len(s)
                state["tokens"] += int(tokens)
                for role, text, _ in state["reader"].feed(s):
                    state["n"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == loss_role:
                        state["loss"].update(text.encode("utf-8", "surrogatepass"))
                        state["loss_chars"] += len(text)
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([result()], columns=columns).astype({"conv_id": "Int64"})

    dealt = formatted.select("conv_id", "turn", "role", "formatted", "attachment_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long")
