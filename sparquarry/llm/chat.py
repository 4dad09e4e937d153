"""Chat formatting with typed content parts, a reversible template and a loss mask.

A visitor flattens a turn's parts, text, image, audio and document, into one string with
numbered placeholders in their order, and records each attachment and the tokens it
expands to. Control strings inside texts are escaped, so that the output reads back as it was.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Where one of these would begin, or a backslash stands, a backslash goes in: fixed control strings.
CONTROL = re.compile(r"\\|<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])")
#: Content parts; all but type may be null.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    r"""Every backslash doubled, and one put in after the first character of a control string."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass
class PartVisitor:
    """Flattens parts; one visitor goes through a whole conversation, so that numbers run on."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 256
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict, turn: int) -> str:
        """The part's text; an unknown or null type with text is text, else nothing."""
        kind = part.get("type")
        handler = getattr(self, f"visit_{kind}", None) if kind in ("image", "audio", "document") else None
        return handler(part, turn) if handler else escape(part.get("text") or "")

    def attach(self, kind: str, part: dict, turn: int, tokens: int) -> str:
        n = len(self.attachments) + 1
        self.attachments.append({"n": n, "type": kind, "ref": part.get("ref"), "turn": turn, "tokens": max(1, tokens)})
        return f"<|{kind}_{n}|>"

    def visit_image(self, part: dict, turn: int) -> str:
        return self.attach("image", part, turn, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict, turn: int) -> str:
        return self.attach("audio", part, turn, math.ceil((part.get("seconds") or 0.0) * self.audio_rate))

    def visit_document(self, part: dict, turn: int) -> str:
        return self.attach("document", part, turn, (part.get("pages") or 0) * self.page_tokens)


def format_turns(turns: list[dict], visitor: PartVisitor | None = None) -> dict:
    """One conversation: formatted text, loss spans in code points, attachments and their tokens."""
    visitor = visitor or PartVisitor()
    out, spans, at = [], [], 0
    for i, t in enumerate(turns):
        head = TURN + escape(t["role"] or "").replace("\n", "\\\n") + "\n"
        body = "".join(visitor.visit(p, i) for p in t["parts"])
        if t["role"] == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return {"formatted": "".join(out), "loss": spans, "attachments": visitor.attachments, "attachment_tokens": sum(a["tokens"] for a in visitor.attachments)}


_TURN = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn; placeholders stay as they are."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


_FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<n:int,type:string,ref:string,turn:int,tokens:long>>, attachment_tokens long"


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        made = []
        for conv_id, turns in zip(rows["conv_id"], rows["turns"], strict=True):
            turns = [{"role": t["role"], "parts": [p for p in t["parts"] if p is not None]} for t in turns]
            made.append({"conv_id": conv_id, **format_turns(turns)})
        yield pd.DataFrame(made, columns=["conv_id", "formatted", "loss", "attachments", "attachment_tokens"]).astype({"conv_id": "Int64"})


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One row for each conv_id: formatted, loss, attachments, attachment_tokens.

    turns has conv_id, turn, role and text, or in place of text the content parts in
    parts_col. Turns are ordered by turn (null first), then role and content, so that ties and
    repeated rows all stay, in a fixed order. A null text or part is empty, a null role
    is empty, null conv_ids are one conversation. A conversation is one record, so its
    turns meet in one row; a very long text is one of its parts. Other columns aren't read.
    """
    text_part = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(kind).alias(n) for n, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    parts = F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)) if parts_col else text_part.cast(PARTS)
    rows = turns.select("conv_id", F.struct("turn", "role", parts.alias("parts")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInPandas(_format, _FORMATTED)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        made = []
        for conv_id, formatted, loss in zip(rows["conv_id"], rows["formatted"], rows["loss"], strict=True):
            found = read_turns(formatted)
            turns, masked, n = hashlib.sha256(), hashlib.sha256(), 0
            for role, text in found:
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                masked.update(text.encode("utf-8", "surrogatepass"))
                n += len(text)
            made.append((conv_id, len(found), turns.hexdigest(), n, masked.hexdigest(), len(formatted)))
        yield pd.DataFrame(made, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted output of text conversations reads back as, as counts and SHA-256 digests."""
    return formatted.select("conv_id", "formatted", "loss").mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
