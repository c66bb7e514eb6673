"""Chat formatting by typed content parts: a visitor flattens text, image, audio and document parts into one string.

A turn is a role and a list of typed parts. A visitor walks the parts in order: text is escaped and kept, every other
part becomes a placeholder, an attachment record (kind, reference, place, tokens) and a count of the tokens that it
will expand to. A turn is written as

    <turn>ROLE
    CONTENT</turn>

and a loss mask covers the content's text of the trained roles. Control strings inside a text get one backslash after
their `<` (`</turn>` becomes `<\\/turn>`, `<\\/turn>` becomes `<\\\\/turn>`), so no control string is left in a text and the
way back is exact. Roles are escaped too, with their line ends as `\\n`.

How it is spread: turns are flattened where they are read; one exchange by conversation brings formatted turns
together, sorted by Spark. A conversation is then written turn by turn, so neither a long conversation nor one with a
third of all rows is held in memory: it leaves in pieces of whole turns.

Defined results: null role or text counts as empty; a null list of parts is an empty turn, an unknown kind of part is
its text, a null kind a text. Turns go by `turn` (null first), then role, then content; repeated rows are turns of their
own. A null conv_id is a conversation like any other. Sizes that are missing cost the least an attachment of the kind
can. An empty table gives no rows. Columns beyond conv_id, turn, role and text (or parts) are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PLACEHOLDERS = ("image", "audio", "document")
CONTROLS = ("turn", "/turn", *PLACEHOLDERS)
_NAMES = "|".join(CONTROLS)
_PLAIN = re.compile(rf"<(\\*)({_NAMES})>")
_ESCAPED = re.compile(rf"<\\(\\*)({_NAMES})>")
_TURN = re.compile(r"<turn>([^\n]*)\n(.*?)</turn>\n", re.DOTALL)
_ROLE_BACK = re.compile(r"\\(.)", re.DOTALL)
ATTACHMENT = "struct<kind:string,ref:string,at:bigint,tokens:bigint>"
SPAN = "struct<start:bigint,end:bigint>"
PIECE_CHARS = 1_000_000


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1\2>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class TokenCosts:
    """What attachments expand to: image patches, audio frames, document pages."""

    patch: int = 28
    audio_per_second: float = 25.0
    page: int = 1024

    def image(self, part: dict) -> int:
        side = [-(-max(part["width" if s else "height"] or 1, 1) // self.patch) for s in (0, 1)]
        return side[0] * side[1]

    def audio(self, part: dict) -> int:
        seconds = part["seconds"] or 0.0
        return max(1, int(seconds * self.audio_per_second + 0.999999)) if seconds == seconds and seconds < 1e12 else 1

    def document(self, part: dict) -> int:
        return max(part["pages"] or 1, 1) * self.page


class Visitor:
    """Flattens the parts of one turn; text, spans and attachments are read off afterwards."""

    def __init__(self, costs: TokenCosts, begin: int):
        self.costs, self.at = costs, begin
        self.out: list[str] = []
        self.texts: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type']}" if part["type"] in PLACEHOLDERS else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part["text"] or "")
        if text:
            self.texts.append((self.at, self.at + len(text)))
            self._put(text)

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def _attach(self, kind: str, part: dict) -> None:
        tokens = getattr(self.costs, kind)(part)
        self.attachments.append({"kind": kind, "ref": part["ref"], "at": self.at, "tokens": tokens})
        self._put(f"<{kind}>")

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)


def text_part(text: Column) -> Column:
    """A text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *(F.lit(None).cast(t).alias(n) for n, t in (
                                ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def parts_from_json(content: Column) -> Column:
    """Parts out of a JSON list of objects with the fields of PART; anything else is one text part."""
    return F.coalesce(F.from_json(content, f"array<{PART}>"), text_part(content))


def flatten(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), costs: TokenCosts = TokenCosts()) -> DataFrame:
    """One row per turn, nothing moved: conv_id, turn, role, segment, loss spans and attachments, places within the segment.

    `turns` has conv_id, turn, role, and parts (or text, which is one text part).
    """
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    turn_type = turns.schema["turn"].dataType.simpleString()
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else text_part(F.col("text"))
    known = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    schema = f"conv_id {conv_type}, turn {turn_type}, role string, segment string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, loss, attachments = [], [], []
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                head = f"<turn>{escape_role(role)}\n"
                visitor = Visitor(costs, len(head))
                for part in parts or ():
                    visitor.visit(part)
                segments.append(f"{head}{''.join(visitor.out)}</turn>\n")
                loss.append([{"start": a, "end": b} for a, b in visitor.texts] if role in trained else [])
                attachments.append(visitor.attachments)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(segments, pa.string()),
                 pa.array(loss, _SPANS), pa.array(attachments, _ATTACHMENTS)],
                names=["conv_id", "turn", "role", "segment", "loss", "attachments"])

    return known.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))


class _Piece:
    """Whole turns of one conversation, up to the size of a piece."""

    def __init__(self, conv_id, number: int, start: int):
        self.conv_id, self.number, self.start, self.at = conv_id, number, start, start
        self.segments: list[str] = []
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def add(self, segment: str, loss: list[dict], attachments: list[dict]) -> None:
        self.loss += [{"start": s["start"] + self.at, "end": s["end"] + self.at} for s in loss]
        self.attachments += [{**a, "at": a["at"] + self.at} for a in attachments]
        self.segments.append(segment)
        self.at += len(segment)

    def batch(self, conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.conv_id], conv_type), pa.array([self.number], pa.int32()), pa.array([self.start], pa.int64()),
             pa.array([len(self.segments)], pa.int32()), pa.array(["".join(self.segments)], pa.string()),
             pa.array([self.loss], _SPANS), pa.array([self.attachments], _ATTACHMENTS)],
            names=["conv_id", "piece", "start", "n_turns", "formatted", "loss", "attachments"])


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), costs: TokenCosts = TokenCosts(),
                 piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, piece, start, n_turns, formatted, loss, attachments: the pieces of every conversation, in order.

    A conversation below `piece_chars` code points is one row. Pieces hold whole turns; start, loss spans and attachment
    places count code points of the whole formatted conversation. Pieces of one conversation follow each other.
    """
    flat = flatten(turns, trained, costs)
    placed = flat.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "segment")
    schema = (f"conv_id {flat.schema['conv_id'].dataType.simpleString()}, piece int, start bigint, n_turns int, formatted string, "
              f"loss array<{SPAN}>, attachments array<{ATTACHMENT}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv_type = None, None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            ids = batch.column("conv_id").to_pylist()
            segments, loss, attachments = (batch.column(c) for c in ("segment", "loss", "attachments"))
            for i, conv_id in enumerate(ids):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        yield held.batch(conv_type)
                    held = _Piece(conv_id, 0, 0)
                elif held.at - held.start >= piece_chars:
                    yield held.batch(conv_type)
                    held = _Piece(conv_id, held.number + 1, held.at)
                held.add(segments[i].as_py(), loss[i].as_py(), attachments[i].as_py())
        if held is not None:
            yield held.batch(conv_type)

    return placed.select("conv_id", "segment", "loss", "attachments").mapInArrow(run, schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of formatted turns; placeholders of attachments stay where they are."""
    return [(unescape_role(role), unescape(content)) for role, content in _TURN.findall(formatted)]


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from the pieces of `format_chats` as they come: counts and hashes.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end per turn), loss_chars and loss_sha256 (code points and
    hash of the unescaped text under the loss mask), formatted_chars, n_attachments, attachment_tokens.
    """
    schema = (f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, rows, counts, turns, loss = None, [], [], None, None

        def closed() -> None:
            rows.append([counts[0], counts[1], turns.hexdigest(), counts[2], loss.hexdigest(), *counts[3:]])

        def batch_of() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    if turns is not None:
                        closed()
                    counts, turns, loss = [row["conv_id"], 0, 0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                text = row["formatted"]
                for role, content in read_back(text):
                    turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                    counts[1] += 1
                for span in row["loss"]:
                    shown = unescape(text[span["start"] - row["start"]:span["end"] - row["start"]])
                    loss.update(shown.encode("utf-8", "surrogatepass"))
                    counts[2] += len(shown)
                counts[3] += len(text)
                counts[4] += len(row["attachments"])
                counts[5] += sum(a["tokens"] for a in row["attachments"])
            if rows:
                yield batch_of()
        if turns is not None:
            closed()
            yield batch_of()

    return pieces.mapInArrow(run, schema)
