"""Chat formatting: typed content parts become one string with ordered placeholders, spans and attachments.

A visitor walks a message's parts. Text is escaped; an image, audio clip or document becomes a placeholder with its number
in the conversation, and is recorded with its reference, its place in the output and the tokens that it expands to. Turns are
marked by control strings; inside texts `\\` is doubled and a `\\` is put after the first letter of every control string, so no
text can end a turn and unescaping gives back the text exactly. The loss mask holds the spans of assistant texts, without
marks or placeholders.

`render` writes one conversation; `format_conversations` does it for a table of turns: rows are dealt by conversation, sorted
by turn inside Spark, and written turn by turn, so memory holds an Arrow batch of turns, not a conversation. `parse` reads an output back.

Defined results: a null text is empty; a null role is `user`; all rows with a null conv_id are one conversation; rows that tie in
turn follow each other by role, then text; repeated rows are turns of their own; an unknown role is kept as it is; unknown part
types are errors, as is a part without what its type needs; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ROLE_OPEN, ROLE_CLOSE, ROLE_END = "<|role:", "|>", "<|end|>"
PLACEHOLDER = "<|{kind}:{number}|>"
CONTROL = (BOS, EOS, OPEN, CLOSE, "<|", "|>")
#: A backslash goes after each of these; control strings may overlap, so what follows is only looked at.
_escape = re.compile(r"\\|<(?=/?s>|\|)|\[(?=/?INST\])|\|(?=>)")
PATCH, FRAME_S, PAGE_TOKENS = 14, 0.02, 768


def escape(text: str) -> str:
    return _escape.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    """A doubled backslash is one; a single one was put in."""
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass(frozen=True)
class Part:
    """type: text, image, audio or document; ref: where the attachment is; width, height: pixels; seconds; pages."""

    type: str
    text: str | None = None
    ref: str | None = None
    width: int | None = None
    height: int | None = None
    seconds: float | None = None
    pages: int | None = None


@dataclass(frozen=True)
class Attachment:
    number: int
    type: str
    ref: str
    at: int  # code points before its placeholder
    tokens: int


@dataclass
class Flattener:
    """The visitor: out gets the strings in order, loss the spans of text that is learned, attachments what was referred to."""

    at: int = 0
    number: int = 0
    out: list[str] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit(self, part: Part, learned: bool) -> None:
        visitor = getattr(self, f"visit_{part.type}", None)
        if visitor is None:
            raise ValueError(f"unknown part type {part.type!r}")
        visitor(part, learned)

    def visit_text(self, part: Part, learned: bool) -> None:
        begin = self.at
        self.write(escape(part.text or ""))
        if learned and self.at > begin:
            self.loss.append((begin, self.at))

    def _attach(self, part: Part, tokens: int) -> None:
        if not part.ref:
            raise ValueError(f"{part.type} part without a reference")
        self.attachments.append(Attachment(self.number, part.type, part.ref, self.at, tokens))
        self.write(PLACEHOLDER.format(kind=part.type, number=self.number))
        self.number += 1

    def visit_image(self, part: Part, learned: bool) -> None:
        """A token for each patch of the grid, one for the end of each grid row."""
        if not part.width or not part.height:
            raise ValueError("image part without a size")
        self._attach(part, math.ceil(part.height / PATCH) * (math.ceil(part.width / PATCH) + 1))

    def visit_audio(self, part: Part, learned: bool) -> None:
        if part.seconds is None:
            raise ValueError("audio part without a length")
        self._attach(part, max(1, math.ceil(round(part.seconds / FRAME_S, 6))))

    def visit_document(self, part: Part, learned: bool) -> None:
        if not part.pages:
            raise ValueError("document part without pages")
        self._attach(part, part.pages * PAGE_TOKENS)

    def turn(self, role: str | None, parts: Iterable[Part], first: bool) -> None:
        """User turns stand between [INST] and [/INST], assistant turns before </s>; other roles are named."""
        role = "user" if role is None else role
        self.write(BOS if first else "")
        self.write({"user": OPEN + " ", "assistant": " "}.get(role, f"{ROLE_OPEN}{escape(role)}{ROLE_CLOSE}"))
        for part in parts:
            self.visit(part, role == "assistant")
        self.write({"user": " " + CLOSE, "assistant": " " + EOS}.get(role, ROLE_END))


def render(messages: Iterable[tuple[str | None, list[Part]]]) -> Flattener:
    """One conversation; the string is "".join(result.out)."""
    flat = Flattener()
    for i, (role, parts) in enumerate(messages):
        flat.turn(role, parts, i == 0)
    return flat


_turn = re.compile(
    rf"(?:{re.escape(BOS)})?(?:{re.escape(OPEN)} (?P<user>.*?) {re.escape(CLOSE)}|{re.escape(ROLE_OPEN)}(?P<role>.*?){re.escape(ROLE_CLOSE)}(?P<other>.*?){re.escape(ROLE_END)}| (?P<assistant>.*?) {re.escape(EOS)})",
    re.DOTALL,
)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from an output; placeholders of attachments stay in the text as they are."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = unescape(m["role"]) if m["role"] is not None else "user" if m["user"] is not None else "assistant"
        out.append((role, unescape(next(m[g] for g in ("other", "user", "assistant") if m[g] is not None))))
        at = m.end()
    return out


TURN_SCHEMA = (
    "conv_id long, place long, piece string, begin long, n_chars long, loss array<struct<begin: long, end: long>>, "
    "attachments array<struct<number: int, type: string, ref: string, at: long, tokens: long>>"
)
PART_FIELDS = ("type", "text", "ref", "width", "height", "seconds", "pages")


def dealt(turns: DataFrame) -> DataFrame:
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(n, "conv_id")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per turn: conv_id, place (from 0), piece (what it adds to the formatted string), begin (code points before it in
    the conversation), n_chars, and the loss spans and attachments at their places in the conversation.

    parts_col: array of structs with PART_FIELDS; without it each text is one text part. The pieces of a conversation, joined
    by place, are its formatted string. Partitioned by conv_id and sorted by place."""
    parts = F.col(parts_col) if parts_col else F.lit(None).cast("array<struct<type string, text string, ref string, width int, height int, seconds double, pages int>>")
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, flat, place = (), Flattener(), 0
        for batch in batches:
            out: list[dict] = []
            for x in batch.to_pylist():
                if (x["conv_id"],) != conv:
                    conv, flat, place = (x["conv_id"],), Flattener(), 0
                flat.out, flat.loss, flat.attachments = [], [], []
                begin = flat.at
                given = [Part(**{k: p.get(k) for k in PART_FIELDS}) for p in x["parts"]] if x["parts"] is not None else [Part("text", x["text"])]
                flat.turn(x["role"], given, place == 0)
                out.append(
                    {"conv_id": x["conv_id"], "place": place, "piece": "".join(flat.out), "begin": begin, "n_chars": flat.at - begin,
                     "loss": [{"begin": a, "end": b} for a, b in flat.loss], "attachments": [vars(a) for a in flat.attachments]}
                )
                place += 1
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return dealt(rows).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, TURN_SCHEMA)


ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("piece", pa.string()), ("begin", pa.int64()), ("n_chars", pa.int64()),
     ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
     ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))]
)
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from the pieces: digest of its turns, and of the text under the loss mask. Reads the
    partitions as format_conversations leaves them, so nothing is shuffled; a conversation of any length streams through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, row, turns, loss = (), None, None, None

        def done() -> dict:
            return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if (x["conv_id"],) != conv:
                    if row:
                        out.append(done())
                    conv, turns, loss = (x["conv_id"],), hashlib.sha256(), hashlib.sha256()
                    row = {"conv_id": x["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                for role, text in parse(x["piece"]):
                    row["n_turns"] += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in x["loss"]:
                    text = unescape(x["piece"][span["begin"] - x["begin"] : span["end"] - x["begin"]])
                    row["loss_chars"] += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
                row["formatted_chars"] += x["n_chars"]
            yield pa.RecordBatch.from_pylist(out, schema=DIGESTS)
        if row:
            yield pa.RecordBatch.from_pylist([done()], schema=DIGESTS)

    return pieces.mapInArrow(run, DIGEST_SCHEMA)


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op1_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"{EOS}{OPEN} ok {CLOSE}"
    told = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(C.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(told)))


#: formatted_chars follows from the template: marks of each role, and a backslash for each escape.
OP1_SQL = r"""
with c as (select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<\|')) + len(regexp_extract_all(text, '\|>')) as n,
  length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<\|')) + len(regexp_extract_all(role, '\|>')) as r from c),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '') as loss,
  3 + sum(n + case role when 'user' then 15 when 'assistant' then 6 else r + 16 end) as formatted_chars from e group by conv_id)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars from g
"""
