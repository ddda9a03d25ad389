"""Chat formatting with typed content parts.

A message is a role and a list of parts, each a text, image, audio clip or document. A visitor turns
the parts, in order, into one string: texts are escaped, any other part leaves a numbered
placeholder, an attachment record and the number of tokens it expands to. The template is

    <|im_start|>ROLE \\n CONTENT <|im_end|> \\n

Control strings all begin with ``<|``. In contents ``\\`` becomes ``\\\\`` and then ``<|`` becomes
``<\\|``, so no text can open a control string; both are undone in reverse order. Texts that follow
each other are escaped as one text, so none of them can end what the one before it began. Roles are
percent-escaped, as they end at the line feed.

Messages are formatted row by row with column expressions. ``assemble`` joins them into one string a
conversation, cut into pieces of equal length wherever the cuts fall, with the loss mask as spans of
it. ``read_conversations`` gets turns and roles back by looking for the markers in that string, and
the trained text by its mask alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: tokens of an image patch side, of a second of audio and of a page
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    for plain, safe in (("%", "%25"), ("\n", "%0A"), ("<|", "%3C|")):
        role = F.replace(role, F.lit(plain), F.lit(safe))
    return role


def unescape_role(role: Column) -> Column:
    for plain, safe in (("<|", "%3C|"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(safe), F.lit(plain))
    return role


class PartVisitor:
    """One method for each kind of part; an unknown kind counts as text."""

    def text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        side = [F.ceil(F.greatest(F.coalesce(part[c], F.lit(0)), F.lit(0)) / PATCH) for c in ("width", "height")]
        return F.lit("image"), side[0] * side[1]

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("audio"), F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("document"), F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * PAGE_TOKENS

    def visit(self, parts: Column) -> tuple[Column, Column]:
        """Content of a message, and its attachments (number, kind, uri, tokens) in order."""
        media = ("image", "audio", "document")
        shown = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
        numbered = F.transform(shown, lambda p, i: F.struct(p.alias("part"), i.alias("i")))

        def is_text(part: Column) -> Column:
            return ~F.coalesce(part["type"].isin(*media), F.lit(False))

        def body(part: Column) -> Column:
            return F.coalesce(part["text"], F.lit(""))

        # without empty texts, a text goes on exactly where the entry before it is a text
        kept = F.filter(numbered, lambda e: ~(is_text(e["part"]) & (body(e["part"]) == "")))
        opens = F.transform(kept, lambda e: is_text(e["part"]) & body(e["part"]).endswith("<"))

        def written(entry: Column, opened: Column) -> Column:
            part = entry["part"]
            split = opened & body(part).startswith("|")
            out = F.concat(F.when(split, "\\").otherwise(""), self.text(part)[0])
            for kind in media:
                mark = F.concat(F.lit("<|"), self._of(kind, part)[0], F.lit(":"), entry["i"].cast("string"), F.lit("|>"))
                out = F.when(part["type"] == kind, mark).otherwise(out)
            return F.when(part.isNotNull(), out)

        def attached(part: Column, i: Column) -> Column:
            tokens = F.lit(0).cast("bigint")
            for kind in media:
                tokens = F.when(part["type"] == kind, self._of(kind, part)[1].cast("bigint")).otherwise(tokens)
            return F.struct(i.alias("number"), part["type"].alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens"))

        before = F.concat(F.array(F.lit(False)), opens)  # one longer than kept: its last entry meets no part
        content = F.array_join(F.zip_with(kept, before, written), "")
        return content, F.filter(F.transform(shown, attached), lambda a: a["kind"].isin(*media))

    def _of(self, kind: str, part: Column) -> tuple[Column, Column]:
        return getattr(self, kind)(part)


def text_part(text: Column) -> Column:
    """A text as a list of one part."""
    fields = ["type", "text", "uri", "width", "height", "seconds", "pages"]
    values = [F.lit("text"), text, *[F.lit(None)] * 5]
    return F.array(F.struct(*[v.alias(f) for f, v in zip(fields, values)]).cast(PART))


def format_messages(messages: DataFrame, visitor: PartVisitor | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, ``formatted``, the loss span in it, attachments and their expanded tokens.

    Needs conv_id, turn, role and parts. The loss span (code points from ``loss_start``, length
    ``loss_length``) covers the content of roles in ``trained`` and is empty for others. A null role
    is empty, null parts are no parts, a null text is empty. Other columns are dropped; repeated
    rows are formatted once each.
    """
    content, attachments = (visitor or PartVisitor()).visit(F.col("parts"))
    role = F.coalesce("role", F.lit(""))
    made = messages.select("conv_id", "turn", role.alias("role"), content.alias("content"), attachments.alias("attachments"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    return made.select(
        "conv_id", "turn", F.concat(head, F.col("content"), F.lit(END + "\n")).alias("formatted"),
        F.length(head).alias("loss_start"),
        F.when(F.col("role").isin(*trained), F.length("content")).otherwise(0).alias("loss_length"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_messages(formatted: DataFrame) -> DataFrame:
    """Role, text and loss text back from single formatted rows (placeholders stay as they are).

    One row a row of ``format_messages``, whose columns are never null but for conv_id and turn; those stay.
    """
    body = F.col("formatted")
    feed = F.locate("\n", body)
    role = F.substring(body, F.lit(len(START) + 1), feed - len(START) - 1)
    text = F.substring(body, feed + 1, F.length(body) - feed - len(END) - 1)
    loss = F.substring(body, F.col("loss_start") + 1, F.col("loss_length"))
    return formatted.select("conv_id", "turn", unescape_role(role).alias("role"), unescape(text).alias("text"),
                            unescape(loss).alias("loss"), F.length(body).alias("chars"))


class _Writer:
    """One conversation as pieces of ``size`` code points, with the mask spans that fall into each."""

    def __init__(self, size: int):
        self.size, self.held, self.waiting, self.at, self.number = size, [], 0, 0, 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str, start: int, length: int) -> list[tuple]:
        if length:
            begin = self.at + self.waiting + start
            self.spans.append((begin, begin + length))
        self.held.append(text)
        self.waiting += len(text)
        return self._cut(self.size) if self.waiting >= self.size else []

    def close(self) -> list[tuple]:
        return self._cut(1)

    def _cut(self, least: int) -> list[tuple]:
        body, lo, out = "".join(self.held), 0, []
        while len(body) - lo >= least:
            piece = body[lo:lo + self.size]
            end = self.at + len(piece)
            mask = [(max(a, self.at), min(b, end)) for a, b in self.spans if a < end]
            out.append((self.number, piece, [a for a, _ in mask], [b for _, b in mask]))
            self.spans = [s for s in self.spans if s[1] > end]
            lo, self.at, self.number = lo + len(piece), end, self.number + 1
        self.held, self.waiting = [body[lo:]], len(body) - lo
        return out


def assemble(formatted: DataFrame, piece_chars: int = 1 << 16) -> DataFrame:
    """conv_id, ``piece`` (from 0), ``body``, ``mask_start`` and ``mask_end``: conversations as strings.

    The bodies of a conversation, by piece, are its messages by turn, one after the other; all but the
    last have ``piece_chars`` code points. The mask lists the spans (code points of the whole string, end
    exclusive) of the piece that are trained on. Null turns come first; ties of turn are broken by role, then
    text. A null conv_id is a conversation too; an empty table gives no rows. The rows of a
    conversation pass one task as a sorted stream, of which one piece is held.
    """
    names = ["conv_id", "piece", "body", "mask_start", "mask_end"]
    spans = pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), spans, spans])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, writer = None, None
        for batch in batches:
            out = []
            for key, text, start, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if writer is None or key != conv:
                    out += [] if writer is None else [(conv, *p) for p in writer.close()]
                    conv, writer = key, _Writer(piece_chars)
                out += [(conv, *p) for p in writer.add(text, start, length)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
        if writer is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (conv, *p))) for p in writer.close()], schema)

    body = F.col("formatted")
    text = unescape(F.substring(body, F.col("loss_start") + 1, F.length(body) - F.col("loss_start") - len(END) - 1))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), unescape_role(F.substring_index(body, "\n", 1)), text]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*order)
    return rows.select(F.col("conv_id").cast("bigint"), "formatted", "loss_start", "loss_length").mapInArrow(
        run, "conv_id bigint, piece bigint, body string, mask_start array<bigint>, mask_end array<bigint>")


def _plain(text: str) -> str:
    return text.replace("<\\|", "<|").replace("\\\\", "\\")


class TurnParser:
    """Turns out of a formatted string that arrives in slices of any length."""

    CLOSE = END + "\n"

    def __init__(self):
        self.held, self.edge = [], ""

    def feed(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of each turn that ends in this slice."""
        self.held.append(text)
        seen = self.edge + text
        self.edge = seen[1 - len(self.CLOSE):]
        if self.CLOSE not in seen:
            return []
        *turns, rest = "".join(self.held).split(self.CLOSE)
        self.held = [rest]
        self.edge = rest[1 - len(self.CLOSE):]
        return [self._turn(t) for t in turns]

    def _turn(self, body: str) -> tuple[str, str]:
        role, feed, text = body.removeprefix(START).partition("\n")
        if not body.startswith(START) or not feed:
            raise ValueError("a turn must begin with its marker and role")
        for plain, safe in (("<|", "%3C|"), ("\n", "%0A"), ("%", "%25")):
            role = role.replace(safe, plain)
        return role, _plain(text)

    def close(self) -> None:
        if any(self.held):
            raise ValueError("a conversation ends inside a turn")


class _Reader:
    """Counts and digests of one conversation, from its pieces."""

    def __init__(self):
        self.parser, self.at, self.turns, self.loss_chars = TurnParser(), 0, 0, 0
        self.said, self.loss, self.span, self.span_end = hashlib.sha256(), hashlib.sha256(), [], -1

    def add(self, body: str, starts: list[int], ends: list[int]) -> None:
        for role, text in self.parser.feed(body):
            self.turns += 1
            self.said.update(f"{role}\n{text}\n".encode())
        for a, b in zip(starts, ends):
            if a != self.span_end:  # a span that a piece boundary cuts goes on where it stopped
                self._end_span()
            self.span.append(body[a - self.at:b - self.at])
            self.span_end = b
        self.at += len(body)

    def _end_span(self) -> None:
        text = _plain("".join(self.span))
        self.loss_chars += len(text)
        self.loss.update(text.encode())
        self.span = []

    def close(self) -> tuple:
        self.parser.close()
        self._end_span()
        return self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.at


def read_conversations(pieces: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, parsed from the pieces of ``assemble``.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars, loss_sha256 (the
    text under the mask) and formatted_chars. Turns and roles come from the markers, not from rows or lengths;
    a string that is no sequence of whole turns raises. A SHA-256 takes its bytes in order, so a
    conversation passes one task, as a sorted stream of which the running digests and one turn are held.
    A null conv_id is a conversation too; an empty table gives no rows; other columns are not read.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader = None, None
        for batch in batches:
            out = []
            for key, *piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if reader is None or key != conv:
                    out += [] if reader is None else [(conv, *reader.close())]
                    conv, reader = key, _Reader()
                reader.add(*piece)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (conv, *reader.close())))], schema)

    rows = pieces.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "piece")
    spark_schema = ", ".join(f"{n} {'string' if 'sha' in n else 'bigint'}" for n in names)
    return rows.select("conv_id", "body", "mask_start", "mask_end").mapInArrow(run, spark_schema)
