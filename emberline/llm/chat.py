r"""Chat formatting: typed content parts to one text with placeholders, a loss mask and attachments.

A turn has a role and parts; a part is text, image, audio or document.  A visitor says for
each kind what a part becomes: text is escaped, everything else becomes one placeholder, is
recorded as an attachment in order, and counts as the tokens that a model expands it to.
The visits are column expressions, so turns are formatted where they lie.  Turns then go by
range of (conversation, turn) to tasks that join them into parts of bounded size; a
conversation of any length is spread over many tasks and never held whole.

Escaping: every control string has a first character and a rest.  Wherever both occur with
n backslashes between them, formatting makes that n + 1, reading n again, so an unescaped
control string is always one that the template wrote, and every text comes back unchanged.
Roles are escaped in the same way; line breaks in them count as control strings too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: the marks of the template, and those of other templates that texts must not bring in
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
CONTROLS = (OPEN, CLOSE, *PLACEHOLDERS.values(), *FOREIGN)

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: characters of a part of a conversation, about
PART_CHARS = 1 << 20
#: assistants' turns are what a model learns
LEARNED = ("assistant",)

_RESTS = "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}))
_ESCAPE = rf"([<\[])(\\*)({_RESTS})"
_UNESCAPE = rf"([<\[])\\(\\*)({_RESTS})"
_ROLE_BREAK = r"(\\*)\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def escape(text: str) -> str:
    """The same on one text."""
    return re.sub(_ESCAPE, r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return re.sub(_UNESCAPE, r"\1\2\3", text)


def escaped_role(role: Column) -> Column:
    """A line break after n backslashes becomes 2n + 1 of them and an n; other backslashes before an n double as well."""
    doubled = F.regexp_replace(escaped(role), r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"\n", r"\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


class Visitor:
    """What a part becomes, by kind: (text of the output, tokens of an attachment, 0 for text).

    Subclasses change sizes or add a method for a kind of their own and its placeholder.
    """

    #: pixels of a patch, tokens of a second of sound and of a page
    patch, second, page = 14, 25.0, 512

    def text(self, part: Column) -> tuple[Column, Column]:
        return escaped(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")

    def image(self, part: Column) -> tuple[Column, Column]:
        side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(0)), F.lit(1)) / self.patch)
        return F.lit(PLACEHOLDERS["image"]), (side("width") * side("height")).cast("long")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["audio"]), F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.second)).cast("long")

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit(PLACEHOLDERS["document"]), (F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.page).cast("long")

    kinds = ("text", "image", "audio", "document")

    def visit(self, part: Column) -> Column:
        """struct(kind, ref, text, tokens) of any part; a null kind is text, an unknown one an error."""
        kind = F.coalesce(part["kind"], F.lit("text"))
        unknown = F.raise_error(F.concat(F.lit("no such kind of part: "), kind))
        text, tokens = unknown.cast("string"), F.lit(0).cast("long")
        for name in self.kinds:
            what, n = getattr(self, name)(part)
            text, tokens = F.when(kind == name, what).otherwise(text), F.when(kind == name, n).otherwise(tokens)
        return F.struct(kind.alias("kind"), part["ref"].alias("ref"), text.alias("text"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """A message that is only text, as parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def format_turns(turns: DataFrame, visitor: Visitor | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end, attachments) of turns (conv_id, turn, role, parts), row by row.

    loss_start and loss_end bound the learned text within formatted, in code points; both
    are null for turns that are not learned.  attachments lists kind, ref, offset of the
    placeholder and tokens, in order.  A null role is '', null parts are none, a null part
    is an empty text.
    """
    visitor = visitor or Visitor()
    empty = F.array().cast(f"array<{PART}>")
    visits = F.transform(F.coalesce("parts", empty), visitor.visit)
    head = F.concat(F.lit(OPEN), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    rows = turns.select("conv_id", "turn", "role", head.alias("head"), visits.alias("visits"))
    body = F.array_join(F.transform("visits", lambda v: v["text"]), "")
    rows = rows.select("conv_id", "turn", "role", "head", "visits", body.alias("body"))
    start = F.length("head")

    def placed(at: Column, v: Column) -> Column:
        one = F.array(F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), at["at"].alias("offset"), v["tokens"].alias("tokens")))
        more = F.when(v["kind"] == "text", at["found"]).otherwise(F.concat(at["found"], one))
        return F.struct((at["at"] + F.length(v["text"])).alias("at"), more.alias("found"))

    nothing = F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<kind:string,ref:string,offset:int,tokens:bigint>>").alias("found"))
    attached = F.when(F.exists("visits", lambda v: v["kind"] != "text"), F.aggregate("visits", nothing, placed, lambda at: at["found"])).otherwise(nothing["found"])
    learns = F.coalesce(F.col("role").isin(list(learned)), F.lit(False))
    return rows.select(
        "conv_id", "turn", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("formatted"),
        F.when(learns, start).alias("loss_start"), F.when(learns, start + F.length("body")).alias("loss_end"), attached.alias("attachments"),
    )


CHAT = "conv_id {kind}, part long, n_turns long, formatted string, loss array<struct<start:int,stop:int>>, attachments array<struct<kind:string,ref:string,offset:int,tokens:bigint>>, n_tokens long"


def _joined(batches) -> Iterator[pa.RecordBatch]:
    """Turns in order to parts: a part ends with its conversation, or once it is long."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    texts, loss, attached, length, turns, now = [], [], [], 0, 0, None
    out: list[list] = []
    size, kind = 0, None

    def close():
        nonlocal texts, loss, attached, length, turns, number, size
        out.append([now[0], number, turns, "".join(texts), loss, attached, sum(a["tokens"] for a in attached)])
        size += length
        number += 1
        texts, loss, attached, length, turns = [], [], [], 0, 0

    def batch():
        nonlocal out, size
        types = [kind, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int32()), ("tokens", pa.int64())])), pa.int64()]
        names = ["conv_id", "part", "n_turns", "formatted", "loss", "attachments", "n_tokens"]
        done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        out, size = [], 0
        return done

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, text, start, stop, found in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachments")), strict=True):
            if now is not None and (now[0] != conv or length >= PART_CHARS):
                close()
                if size >= PART_CHARS or len(out) >= 10_000:
                    yield batch()
            now = (conv,)
            if start is not None:
                loss.append({"start": length + start, "stop": length + stop})
            attached += [a | {"offset": length + a["offset"]} for a in found]
            texts.append(text)
            length += len(text)
            turns += 1
    if now is not None:
        close()
        yield batch()


def format_chats(turns: DataFrame, visitor: Visitor | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss, attachments, n_tokens): conversations of turns (conv_id, turn, role, parts) as text.

    Turns of a conversation are in order of turn (null last), equal ones in order of what
    they say.  Nearly every conversation is one row; one that is longer than PART_CHARS, or
    that meets the border of a task's range, goes on in further rows, in order of `part`,
    each of whole turns.  loss and attachments refer to the row's own text.  n_tokens is
    what its attachments expand to.  A null conv_id is a conversation as well; repeated
    turns are kept; an empty table gives no rows.
    """
    kind = dict(turns.dtypes)["conv_id"]
    made = format_turns(turns.select("conv_id", "turn", "role", "parts"), visitor, learned)
    order = [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn"), F.asc("formatted")]
    dealt = made.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end", "attachments").mapInArrow(_joined, CHAT.format(kind=kind))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text, unescaped; placeholders stay."""
    out = []
    for turn in formatted.split(CLOSE + "\n")[:-1]:
        head, _, body = turn.partition("\n")
        out.append((unescape_role(head.removeprefix(OPEN)), unescape(body)))
    return out


def _digested(batches) -> Iterator[pa.RecordBatch]:
    """Parts in order to one row for each conversation, streaming."""
    now, kind, done = None, None, []

    def close():
        done.append([now["conv"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["formatted"]])

    def batch():
        nonlocal done
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate([kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)
        done = []
        return out

    for b in batches:
        kind = b.schema.field("conv_id").type
        for row in range(b.num_rows):
            conv, text, loss = (b.column(c)[row].as_py() for c in ("conv_id", "formatted", "loss"))
            if now is None or now["conv"] != conv:
                if now is not None:
                    close()
                now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            for role, said in read_turns(text):
                now["turns"] += 1
                now["all"].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["stop"]])
                now["chars"] += len(said)
                now["loss"].update(said.encode())
            now["formatted"] += len(text)
        if len(done) >= 10_000:
            yield batch()
    if now is not None:
        close()
        yield batch()


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the rows of format_chats.

    Everything is read from the formatted texts and their loss spans.  A digest runs over a
    conversation from its first to its last character, so its parts stream through one
    task, one part at a time.
    """
    kind = dict(chats.dtypes)["conv_id"]
    parts = chats.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions(F.asc_nulls_last("conv_id"), "part")
    return parts.mapInArrow(_digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
