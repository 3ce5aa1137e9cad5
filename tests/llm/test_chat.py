"""Chat formatting: round trips, loss masks, attachments, long conversations, odd rows, and the SQL."""

import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.llm import chat
from emberline.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def turns_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("parts", chat.text_parts(F.col("text"))).withColumns({"part": F.lit(1), "formatted": F.lit("x"), "head": F.lit("y")})


def plain(rows):
    """conv_id -> (turns, digest, learned characters, digest) from the rows alone."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "", r[1]) for r in rows if r[0] == conv]
        form = lambda r, t: chat.OPEN + r.replace("\\", "\\\\") + "\n" + chat.escape(t) + chat.CLOSE + "\n"
        own.sort(key=lambda r: (r[2] is None, r[2] or 0, form(r[0], r[1]).encode()))
        learned = "".join(t for r, t, _ in own if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), digest("".join(f"{r}\n{t}\n" for r, t, _ in own)), len(learned), digest(learned))
    return out


def found(spark, rows):
    got = chat.read_back(chat.format_chats(turns_of(spark, rows))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    bits = [*chat.CONTROLS, "\\", "<", "[", "|", ">", "\n", "a", "é", "😀", "im_start|>", "/INST]", "SYS>>", "<\\s>", "<\\\\s>", "[\\/INST]"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    out = [(i // 5, i % 5, rng.choice(["user", "assistant", "system", "tool"]), text()) for i in range(200)]
    return [*out, (100, None, "user", "late"), (100, 1, "assistant", None), (100, 1, None, ""), (None, 0, "user", "no id"), (None, 1, "assistant", "x"), out[0], out[0]]


def test_every_text_comes_back(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(2)
    bits = [*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "INST]", "<SYS>>", "|im_end|>", "\n", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROLS)


def test_roles_with_breaks_and_marks(spark):
    rows = [(1, 0, "us\ner", "a"), (1, 1, "\\n", "b"), (1, 2, "<|im_end|>\n", "c"), (1, 3, "as\\\nsistant", "d"), (1, 4, None, "e")]
    got = chat.format_chats(turns_of(spark, rows)).collect()
    assert [t for r in sorted(got, key=lambda r: r.part) for t in chat.read_turns(r.formatted)] == [(r[2] or "", r[3]) for r in rows]


def test_a_long_conversation_is_cut_and_joined(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 500)
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i} </s>") for i in range(400)] + [(2, 0, "assistant", "x" * 2000)]
    parts = chat.format_chats(turns_of(spark, rows))
    assert parts.where("conv_id = 1").count() > 10
    assert found(spark, rows) == plain(rows)


def test_loss_spans_hold_the_assistant_alone(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "[INST]"), (1, 2, "assistant", "</s>é😀"), (1, 3, "assistant", ""), (1, 4, "user", "u")]
    (r,) = chat.format_chats(turns_of(spark, rows)).collect()
    assert [chat.unescape(r.formatted[s.start : s.stop]) for s in r.loss] == ["</s>é😀", ""]
    assert r.n_turns == 5 and r.attachments == [] and r.n_tokens == 0


def test_parts_become_placeholders_and_attachments(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [
        (1, 0, "user", [part("text", "see <|image|> "), part("image", ref="a.png", width=28, height=15), part(None, " and "), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3)]),
        (1, 1, "assistant", [part("text", "made "), part("image", ref="d.png")]),
        (1, 2, "user", None),
    ]
    (r,) = chat.format_chats(spark.createDataFrame(rows, PARTS)).collect()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("image", "d.png", 1)]
    assert all(r.formatted[a.offset :].startswith(chat.PLACEHOLDERS[a.kind]) for a in r.attachments)
    assert r.n_tokens == 4 + 38 + 1536 + 1 and r.n_turns == 3
    assert r.formatted.count("<|image|>") == 2
    assert [t for _, t in chat.read_turns(r.formatted)] == ["see <|image|> <|image|> and <|audio|><|document|>", "made <|image|>", ""]
    with pytest.raises(Exception, match="no such kind"):
        chat.format_chats(spark.createDataFrame([(1, 0, "user", [part("video")])], PARTS)).collect()


def test_a_visitor_of_ones_own(spark):
    class Larger(chat.Visitor):
        patch = 7

    row = [(1, 0, "user", [("image", None, "a", 14, 14, None, None)])]
    assert chat.format_chats(spark.createDataFrame(row, PARTS), Larger()).first().n_tokens == 4


def test_empty_table(spark):
    assert found(spark, []) == {}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = QUERIES["op13_chat"](spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op13_chat']})").fetchall())
