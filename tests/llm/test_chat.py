import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlog.llm import chat as H
from strandlog.llm.chat import Part

PIECES = ["a", "\\", "\\\\", " ", "\n", "<s>", "</s>", "[INST]", "[/INST]", "<|", "|>", "<|role:/|>", "<|image:0|>", "<", "[", "é", "s>", "\\<"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escapes_turn_back_and_hide_control_strings(text):
    hidden = H.escape(text)
    assert H.unescape(hidden) == text
    assert not any(x in hidden for x in H.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to|>ol", "/", "<|>", "a<|>b", "|>>", "\\<|", "<s>[INST]"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=5))
def test_parse_reads_back(turns):
    flat = H.render([(r, [Part("text", t)]) for r, t in turns])
    whole = "".join(flat.out)
    assert H.parse(whole) == turns
    assert "".join(H.unescape(whole[a:b]) for a, b in flat.loss) == "".join(t for r, t in turns if r == "assistant")


def test_parts_are_flattened_in_order():
    flat = H.render([("user", [Part("text", "see "), Part("image", ref="i.png", width=28, height=15), Part("text", " and "), Part("document", ref="d.pdf", pages=2)]), ("assistant", [Part("audio", ref="s.wav", seconds=1.0), Part("text", "ok")])])
    whole = "".join(flat.out)
    assert whole == "<s>[INST] see <|image:0|> and <|document:1|> [/INST] <|audio:2|>ok </s>"
    assert [(a.number, a.type, a.ref, a.tokens, whole[a.at : a.at + 3]) for a in flat.attachments] == [(0, "image", "i.png", 6, "<|i"), (1, "document", "d.pdf", 1536, "<|d"), (2, "audio", "s.wav", 50, "<|a")]
    assert [whole[a:b] for a, b in flat.loss] == ["ok"]


@pytest.mark.parametrize("part", [Part("video", ref="x"), Part("image", ref="x"), Part("image", width=1, height=1), Part("audio", ref="x"), Part("document", ref="x")])
def test_bad_parts(part):
    with pytest.raises(ValueError):
        H.render([("user", [part])])


def test_tables(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "".join(rng.choice(PIECES) for _ in range(9))])) for c in range(20) for t in range(rng.randint(1, 5))]
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 3, "assistant", "x" * 100000), (99, None, "user", "")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(3)
    got = {r.conv_id: r for r in H.digests(H.format_conversations(turns)).collect()}
    low = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: tuple(map(low, r[1:])))
        said = [(r or "user", t or "") for _, _, r, t in mine]
        loss = "".join(t for r, t in said if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len("".join(H.render([(r, [Part("text", t)]) for r, t in said]).out)))
        assert tuple(got[conv]) == want
    assert len(got) == len({r[0] for r in rows})
    assert H.digests(H.format_conversations(turns.limit(0))).count() == 0


def test_joined_pieces_are_one_readable_string(spark):
    rows = [(1, 0, "<|>", "x<|>y"), (1, 1, "assistant", "<</s>[[INST]"), (1, 2, "a<|>b", "|>|>"), (1, 3, "user", "\\<|\\>"), (1, 4, "assistant", " ok </s>")]
    pieces = H.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    whole = "".join(p.piece for p in pieces)
    assert H.parse(whole) == [(r, t) for _, _, r, t in rows]
    assert [H.unescape(whole[s.begin : s.end]) for p in pieces for s in p.loss] == [rows[1][3], rows[4][3]]
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert H.digests(H.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first().turns_sha256 == want


def test_table_of_parts(spark):
    parts = "array<struct<type string, text string, ref string, width int, height int, seconds double, pages int>>"
    turns = spark.createDataFrame([(1, 0, "user", None, [("text", "a", None, None, None, None, None), ("image", None, "r", 14, 14, None, None)])], f"conv_id long, turn long, role string, text string, parts {parts}")
    row = H.format_conversations(turns, parts_col="parts").first()
    assert row.piece == "<s>[INST] a<|image:0|> [/INST]" and row.attachments[0].tokens == 2
