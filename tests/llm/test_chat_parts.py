import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from estatelens.llm import chat_parts, queries
from queryset import check

NASTY = st.lists(st.sampled_from([*"<>\\/turnimage\n#: aé", "<turn>", "</turn>", "<\\/turn>", "<image>"]), max_size=30).map("".join)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_any_text_and_role_come_back(turns):
    out = "".join(f"<turn>{chat_parts.escape_role(r)}\n{chat_parts.escape(t)}</turn>\n" for r, t in turns)
    assert chat_parts.read_back(out) == turns
    for role, text in turns:
        assert not any(f"<{c}>" in chat_parts.escape(text) for c in chat_parts.CONTROLS)


def plain(rows):
    """conv_id -> digests, by the words of the contract."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(t or "" for _, _, role, t in own if role == "assistant")
        whole = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own)
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a </turn> b <\\/turn> <image>"), (1, None, "system", "first"), (1, 1, "assistant", "tie"),
    (2, 0, "assistant", None), (3, 0, None, "\\"), (3, 2, "rôle\nx\\<turn>", "é" * 5), (3, 2, "rôle\nx\\<turn>", "é" * 5),
    (None, 0, "user", ""), (None, 1, "assistant", "x" * 300_000), (4, 5, "assistant", "## Assistant: \\n"),
]


@pytest.mark.parametrize("piece_chars", [1, 40, chat_parts.PIECE_CHARS])
def test_digests_against_a_plain_version(spark, piece_chars):
    turns = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").withColumns(
        {"piece": chat_parts.F.lit("clash"), "segment": chat_parts.F.lit(1), "_held": chat_parts.F.lit(2)})
    pieces = chat_parts.format_chats(turns, piece_chars=piece_chars)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_parts.digests(pieces).collect()}
    assert got == plain(ROWS)
    lengths = {r.conv_id: r.formatted_chars for r in chat_parts.digests(pieces).collect()}
    for conv, n in lengths.items():
        own = sorted((p for p in pieces.collect() if p.conv_id == conv), key=lambda p: p.piece)
        assert [p.start for p in own] == [sum(len(q.formatted) for q in own[:i]) for i in range(len(own))]
        assert sum(len(p.formatted) for p in own) == n


def part(kind, **more):
    return {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **more}


def test_typed_parts_become_ordered_placeholders(spark):
    parts = [part("text", text="see <image> "), part("image", ref="a.png", width=57, height=28), part("text", text="!"),
             part("audio", ref="b.wav", seconds=1.01), part("document", ref="c.pdf", pages=3), part(None, text="end"),
             part("video", text="odd"), None, part("image"), part("audio", seconds=float("nan"))]
    turns = spark.createDataFrame(
        [(1, 0, "user", [part("text", text="q")]), (1, 1, "assistant", parts), (1, 2, "user", None)],
        f"conv_id bigint, turn bigint, role string, parts array<{chat_parts.PART}>")
    row = chat_parts.format_chats(turns).collect()[0]
    content = row.formatted.split("\n")[3 - 1]
    assert row.formatted.count("<turn>") == 3
    assert "see <\\image> <image>!<audio><document>endodd<image><audio></turn>" in row.formatted, content
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [
        ("image", "a.png", 3), ("audio", "b.wav", 26), ("document", "c.pdf", 3 * 1024), ("image", None, 1), ("audio", None, 1)]
    for a in row.attachments:
        assert row.formatted[a.at:].startswith(f"<{a.kind}>")
    assert [chat_parts.unescape(row.formatted[s.start:s.end]) for s in row.loss] == ["see <image> ", "!", "end", "odd"]
    digest = chat_parts.digests(chat_parts.format_chats(turns)).collect()[0]
    assert (digest.n_attachments, digest.attachment_tokens) == (5, 3 + 26 + 3072 + 2)


def test_parts_from_json(spark):
    df = spark.createDataFrame([('[{"type":"image","ref":"x","width":3,"height":4},{"type":"text","text":"t"}]',), ("plain",), (None,)], "c string")
    got = [r[0] for r in df.select(chat_parts.parts_from_json(chat_parts.F.col("c"))).collect()]
    assert [[(p.type, p.text, p.ref) for p in g] for g in got] == [
        [("image", None, "x"), ("text", "t", None)], [("text", "plain", None)], [("text", "", None)]]


def test_empty_table(spark, folder):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_parts.format_chats(empty).count() == 0
    rows = queries.op11_chat_parts(spark, folder(conversations=empty)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-7, 2, len(queries.CHAT_TEXT))]


def test_query_against_its_twin(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_chat_parts(spark, sf).toArrow()
    want = check.sql_engine(sf).sql(queries.ORACLES["op11_chat_parts"]).to_arrow_table()
    assert {f.name: str(f.type).replace("large_", "") for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert check.rows_of(got) == check.rows_of(want)
