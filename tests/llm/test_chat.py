import hashlib
import json
import random

import duckdb
import pytest

from paragraf.llm import chat

SHAPE = "conv_id long, turn long, role string, text string"
HOSTILE = [chat.HOSTILE, "<|", "<\\|", "<\\\\|im_end|>", "\\", "\\n", "<|im_start|>user\nx<|im_end|>\n", "", "é😀", "<<||", "a\n\nb"]


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), digest("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


def test_hostile_turns(spark):
    rnd = random.Random(1)
    rows = [(c, n, rnd.choice(["user", "assistant", "system", "we\nird\\n<|", None]), rnd.choice([*HOSTILE, None])) for c in range(30) for n in range(rnd.randint(1, 9))]
    turns = spark.createDataFrame(rows, SHAPE)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(turns).collect()}
    assert got == expected(rows)
    chars = {r.conv_id: r.formatted_chars for r in chat.digests(turns).collect()}
    for r in chat.conversations(turns).collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == got[r.conv_id][0]
        assert hashlib.sha256("".join(chat.unescape(r.formatted[s.start : s.stop]) for s in r.loss_spans).encode()).hexdigest() == got[r.conv_id][3]
        assert len(r.formatted) == chars[r.conv_id]


@pytest.mark.parametrize("text", HOSTILE)
def test_segments_read_back(spark, text):
    row = chat.segments(spark.createDataFrame([(1, 0, text, text)], SHAPE)).first()
    assert chat.read_segment(row.segment) == (text, text)


def test_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    names = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    rows = con.sql(f"SELECT {names} FROM ({chat.SQL['op8_chat']})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in chat.op8_chat(spark, sf_dir).select(*names.split(", ")).collect())


RECORDS = [
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"output": "o", "instruction": "i", "input": "x"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"output": "o", "instruction": "i", "input": ""}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": None}, [("user", "i"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"conv_id": 909, "turn": 4, "role": "user", "text": "t"}, [("user", "t")]),
    ({"messages": []}, []),
    ({"other": 1}, None),
]


def test_layouts(spark):
    lines = [(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(100, "{broken"), (101, None), (102, "[1]")]
    rows = chat.turns_of_records(spark.createDataFrame(lines, "id long, line string"), "id", "line").collect()
    for k, (_, turns) in enumerate(RECORDS):
        mine = sorted((r.turn or 0, r.role, r.text, r.layout) for r in rows if r.conv_id == (909 if k == 7 else k))
        assert [m[1:3] for m in mine] == (turns if turns is not None else [(None, None)])
        assert turns is not None or mine[0][3] == "unknown"
    assert sum(r.layout == "unknown" for r in rows) == 4
    assert chat.fingerprint({"a", "b"}) == chat.fingerprint(["b", "a", "a"]) != chat.fingerprint({"a"})


def test_frames(spark):
    frame = spark.createDataFrame([(1, [("human", "a"), ("gpt", None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in chat.turns_of_frame(frame, drop=("conv_id",)).collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "")]
    frame = spark.createDataFrame([(1, "i", None, "o")], "id long, instruction string, input string, output string")
    assert [tuple(r) for r in chat.turns_of_frame(frame, "id").collect()] == [(1, 0, "user", "i"), (1, 1, "assistant", "o")]
    frame = spark.createDataFrame([(1, 2, "user", "x", "y")], "conv_id long, turn long, role string, text string, segment string")
    assert [tuple(r) for r in chat.turns_of_frame(frame).collect()] == [(1, 2, "user", "x")]
    with pytest.raises(ValueError):
        chat.turns_of_frame(spark.range(1))


def test_edges(spark):
    rows = [(None, None, None, None), (1, 0, "assistant", "x" * 300_000), (1, 0, "assistant", "x" * 300_000)]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {None: (1, 0), 1: (2, 600_000)}
    assert chat.digests(spark.createDataFrame([], SHAPE)).count() == 0


def test_reader_of_parts_cut_anywhere(spark):
    import random

    rnd = random.Random(1)
    pool = [chat.HOSTILE, "", "<", "<|", "\\<\\|", "a\nb", chat.END, chat.START, "<\\|im_end|>\n", "é𝄞"]
    turns = [(1, k, rnd.choice(["user", "assistant", "a\nb\\", "<|x"]), "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 4)))) for k in range(60)]
    whole = chat.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    spans = [(s.start, s.stop) for s in whole.loss_spans]
    wanted = [(r, t) for _, _, r, t in turns], [t for _, _, r, t in turns if r == "assistant"]
    assert chat.read_conversation(whole.formatted, spans) == wanted
    for _ in range(20):
        reader, got, at, left = chat.Reader(), ([], []), 0, list(spans)
        while at < len(whole.formatted):
            n = rnd.randint(1, 60)
            now = [s for s in left if s[0] < at + n]
            left = left[len(now) :]
            for a, b in zip(got, reader.feed(whole.formatted[at : at + n], now), strict=True):
                a += b
            at += n
        reader.close()
        assert got == wanted
    for broken in (whole.formatted[:-1], whole.formatted[1:]):
        with pytest.raises(ValueError):
            chat.read_conversation(broken, spans)


def test_turns_win_over_other_layouts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", "p", "r", "c", "i", "o")], "conv_id long, turn long, role string, text string, prompt string, response string, completion string, instruction string, output string")
    assert [tuple(r) for r in chat.turns_of_frame(rows).collect()] == [(1, 0, "user", "hi")]
