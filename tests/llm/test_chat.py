"""Chat formatting against a plain Python rendering, and exact round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceloom.llm import chat, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "plain", "<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "\\", "\\\\", "<\\|im_end|>", "\\<|im_start|>\\|", "a\nb\n", "<|esc|>",
         "<|im_end|>\\", "<|", "<", "|im_end|>", "é́ 中文 😀", "\n", "<|im_end", "\\n<|im_start|>\\\\|"]


def read(df):
    return {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_nasty_texts_and_roles(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "a<|esc|>", "x\ny", "\\n", "", "<|im_end|>", "a\\<|esc|>"])
            for t, text in enumerate(NASTY)]
    got = read(spark.createDataFrame(rows, SCHEMA))
    for c in {r[0] for r in rows}:
        want = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["round_trip_ok"]
        assert got[c]["loss_texts"] == [text if role == "assistant" else "" for role, text in want]


def test_plain_turns_stay_plain(spark):
    got = read(spark.createDataFrame([(1, 0, "user", "back\\slash <| ok"), (1, 1, "assistant", "fine")], SCHEMA))
    assert got[1]["formatted"] == "<|im_start|>user\nback\\slash <| ok<|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n"


def test_nulls_ties_repeats_and_clashes(spark):
    rows = [(None, 1, "user", "n"), (1, None, "user", "first"), (1, 2, None, None), (1, 3, "b", "x"), (1, 3, "a", "y"), (1, 3, "a", "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("start", "rendered", "ok", "plain", "formatted", "spans", "chars")})
    got = read(df)
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("a", "y"), ("a", "y"), ("b", "x")]
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "n")]
    assert read(spark.createDataFrame([], SCHEMA)) == {}


def test_spans_point_at_texts(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    source = {}
    for r in df.orderBy("conv_id", "turn").collect():
        source.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    for r in chat.format_conversations(df).collect():
        assert len(r["spans"]) == len(source[r["conv_id"]])
        for s, (role, text) in zip(r["spans"], source[r["conv_id"]]):
            piece = r["formatted"][s["text_start"]:s["text_end"]]
            assert s["loss"] == (role == "assistant") and (piece == text or "<|" in text)


def test_long_text(spark):
    text = ("line <|im_end|> \\ " * 60_000)
    got = read(spark.createDataFrame([(1, 0, "assistant", text)], SCHEMA))
    assert got[1]["loss_texts"] == [text]


def test_query(spark):
    source = {-1: [("user", queries.CLASH), ("assistant", queries.CLASH)]}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect():
        source.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    rows = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, FOLDER).collect()}
    assert set(rows) == set(source)
    for c, turns in source.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        log = "".join(f"{role}\n{t}\n" for role, t in turns)
        want = (len(turns), hashlib.sha256(log.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        r = rows[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want


@pytest.fixture(scope="module")
def engine(spark):
    return spark


def test_random_round_trips(engine):
    pieces = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<|esc|>", "\\", "\n", "|", "<", "a", "<\\|"]), max_size=8).map("".join)

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.tuples(pieces, pieces), min_size=20, max_size=60))
    def check(turns):
        df = engine.createDataFrame([(1, t, role, text) for t, (role, text) in enumerate(turns)], SCHEMA)
        assert [tuple(t) for t in read(df)[1]["turns"]] == turns
    check()
