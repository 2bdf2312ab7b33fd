import hashlib
import random

import pytest

from graphloom.llm.chat_format import CONTROLS, HistoryRewritten, conversation_digests, escape, format_conversations, locate, marked_turns, read_turns, unescape


def noise(rng):
    return "".join(rng.choice([*CONTROLS, "\\", "<", "|", "im_end", "a", "\n", " ", "é", "x", "y", "[", "s>"]) for _ in range(rng.randrange(12)))


def test_escape_round_trip():
    rng = random.Random(5)
    for _ in range(5000):
        t = noise(rng)
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROLS)


def test_spans_and_reading_back():
    rng = random.Random(6)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "odd\nrole\\", "<s>"]), noise(rng)) for _ in range(rng.randrange(6))]
        output, spans = locate(marked_turns, turns)
        assert read_turns(output) == turns
        assert [unescape(output[s.text_start : s.text_end]) for s in spans] == [t for _, t in turns]
        assert "".join(output[s.start : s.end] for s in spans) == output


def test_bad_templates():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    with pytest.raises(HistoryRewritten):
        locate(lambda ts: f"{len(ts)}:" + "".join(t for _, t in ts), turns)
    with pytest.raises(HistoryRewritten):  # drops earlier answers
        locate(lambda ts: "".join(f"({t})" for i, (r, t) in enumerate(ts) if r == "user" or i == len(ts) - 1), turns)
    with pytest.raises(ValueError):
        locate(lambda ts: "." * len(ts), turns)


def test_rows(spark):
    rows = [(1, 2, "assistant", "late</s>", "q"), (1, 1, "user", None, "q"), (1, None, None, "first", "q"), (2, 1, "user", "only", "q"), (None, 1, "assistant", "lost", "q"), (2, 1, "user", "only", "q"), (3, 1, "assistant", "word " * 50_000, "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in conversation_digests(format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    assert got[1]["turns_sha256"] == sha("\nfirst\nuser\n\nassistant\nlate</s>\n") and got[1]["loss_sha256"] == sha("late</s>")
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 0 and got[3]["loss_chars"] == 250_000
    assert format_conversations(df.limit(0)).count() == 0
    bad = format_conversations(df, lambda ts: str(len(ts))).collect()
    assert all(r["formatted"] is None and r["problem"] for r in bad)
