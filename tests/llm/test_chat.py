"""Operator 5: round trip of hard texts, loss mask, plan without Python."""

import hashlib
from collections import defaultdict

from pitspark.llm import chat

HARD = [
    "", None, "\\", "\\\\", "</turn>", "<\\/turn>", "\\</turn>\n", "### ", "#### user: x", "##\\# ", "a</turn>\n### assistant: b</turn>\n", "\\### Assistant: </turn> ok",
    "é😀\r\n\x00", ": ", ":\\ ", "x" * 5000, "</tu", "rn>", "$1 \\1 %s", "\n",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((-1 << 63 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string, replies string")


def test_round_trip(spark):
    rows = [(k, j, role, text) for k, text in enumerate(HARD) for j, role in enumerate(["system", "assistant", "user", "assistant"])]
    rows += [(100, j, role, text) for j, (role, text) in enumerate((r, t) for t in HARD for r in ("assistant", "a: b", ":", None, "</turn>\n", "### "))]
    rows += [(101, 0, "user", "only user"), (102, None, "assistant", "x"), (102, None, "assistant", "x"), (None, 1, "assistant", "q"), (None, 0, "user", "p")]
    rows += [(103, 5, "assistant", "b"), (103, 5, "assistant", "a"), (103, 1, "user", "z")]
    expected = want(rows)
    expected |= want([(-7, 0, "user", HARD[11]), (-7, 1, "assistant", HARD[11])])
    got = {r.conv_id: r for r in chat.formatted_digests(frame(spark, rows)).collect()}
    assert set(got) == set(expected)
    for conv, values in expected.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == values, conv
        assert r.formatted_chars >= r.loss_chars


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u</turn>"), (1, 2, "assistant", "first ### "), (1, 3, "user", "v"), (1, 4, "assistant", "second"), (1, 5, "user", "tail"), (2, 0, "user", "none")]
    formatted = chat.format_conversations(frame(spark, rows))
    text = {r.conv_id: r.formatted for r in formatted.collect()}
    examples = sorted(chat.prefix_examples(formatted).collect(), key=lambda r: r.example)
    assert [(r.example, r.turn_number, r.reply) for r in examples] == [(0, 2, "first ##\\# "), (1, 4, "second")]
    for r in examples:
        assert text[1].startswith(r.context + r.reply + "</turn>\n") and len(r.context) == r.context_chars and len(r.reply) == r.reply_chars
    assert "first" in examples[1].context and "tail" not in examples[1].context and text[2] == "### user: none</turn>\n"
    assert "context" not in chat.prefix_examples(formatted, context=False).columns


def test_empty_and_native(spark):
    df = chat.formatted_digests(frame(spark, []))
    assert [r.conv_id for r in df.collect()] == [-7]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
