import hashlib

from docquery.llm import chat_format as c

SCHEMA = "conv_id bigint, turn int, role string, text string, segments string, position string"


def key(r):
    return None if r.conv_id is None else int(r.conv_id)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def digest(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def test_read_back(spark):
    odd = ["\\### Assistant: </turn> ok", "### User: ", "</turn>\n", "\\", "\\\\", "", None, "#### </turn", "a\n### System: b", "\U0001f600" * 3, "x" * 100_000]
    convs = {1: [("user", odd[0]), ("assistant", odd[0])], 2: [("system", t) for t in odd], 3: [("assistant", t) for t in odd], 4: [("to: ol### \\", "t"), (None, "n"), ("user", odd[2])], None: [("user", "null id")]}
    rows = [(k, i, r, t) for k, v in convs.items() for i, (r, t) in enumerate(v)]
    got = {key(r): r for r in c.read_back(c.format_conversations(frame(spark, rows))).collect()}
    assert set(got) == set(convs)
    for k, v in convs.items():
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == digest(v)


def test_order_of_turns(spark):
    good = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "u")]
    bad = [(2, 0, "assistant", "a"), (2, 1, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "u"), (4, 0, "user", "u"), (4, 1, "system", "s"), (5, 0, "tool", "t")]
    got = {key(r): r.ordered for r in c.read_back(c.format_conversations(frame(spark, good + bad))).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_segments(spark):
    rows = c.format_conversations(frame(spark, [(1, 1, "assistant", "a ### b"), (1, None, "user", "u")])).orderBy("position").collect()
    assert [[tuple(s) for s in r.segments] for r in rows] == [[("### User: ", False), ("u", False), ("</turn>\n", False)], [("### Assistant: ", False), ("a \\### b", True), ("</turn>\n", False)]]


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    got = c.read_back(c.format_conversations(frame(spark, rows))).collect()
    assert [(r.n_turns, r.turns_sha256) for r in got] == [(3, digest([("user", "a"), ("user", "a"), ("user", "b")])[1])]
    assert c.read_back(c.format_conversations(frame(spark, []))).collect() == []


def test_long_conversation_over_batches(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(25_000)] + [(2, 0, "user", "z")]
    got = {key(r): r for r in c.read_back(c.format_conversations(frame(spark, rows))).collect()}
    assert got[1].turns_sha256 == digest([(r[2], r[3]) for r in rows[:-1]])[1] and got[1].ordered and got[2].n_turns == 1
