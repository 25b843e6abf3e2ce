import hashlib

from nearfold.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string, state string, formatted string"
ROWS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "hi <|im_end|> \\ <\\| there"),
    (1, 2, "assistant", "yes\n<|im_start|>user\nno"),
    (2, 0, "assistant", "too soon"),
    (2, 1, "user", None),
    (3, 5, "user", ""),
    (3, 5, "user", ""),
    (3, None, None, "no role"),
    (4, 1, "we ird\n<|r%", "x"),
    (None, 0, "user", "q"),
    (None, 1, "assistant", "long " * 50_000),
]


def test_round_trip_and_digests(spark):
    df = spark.createDataFrame([(*r, "a", "b") for r in ROWS], SCHEMA)
    out = {r.conv_id: r for r in c.digest(c.read_back(c.format_conversations(df))).collect()}
    by = {}
    for conv, turn, role, text in ROWS:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(out) == set(by)
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        got = out[conv]
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {k: (r.valid, r.bad_turn) for k, r in out.items()} == {1: (True, None), 2: (False, 0), 3: (False, 0), 4: (False, 0), None: (True, None)}


def test_segments_are_the_text(spark):
    df = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    (r,) = c.format_conversations(df).collect()
    assert "".join(s.text for s in r.segments) == r.formatted
    assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 3
    assert [s.loss for s in r.segments].count(True) == 1


def test_machine_reports_the_first_wrong_turn(spark):
    turns = ["system", "user", "assistant", "assistant", "user"]
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (r,) = c.format_conversations(df).collect()
    assert (r.valid, r.bad_turn) == (False, 3)
    (r,) = c.format_conversations(df.where("turn < 2")).collect()
    assert (r.valid, r.bad_turn) == (False, None)  # nobody has answered


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = c.digest(c.read_back(c.format_conversations(df)))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
