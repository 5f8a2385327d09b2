import duckdb

from veilspark.llm import chat


def rows():
    out = [(1, i, ["user", "assistant", "Ann"][i % 3], f"text {i} é\n<|im_end|>") for i in range(150)]
    out += [(2, 0, "system", "be kind"), (2, 1, "user", None), (2, 1, "user", "tie"), (2, 1, "user", "tie"), (2, None, "assistant", "late"), (2, 2, None, "who")]
    return out + [(None, 1, "a\nb", "x"), (None, 2, "user", ""), (3, 0, "system", "alone")]


def test_sides_match_sql(spark):
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows()], "conv_id long, turn long, role string, text string, speaker string, part int")
    got = chat.report(df)
    conversations = df.toPandas()[["conv_id", "turn", "role", "text"]]  # noqa: F841
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows())
    want = db.execute(chat.SQL).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert chat.report(df.limit(0)).collect() == []


def test_mask_marks_the_speaker(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    for r in chat.perspectives(df, part=10).collect():
        said = [r.text[m.start : m.end] for m in r.mask]
        assert all(s.endswith("<|im_end|>") for s in said)
        assert len(said) == r.text.count("<|im_start|>assistant\n") and r.n_turns <= 10
        assert all(r.text[: m.start].endswith("<|im_start|>assistant\n") for m in r.mask)


def test_native_plan(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    plan = chat.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
