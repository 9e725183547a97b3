"""Steps that were too large for the driver or for one task on larger tables."""

import re

from tallyfold.functions.skew import expected
from tallyfold.operators.copies import passage_origins
from tallyfold.operators.privacy import pseudonymise, restore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df, key):
    """The kinds of join on exactly these columns."""
    columns = ", ".join(rf"{k}#\d+L?" for k in key)
    return set(re.findall(rf"(\w+Join) \[{columns}\]", plan_of(df)))


def test_runs_of_words_are_not_broadcast(spark, tmp_path):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(i // 3, i, f"{text} {i}") for i in range(30)], "owner long, key long, text string")
    names = [(i, n) for i in range(10) for n in ("two  three", "six", None)]
    for name, df in (("docs", docs), ("names", spark.createDataFrame(names, "owner long, name string"))):
        df.write.parquet(f"{tmp_path}/{name}")
    docs, names = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/names")
    done = pseudonymise(docs, names, "owner", ["key"])
    assert joins(done["docs"], ["owner", "words"]) == {"SortMergeJoin"}
    assert {r.text for r in done["docs"].where("key = 4").collect()} == {"one طالب 2 four five طالب 1 seven 4"}
    back = restore(done["docs"].drop("places"), done["map"], "owner", ["key"])
    assert joins(back, ["owner", "_n"]) == {"SortMergeJoin"}
    assert {r.text for r in back.where("key = 4").collect()} == {f"{text.replace('two three', 'two  three')} 4"}


def test_passages_move_once(spark, tmp_path, hot):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base[:20] + ["x"] + base[25:]), " ".join(base), None, "", "w1 W2", "w1, w2!"]
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(9 - k, f"{' '.join(base[k : k + 12])} y{k}") for k in range(2)]
    spark.createDataFrame([*rows, (None, texts[0])], "k long, t string").write.parquet(f"{tmp_path}/entries")
    entries = spark.read.parquet(f"{tmp_path}/entries")
    found = passage_origins(entries, "k", "t", 3)
    # Of the exchanges one holds a row for each passage, and no join does.
    assert plan_of(found).count("Exchange hashpartitioning(passage#") == 1
    assert not joins(found, ["passage"])
    want = {
        (1, 38, 0, None, 0), (2, 34, 31, 1, 31), (4, 0, 0, None, 0), (6, 1, 0, None, 0), (7, 1, 1, 6, 1),
        (8, 11, 10, 1, 10), (9, 11, 10, 1, 10),
    }
    # Texts 4 and 5 differ: null and empty.
    want.add((5, 0, 0, None, 0))
    assert set(map(tuple, found.collect())) == want
    # Passages expected to be very common take another plan with the same result.
    with hot(1):
        assert set(map(tuple, passage_origins(entries, "k", "t", 3).collect())) == want


def test_keys_expected_to_be_hot(spark, hot):
    part = spark.createDataFrame([(b"a",)] * 5 + [(b"b",)], "passage binary")
    assert expected(part, "passage", 4).values is None
    with hot(10):
        found = expected(part, "passage", 4)
        assert [bytes(r.passage) for r in found.values.collect()] == [b"a"] and found.rows == 20
