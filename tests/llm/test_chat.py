"""Chat formatting: ties, repeated rows, long conversations, nulls; equal to its SQL."""

import random

import duckdb
import pytest

from corpuslens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def both(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    told = sorted(con.execute(chat.SQL).fetchall(), key=repr)
    made = sorted(map(tuple, chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)
    return made, told


def test_tied_turns_are_in_order_of_role_and_text(spark):
    rows = [(1, 0, "user", t) for t in ("ccc", "aaa", "ddd", "bbb")] + [(2, 0, "b", "x"), (2, 0, "a", "y")]
    made, told = both(spark, rows)
    assert made == told
    assert made[0][3] == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in ("aaa", "bbb", "ccc", "ddd"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ties_repeats_and_nulls_equal_sql(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(12), rng.choice([None, 0, 1, 1, 2]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None])) for _ in range(60)]
    made, told = both(spark, [*rows, *rows[:10]])
    assert made == told


def test_long_texts_and_conversations(spark):
    long = "word " * 200_000
    turns = [(7, i, "user", f"t{i}") for i in range(3000)]
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "bot", "ok"), *turns, *[(8, *t[1:]) for t in turns[:2000]]]
    made, told = both(spark, rows)
    assert made == told and {r[0] for r in made} == {2, 7}
