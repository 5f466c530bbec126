from __future__ import annotations

from cinderlog.llm import chat

TALK = [
    (1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "I am fine.\nThanks"), (1, 2, "u", "ok next"), (1, 3, "a", "> hello   THERE\n>> old\nreply to hello"), (1, 4, "u", "more"),
    (1, 5, "a", "> ok next\nre next"), (1, 6, "u", None), (1, 7, "u", ">more\n>zzz\nlast"), (2, 0, "u", "> nothing\nx"), (None, 1, "u", "> a"), (3, None, None, "y"),
]
DDL = "conv_id long, turn long, role string, text string"


def test_links_and_order(spark):
    df = spark.createDataFrame(TALK, DDL)
    linked = chat.link(df)
    rows = {(r.conv_id, r.turn): r for r in linked.collect()}
    assert len(rows) == len(TALK)
    assert [rows[1, i].parent_turn for i in range(8)] == [None, 0, 1, 0, 3, 2, 5, 4]
    assert rows[1, 3].text == "reply to hello"
    assert (rows[1, 3].n_quoted_lines, rows[1, 3].n_linked_lines, rows[1, 3].max_depth) == (2, 1, 2)
    assert rows[2, 0].n_linked_lines == 0
    assert rows[None, 1].text == ""
    order = [r.turn for r in chat.conversations_in_order(linked.where("conv_id = 1")).collect()]
    assert order == [0, 1, 2, 5, 6, 3, 4, 7]


def test_order_is_a_walk_through_the_replies(spark):
    """Against a recursive walk over random reply trees, with stretches smaller than a conversation."""
    import random

    rng = random.Random(3)
    rows, parent = [], {}
    for t in range(60):
        lines = [f"words of {t}"]
        parent[t] = t - 1 if t else None
        if t and rng.random() < 0.5:
            parent[t] = rng.randrange(t)
            lines.insert(0, f"> Words  of {parent[t]}")
        rows.append((7, t, "u", "\n".join(lines)))
    old, chat.STRETCH = chat.STRETCH, 8
    try:
        linked = chat.link(spark.createDataFrame(rows, DDL))
        assert {r.turn: r.parent_turn for r in linked.collect()} == parent
        got = [r.turn for r in chat.conversations_in_order(linked).collect()]
    finally:
        chat.STRETCH = old
    want, todo = [], [0]
    while todo:
        t = todo.pop()
        want.append(t)
        todo += sorted((x for x in parent if parent[x] == t), reverse=True)
    assert got == want


def test_latest_of_equal_lines_wins(spark):
    rows = [(1, 0, "u", "same"), (1, 1, "a", "same"), (1, 2, "u", "other"), (1, 3, "a", "> same\nyes"), (2, 5, "u", "> same\nelsewhere"), (1, 3, "a", "twice the turn")]
    found = chat.link(spark.createDataFrame(rows, DDL)).collect()
    assert len(found) == len(rows)
    assert {r.parent_turn for r in found if (r.conv_id, r.turn) == (1, 3)} == {1}
    assert [r.parent_turn for r in found if r.conv_id == 2] == [None]


def test_no_python_and_empty_tables(spark):
    df = spark.createDataFrame(TALK, DDL).selectExpr("*", "'x' AS before", "'y' AS line", "'z' AS stretch")
    plan = chat.link(df)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
    assert "CartesianProduct" not in plan
    assert chat.link(df.limit(0)).count() == 0


def test_passages(spark):
    df = spark.createDataFrame([("a\nb\n> c\n>d\n>> e\nf",), (None,)], "t string").select(chat.passages(chat.lines_of("t" and __import__("pyspark.sql.functions", fromlist=["x"]).col("t"))).alias("p"))
    first = df.first().p
    assert [(x.depth, x.text) for x in first] == [(0, "a\nb"), (1, "c\nd"), (2, "e"), (0, "f")]


def test_levels_and_wrapped_passages(spark):
    first = "The first message is long enough to be wrapped.\nIt has two sentences on two lines."
    rows = [
        (1, 0, "u", first), (1, 1, "a", "> The first message is long\n> enough to be wrapped. It has two\n> sentences on two lines.\nAn answer"), (1, 2, "u", "Something else"),
        (1, 3, "a", "> The first message is\n> long enough to be wrapped.\nre-wrapped and trimmed"), (1, 4, "u", "Yet another"), (1, 5, "a", ">> Something\n>> ELSE\nonly the second level, which nobody quoted"),
        (1, 6, "u", "> Yet another\nquoting"), (1, 7, "a", "more"), (1, 8, "u", ">> Yet another\nto the message that quoted it"), (1, 9, "a", "> quoting\n>> Yet another\n>>> no one said this\nboth"), (1, 10, "u", ">>> Yet\n>>> another\nthird level"),
    ]
    found = {r.turn: r for r in chat.link(spark.createDataFrame(rows, DDL)).collect()}
    assert [found[i].parent_turn for i in range(11)] == [None, 0, 1, 0, 3, 2, 4, 6, 6, 6, 9]
    assert [found[i].n_linked_lines for i in range(11)] == [0, 3, 0, 2, 0, 2, 1, 0, 1, 2, 2]
