"""Small cases of review operators that their queries do not reach."""

from pyspark.sql import functions as F

from threadloom.operators import review


def test_tree_exports(spark):
    texts = ['{"mapping":{"a":1}}', '[{"x":1},{"mapping":{}}]', '{"conversations":[{"mapping":[1]}]}', '{"mapping":"no"}', '{"conversations":[{}]}', "{broken", None, "[]", '{"messages":[]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r["x"] for r in df.select("id", review.is_tree_export(F.col("t")).alias("x")).orderBy("id").collect()] == [True, True, True, False, False, False, False, False, False]


def test_clearing_drafts(spark):
    rows = [("a", "memo", "draft"), ("b", "", " Draft "), ("c", "case", "draft"), ("d", "memo", "live"), ("e", None, None)]
    cards = spark.createDataFrame(rows, "card_id string, card_type string, status string")
    left, n = review.without_drafts(cards, "memo")
    assert sorted(r["card_id"] for r in left.collect()) == ["c", "d", "e"] and n.first()[0] == 2
    left, n = review.without_drafts(cards)
    assert sorted(r["card_id"] for r in left.collect()) == ["d", "e"] and n.first()[0] == 3


def test_replaced_leaves(spark):
    schema = "bot string, display_name string, persona_summary string, style_notes array<string>, memory_notes array<string>, prompt_fragments array<string>"
    old = spark.createDataFrame([("a", "A", "s", ["x"], ["m"], None), ("b", "B", "", ["y"], [], [])], schema)
    new = spark.createDataFrame([("a", " ", "t", ["z", "z"], None, ["p"])], schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(review.merged_leaves(old, new)) == [("a", "A", "t", ["x", "z"], ["m"], ["p"]), ("b", "B", "", ["y"], [], [])]
    assert rows(review.merged_leaves(old, new, replace=True)) == [("a", "A", "t", ["z"], [], ["p"]), ("b", "B", "", ["y"], [], [])]


def test_noise(spark):
    handles = ["", "ok", "x" * 90 + " user: hi", "跨窗口时间拼接 1 窗口 001 跨窗口时间拼接 2 窗口 002"]
    df = spark.createDataFrame(list(enumerate(handles)), "id int, t string")
    assert [r["x"] for r in df.select("id", review.noisy_handle(F.col("t")).alias("x")).orderBy("id").collect()] == [True, False, True, True]
    triggers = ["跨窗口时间拼接 3 窗口 004", "最软→工作", "事件", "a b c", "tool"]
    df = spark.createDataFrame(list(enumerate(triggers)), "id int, t string")
    assert [r["x"] for r in df.select("id", review.noisy_trigger(F.col("t")).alias("x")).orderBy("id").collect()] == [False, True, True, False, True]
