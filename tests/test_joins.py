"""Joins that must look at whole texts."""

from factloom.operators import joins
from factloom.plans import relations


def test_windows_at_any_place(spark, monkeypatch):
    monkeypatch.setattr(joins, "_STEP", 64)  # shorter than the texts, so that windows cross the ends of steps
    a, b = "å" * 20 + "blå fjord, kald vind", "0123456789" * 4
    texts = ["x" * n + a + "y" * (200 - n) for n in range(0, 190, 7)] + ["z" * 3000 + b, b + b, "kort", "", None, "😀" * 100 + "ø" * 40]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    gold = spark.createDataFrame([(a,), (b,), (b,), ("ø" * 40,), ("q" * 40,), ("kort",), (None,)], "head string")
    got = sorted(r.head for r in joins.windows_among(docs, "text", gold, "head", 40).collect())
    assert got == sorted([a] * 28 + [b] * 2 + ["ø" * 40])


def test_gold_heads_behind_the_first_400_places(spark, tmp_path):
    item = "The heron waits in the reeds until the tide turns back."
    spark.createDataFrame([(1, "word " * 500 + item)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "Nothing of this sentence stands in any of the documents.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.item_id for r in relations.q_gold_match(spark, str(tmp_path)).collect()] == [1]
    assert [r.item_id for r in relations.q_gold_missing(spark, str(tmp_path)).collect()] == [2]
