"""Near-copy removal with repeated and null ids: only rows whose own sets are linked go, and each group keeps one row."""

from kiln.llm import jaccard_join


def text(word: str, changed: int = 0) -> str:
    return " ".join(f"{word}{i}" for i in range(60)) + (" end" if changed else "")


def test_one_row_of_each_group_stays(spark):
    rows = [
        (1, text("a"), "kept"),
        (5, text("a", 1), "near copy of 1"),
        (5, text("b"), "kept"),  # repeats an id, is linked with nothing
        (6, text("b", 1), "near copy of 5"),
        (7, text("c"), "one of two"),
        (7, text("c"), "one of two"),
        (None, text("a"), "copy of 1 without an id"),
        (None, text("d"), "one of three"),
        (None, text("d"), "one of three"),
        (None, text("d", 1), "one of three"),
        (None, text("e"), "kept"),
        (8, "", "kept"),
        (8, " ", "kept"),
        (None, None, "kept"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    want = ["kept"] * 6 + ["one of three", "one of two"]
    first = jaccard_join.one_of_each(df).collect()
    assert sorted(r.note for r in first) == want
    again = jaccard_join.one_of_each(df.repartition(5, "note")).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
