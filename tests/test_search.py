from conftest import rows
from pyspark.sql import functions as F

import tablelens as tl

TEXTS = [
    (1, "one\r\nTwo two\rthree\nfour"),
    (2, "\n\ntwo\n"),
    (3, ""),
    (4, None),
    (5, "\n\n\n\nlate two"),
]


def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, t string")


def test_like_any_null_column_does_not_hinder(spark):
    df = spark.createDataFrame([(1, None, "ab"), (2, "ab", None), (3, None, None)], "id int, a string, b string")
    assert rows(tl.like_any(df, ["a", "b"], "A_", False).select("id")) == [(1,), (2,)]
    assert rows(tl.like_any(df, ["a", "b"], "ab", True).select("id")) == [(1,), (2,)]


def test_grep_lines(spark):
    assert rows(tl.grep_lines(texts(spark), "id", "t", "two")) == [
        (1, 2, "Two two"),
        (2, 3, "two"),
        (5, 5, "late two"),
    ]
    assert rows(tl.grep_lines(texts(spark), "id", "t", "Two", case_sensitive=True)) == [
        (1, 2, "Two two")
    ]
    # A match has to lie inside one line.
    assert rows(tl.grep_lines(texts(spark), "id", "t", "one%three")) == []


def test_literal_grep_equals_in(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = tl.grep_lines(docs, "doc_id", "text", "the", case_sensitive=True)
    expected = [
        (d.doc_id, i, line)
        for d in docs.collect()
        for i, line in enumerate(d.text.split("\n"), 1)
        if "the" in line
    ]
    assert rows(found) == sorted(expected, key=repr)


def test_line_counts(spark):
    assert rows(tl.line_counts(texts(spark), "id", "t")) == [(1, 3), (2, 3), (3, 0), (4, None), (5, 4)]


def test_search_union_schema(spark):
    df = texts(spark).withColumn("n", F.lit(7))
    out = tl.search_union(
        [
            tl.Source("lines", df, "id", "t", by_line=True),
            tl.Source("rows", df, "id", "t", "n", pattern="late"),
        ],
        "one",
    )
    assert out.columns == ["src", "parent_id", "item_no", "snippet"]
    assert rows(out) == [("lines", 1, 1, "one"), ("rows", 5, 7, "\n\n\n\nlate two")]


def test_containers(spark):
    hits = spark.createDataFrame([(1, 10), (1, 11), (2, None), (2, 20), (3, None)], "p int, c int")
    assert rows(tl.add_containers(hits, "c", "p")) == [
        ("container", 1, None),
        ("container", 2, None),
        ("container", 3, None),
        ("item", 1, 10),
        ("item", 1, 11),
        ("item", 2, 20),
    ]


def test_outline(spark, either):
    hits = spark.createDataFrame(
        [("g", "a", 3, "x", 1200), ("g", "a", 5, "y", 1200), ("g", "a", 9, "z", 1200), ("g", "b", 1, "w", None), ("h", "c", 2, "v", 0)],
        "g string, i string, n int, t string, lines int",
    )
    out = tl.search_outline(hits, "g", "i", "n", show=["t"], line_count="lines", sort=True)
    assert [tuple(r) for r in out.collect()] == [
        ("g", 0, 0, "", "", None, None),
        ("g", 1, 0, "g.a", "1,200 lines", None, None),
        ("g", 1, 1, "/", "", 3, "x"),
        ("g", 1, 2, "|", "", 5, "y"),
        ("g", 1, 3, "\\", "", 9, "z"),
        ("g", 2, 0, "g.b", "", None, None),
        ("g", 2, 1, "\\", "", 1, "w"),
        ("h", 0, 0, "", "", None, None),
        ("h", 1, 0, "h.c", "0 lines", None, None),
        ("h", 1, 1, "\\", "", 2, "v"),
    ]


def test_outline_keeps_hits_without_group_or_item(spark, either):
    hits = spark.createDataFrame(
        [(None, "a", n) for n in range(1, 6)] + [("g", None, 1)],
        "g string, i string, n int",
    )
    out = tl.search_outline(hits, "g", "i", "n")
    assert rows(out.groupBy("g", "item_no").count()) == [
        ("g", 0, 1),
        ("g", 1, 2),
        (None, 0, 1),
        (None, 1, 6),
    ]


def test_outline_prefers_lines_to_rows(spark):
    hits = spark.createDataFrame([("g", "a", 1, None, 5), ("g", "b", 1, 2, 5)], "g string, i string, n int, l int, r int")
    out = tl.search_outline(hits, "g", "i", "n", line_count="l", row_count="r")
    assert rows(out.where("item_no > 0 and detail_no = 0").select("mark", "size_label")) == [
        ("g.a", "5 rows"),
        ("g.b", "2 lines"),
    ]


def test_preview(spark):
    assert rows(tl.text_preview(texts(spark), "id", "t", max_lines=3)) == [
        (1, 1, "one", True),
        (1, 2, "Two two", True),
        (1, 3, "three", True),
        (2, 3, "two", False),
    ]
    assert rows(tl.text_preview(texts(spark), "id", "t", max_lines=5).where("id = 5")) == [
        (5, 5, "late two", False)
    ]
    blanks = spark.createDataFrame([(1, "a\n\n\n\n"), (2, "a\n\n\nb")], "id int, t string")
    assert rows(tl.text_preview(blanks, "id", "t", max_lines=2)) == [
        (1, 1, "a", False),
        (1, 2, "", False),
        (2, 1, "a", True),
        (2, 2, "", True),
    ]


def test_sections(spark):
    df = spark.createDataFrame(
        [
            (1, "NAME:  a\r\n   b \r\n\r\nUSE: c\n\nd"),
            (2, "USE:\tlast  one"),
            (3, "none"),
            (4, None),
        ],
        "id int, t string",
    )
    assert rows(tl.header_sections(df, "id", "t", ["NAME", "USE"])) == [
        (1, "a b", "c"),
        (2, None, "last one"),
        (3, None, None),
        (4, None, None),
    ]


def test_grep_of_a_stream(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet")
    found = tl.grep_lines(stream.parquet(folder), "doc_id", "text", "licen[sc]e")
    query = found.writeStream.format("memory").queryName("grepped").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.table("grepped")) == rows(tl.grep_lines(docs, "doc_id", "text", "licen[sc]e"))


def test_no_pattern_matches_nothing_and_spaces_are_blank(spark):
    df = spark.createDataFrame([(1, "   \nfirst\n  \n  ")], "id long, text string")
    assert tl.like_any(df, ["text"], []).collect() == []
    assert [tuple(r) for r in tl.text_preview(df, "id", "text", 2).collect()] == [(1, 2, "first", False)]
