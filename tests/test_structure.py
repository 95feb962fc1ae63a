from pyspark.sql import functions as F

from attestry.functions import markdown as md
from attestry.functions import text as tx


def sections(spark, text, title="T"):
    df = spark.createDataFrame([(text, title)], "t string, ti string")
    return df.select(md.sections_of(F.col("t"), F.col("ti")).alias("s")).first().s


def chunks(spark, text, size=500, overlap=100):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(md.chunks_of(F.col("t"), size, overlap).alias("c")).first().c


def test_text_before_first_heading_is_a_section_of_the_title(spark):
    rows = sections(spark, "intro\n# A\n\ntext\n## B\nmore")
    assert [(r.section_title, r.heading_path, r.source_start_line, r.source_end_line) for r in rows] == [
        ("T", "T", 1, 1), ("A", "A", 2, 4), ("B", "A > B", 5, 6),
    ]
    assert [r.parent_no for r in rows] == [None, None, 2]


def test_second_level_first_heading_nests_under_title(spark):
    assert [r.heading_path for r in sections(spark, "## B\nx")] == ["T > B"]


def test_heading_without_body_is_lost_but_stays_in_the_path(spark):
    rows = sections(spark, "# A\n## B\nx\n## C\n## D\ny")
    assert [(r.section_title, r.heading_path) for r in rows] == [("B", "A > B"), ("D", "A > D")]
    assert [r.parent_no for r in rows] == [None, None]


def test_blank_body_of_first_heading_becomes_its_title(spark):
    assert [(r.section_title, r.content) for r in sections(spark, "# A\n\n# B\nq")] == [("A", "A"), ("B", "q")]


def test_empty_text_gives_one_section(spark):
    rows = sections(spark, "")
    assert [(r.section_title, r.content, r.source_end_line) for r in rows] == [("T", "T", 1)]


def test_headings_inside_fences_still_cut(spark):
    assert [r.section_title for r in sections(spark, "a\n```\n# x\ny\n```")] == ["T", "x"]


def test_table_fence_and_quote_stay_whole(spark):
    table = "\n".join("| a | b |" for _ in range(80))
    fence = "```\n" + "code\n\n" * 120 + "```"
    quote = "\n".join("> words" for _ in range(90))
    assert chunks(spark, f"{table}\n\n{fence}\n\n{quote}") == [table, fence, quote]


def test_long_paragraph_is_cut_with_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(1301))
    got = chunks(spark, text)
    assert got == [text[0:500], text[400:900], text[800:1300], text[1200:1301]]


def test_windows_equal_the_step_by_step_cut(spark):
    for n in (0, 1, 9, 10, 11, 17, 18, 19, 100, 3001):
        text = "".join(chr(97 + i % 26) for i in range(n))
        want, start = [], 0
        while start < n:
            want.append(text[start : start + 10])
            if start + 10 >= n:
                break
            start += 7
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(md.windows_of(F.col("t"), 10, 3, group=4).alias("w")).first().w == want


def test_short_blocks_are_packed(spark):
    assert chunks(spark, "one\n\ntwo\n\n" + "x" * 495 + "\n\nthree") == ["one\n\ntwo", "x" * 495, "three"]


def test_scan_is_the_same_over_block_borders(spark):
    df = spark.range(1).select(
        tx.scan(
            F.sequence(F.lit(1), F.lit(1000)), F.lit(0).cast("bigint"), "bigint", "bigint",
            lambda st, x: (st + x, F.array(st + x)), block=7,
        ).alias("s")
    )
    total, want = 0, []
    for n in range(1, 1001):
        total += n
        want.append(total)
    assert df.first().s == want


def test_lines_drop_one_trailing_empty(spark):
    df = spark.createDataFrame([("a\r\nb c\n",), ("",), ("\n",)], "t string")
    assert [r.l for r in df.select(tx.lines_of("t").alias("l")).collect()] == [["a", "b", "c"], [], [""]]
