"""Text, geometry and font expressions against values worked out by hand."""

from pyspark.sql import functions as F

from folioscope.functions import fonts, text
from folioscope.functions.geometry import overlap, overlap_score, rect, similar_colors
from folioscope.operators import batching


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]) if values else spark.range(1)
    return df.select(col.alias("r")).first()["r"]


def many(spark, f, xs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"k int, x {kind}")
    return [r["r"] for r in df.select("k", f(F.col("x")).alias("r")).orderBy("k").collect()]


def test_collapse(spark):
    assert many(spark, text.collapse, ["  a  \t b ", "", None, "\x1c"]) == ["a b", "", None, ""]


def test_should_translate(spark):
    xs = ["", None, "12 - 3", "a", "a1!", "ab", "Привет", "  x  y ", "..."]
    assert many(spark, text.should_translate, xs) == [False, False, False, False, True, True, False, True, False]
    assert many(spark, lambda x: text.should_translate(x, unicode_letters=True), ["Привет"]) == [True]


def test_glyphs(spark):
    xs = [None, "", "�□", "ab ???", "a ?? b", "what??? ok then??", "? ? ? abcdefgh"]
    assert many(spark, text.suspicious_glyphs, xs) == [0, 0, 2, 3, 0, 8, 3]


def test_english(spark):
    xs = ["the cat", "the of and to", "the cat sat down", "a b c d e f g h", None]
    assert many(spark, text.likely_english, xs) == [False, True, False, False, False]


def test_unchanged(spark):
    df = spark.createDataFrame([("one two three four", "One two three four"), ("short text", "short text"), ("one two  three four", "one two three four"), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(text.unchanged(F.col("a"), F.col("b")), text.unchanged(F.col("a"), F.col("b"), True)).collect()] == [(False, True), (False, False), (True, True), (False, False)]


def test_clean_reply(spark):
    assert many(spark, text.clean_reply, ["```json\nab\n```", '"quoted"', "**b** __c__", "''", None]) == ["ab", "quoted", "b c", "''", ""]


def test_parsed_reply(spark):
    df = spark.createDataFrame([("[1] a\n[2] b", 2), ("[2] b [1] a", 2), ("[1] a [1] c [2] b", 2), ("x\ny", 2), ("[1] a", 2), ("[1] a\n[3] b", 2)], "x string, n int")
    got = [r["r"] for r in df.select(text.parsed_reply(F.col("x"), F.col("n")).alias("r")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["c", "b"], ["x", "y"], None, ["a", "b"]]


def test_names(spark):
    assert many(spark, text.safe_name, ['a<b>:"/\\|?*c ', "x" * 300]) == ["abc", "x" * 200]
    assert many(spark, text.dashed_title, ["A-B – C"]) == ["A - B - C"]
    assert many(spark, lambda x: text.marked(x, text.QUEUE_MARKS), ["Livro_PT-BR", "book", None]) == [True, False, False]


def test_durations_beyond_32_bits(spark):
    assert many(spark, text.duration, [15436493575.69, 2147483648.0], "double") == ["4287914h52m", "596523h14m"]


def test_duration(spark):
    assert many(spark, text.duration, [0.0, 59.9, 184.0, 3725.0, -5.0, None], "double") == ["0m00s", "0m59s", "3m04s", "1h02m", "0m00s", "--"]


def test_rewrap(spark):
    df = spark.createDataFrame([("aa bb cc dd", [5, 5]), ("aa bb cc dd ee ff", [4, 4]), ("", [4, 4]), ("one", [9, 9, 9])], "t string, b array<int>")
    n = F.size("b")
    got = [tuple(r) for r in df.select(text.rewrapped(F.col("t"), F.col("b"), n, 1.0, True), text.rewrapped(F.col("t"), F.col("b"), n, 1.0, False)).collect()]
    assert got == [("aa bb\ncc dd", "aa bb\ncc dd"), ("aa\nbb cc dd ee ff", "aa\nbb cc dd ee ff"), ("", ""), ("one\n\n", "one")]


def test_rects(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 8.0, 0.0, 18.0, 10.0), (0.0, 0.0, 10.0, 10.0, 7.9, 0.0, 17.9, 10.0), (0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0), (0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 5.0, 5.0)],
                               "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    got = [r["r"] for r in df.select(overlap(rect("a"), rect("b")).alias("r")).collect()]
    assert got == [False, True, False, False]  # a fifth exactly isn't enough; touching and empty ones don't overlap
    assert df.select(overlap_score(rect("a"), rect("b")).alias("r")).first()["r"] == 0.2


def test_colors(spark):
    df = spark.createDataFrame([(0, 0x1E1E1E), (0, 0x1F0000), (None, 0)], "a int, b int")
    assert [r["r"] for r in df.select(similar_colors(F.col("a"), F.col("b")).alias("r")).collect()] == [True, False, True]


def test_fonts(spark):
    names = ["Symbol Mono", "CourierNew", "sans-serif", "Arial", None, ""]
    assert many(spark, fonts.font_class, names) == ["symbol", "mono", "serif", "sans", "sans", "sans"]
    assert many(spark, lambda x: fonts.stand_in(x, F.lit(2)), ["Times Bold", "Arial"]) == ["tibi", "heit"]


def test_greedy_batches(spark):
    df = spark.createDataFrame([([5, 5, 5],), ([50, 1, 1],), ([0, None, 3],), ([],)], "x array<int>")
    got = [r["r"] for r in df.select(batching.greedy_batches(F.col("x"), 2, 10).alias("r")).collect()]
    assert got == [[1, 1, 2], [1, 2, 2], [1, 1, 2], []]


def test_line_heights(spark):
    df = spark.createDataFrame([(1.2,), (1.9,), (0.75,)], "r double")
    got = [r["x"] for r in df.select(F.size(batching.line_heights(F.col("r"), "hybrid")).alias("x")).collect()]
    assert got == [7, 4, 1]  # 1.6 four times, then 1.596, 1.52, 1.444
