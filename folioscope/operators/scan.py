"""Lines, blocks and spans as flat tables; histograms and dominant styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.geometry import common_area, rect
from folioscope.functions.text import collapse, should_translate, stripped, table_like
from folioscope.sources.tables import once_by_id

PAGE = ["doc_id", "page"]


def lines(line_entry: DataFrame) -> DataFrame:
    """Lines with collapsed text, re-delivered rows once; empty texts and boxes without area are left out."""
    cols = ["line_id", "side", "doc_id", "page", "block_no", "i", "text", "x0", "y0", "x1", "y1"]
    once = once_by_id(line_entry.select(*cols), "line_id").withColumn("text", collapse(F.col("text")))
    return once.where("text <> '' and x1 > x0 and y1 > y0").withColumn("n", F.length("text").cast("long"))


def blocks(text_block: DataFrame) -> DataFrame:
    """Blocks with trimmed text, re-delivered rows once, empty ones left out; a null char_count is the text's length."""
    cols = ["block_id", "side", "doc_id", "page", "block_no", "text", "char_count", "avg_size", "dominant_font", "dominant_color", "x0", "y0", "x1", "y1"]
    once = once_by_id(text_block.select(*cols), "block_id").withColumn("text", F.trim("text")).where("text <> ''")
    return once.withColumn("n", F.coalesce("char_count", F.length("text")).cast("long"))


def blocks_of_lines(ls: DataFrame) -> DataFrame:
    """One row per block of lines: its text (lines joined by a blank in order), line lengths, box, table-likeness."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "line_id", "text"))), lambda x: x["text"])
    return (
        ls.groupBy("doc_id", "side", "page", "block_no")
        .agg(ordered.alias("texts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg(F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))).alias("line_height"))
        .withColumn("text", F.array_join("texts", " "))
        .withColumn("table_like", table_like(F.col("texts")))
    )


def histogram(sp: DataFrame, key: str) -> DataFrame:
    """Characters of each block by the value of `key`; null values are a value of their own."""
    return sp.groupBy("doc_id", "side", "page", "block_no", key).agg(F.sum("n").alias("chars"))


def dominant_style(sp: DataFrame) -> DataFrame:
    """The style (font, size, color, flags) with the most characters of each block; of equals the first seen."""
    by = sp.groupBy("doc_id", "side", "page", "block_no", "font", F.bround("size", 1).alias("size"), "color", "flags").agg(
        F.sum("n").alias("chars"), F.min(F.struct("i", "line_id", "span_no")).alias("first")
    )
    best = F.min(F.struct((-F.col("chars")).alias("less"), "first", "font", "size", "color", "flags")).alias("b")
    return by.groupBy("doc_id", "side", "page", "block_no").agg(best).select("doc_id", "side", "page", "block_no", "b.font", "b.size", "b.color", "b.flags", (-F.col("b.less")).alias("chars"))


def block_sizes(sp: DataFrame) -> DataFrame:
    """Mean of span sizes per block, unweighted."""
    return sp.groupBy("doc_id", "side", "page", "block_no").agg(F.avg("size").alias("avg_size"))


def scanned_pages(bs: DataFrame, least: int = 30) -> DataFrame:
    """Pages with fewer than `least` characters besides blanks, tabs and line ends."""
    chars = F.sum(F.length(F.translate("text", " \n\t", ""))).alias("chars")
    return bs.groupBy("doc_id", "side", "page").agg(chars).select("doc_id", "side", "page", "chars", (F.col("chars") < least).alias("scanned"))


def as_box(points):
    """(x0, y0, x1, y1) columns of an array of struct(x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ocr_entries(results: DataFrame) -> DataFrame:
    """Entries to draw: text changed by translation, box of 5 by 5 at least, its line count.

    results: entry_id, points (array of struct(x, y)), original, translated.
    """
    x0, y0, x1, y1 = as_box(F.col("points"))
    t = stripped(F.coalesce("translated", F.lit("")))
    e = results.select("entry_id", "original", t.alias("translated"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    e = e.where((t != "") & (t != stripped(F.coalesce("original", F.lit("")))) & (F.col("x1") - F.col("x0") >= 5) & (F.col("y1") - F.col("y0") >= 5))
    return e.withColumn("source_line_count", F.greatest(F.lit(1), F.size(F.filter(F.split("original", "\n"), lambda x: stripped(x) != ""))).cast("long"))


def line_height_ratio(bs: DataFrame, size: str = "size") -> DataFrame:
    """Mean line height over font size within 1.0 and 1.9; the block's height by its lines where no line height is known, else 1.2."""
    within = lambda x: F.greatest(F.lit(1.0), F.least(F.lit(1.9), x))
    n = F.size("texts")
    r = F.when((F.col(size) > 0) & F.col("line_height").isNotNull(), within(F.col("line_height") / F.col(size)))
    r = r.when((F.col(size) > 0) & (n > 0) & F.col("y0").isNotNull(), within((F.col("y1") - F.col("y0")) / n / F.col(size))).otherwise(1.2)
    return bs.withColumn("ratio", r)


def detailed_blocks(sp: DataFrame) -> DataFrame:
    """Blocks of spans with histograms of characters by font, colour and flags (maps), their dominant values and mean size.

    Blank spans count nowhere; of equally frequent values the first seen dominates; nulls count as '' or 0. The key
    columns may be null.
    """
    cols = ["doc_id", "side", "page", "block_no"]
    s = sp.where(F.trim("text") != "").withColumn("at", F.struct("i", "line_id", "span_no"))
    kinds = {"fonts": F.coalesce("font", F.lit("")), "colors": F.coalesce("color", F.lit(0)).cast("string"), "flags": F.coalesce("flags", F.lit(0)).cast("string")}
    each = s.select(*cols, "at", "size", F.length(F.trim("text")).alias("n"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("x"))
    by = each.groupBy(*cols, "x.kind", "x.value").agg(F.sum("n").cast("long").alias("n"), F.min("at").alias("first"), F.sum("size").alias("sizes"), F.count("size").alias("many"))
    mine = lambda k, v: F.when(F.col("kind") == k, v)
    top = lambda k: F.min(mine(k, F.struct((-F.col("n")).alias("less"), "first", "value")))["value"]
    maps = [F.map_from_entries(F.array_sort(F.collect_list(mine(k, F.struct("value", "n"))))).alias(k) for k in kinds]
    return by.groupBy(*cols).agg(
        *maps, top("fonts").alias("dominant_font"), top("colors").cast("int").alias("dominant_color"), top("flags").cast("int").alias("dominant_flags"),
        (F.sum(mine("fonts", F.col("sizes"))) / F.sum(mine("fonts", F.col("many")))).alias("avg_size"),
    )


def image_rects(images: DataFrame) -> DataFrame:
    """doc_id, side, page, x0, y0, x1, y1 of every image place once; places without a box or area are left out."""
    cols = ["doc_id", "side", "page", "x0", "y0", "x1", "y1"]
    return images.select(*cols).where("x1 > x0 and y1 > y0").distinct()


def request_rows(ls: DataFrame, wide: float = 5, high: float = 3) -> DataFrame:
    """Texts to ask a translation for: the lines of table-like blocks one by one, other blocks whole.

    Rows narrower than `wide` or lower than `high` are left out. Columns: doc_id, side, page, block_no, i (null for
    whole blocks), text, line_count, line_lengths, table_like and the box.
    """
    key = ["doc_id", "side", "page", "block_no"]
    bs = blocks_of_lines(ls)
    box = ["x0", "y0", "x1", "y1"]
    whole = bs.where("not table_like").select(*key, F.lit(None).cast("int").alias("i"), "text", F.size("texts").alias("line_count"), F.transform("texts", lambda x: F.length(x)).alias("line_lengths"), "table_like", *box)
    tables = bs.where("table_like").select(*[F.col(c).alias(f"b_{c}") for c in key])
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    single = ls.join(tables, on, "left_semi").select(*key, "i", "text", F.lit(1).alias("line_count"), F.array(F.length("text")).alias("line_lengths"), F.lit(True).alias("table_like"), *box)
    return whole.unionByName(single).where((F.col("x1") - F.col("x0") >= wide) & (F.col("y1") - F.col("y0") >= high))


def over_any_image(rows: DataFrame, images: DataFrame, row_id: list[str]) -> DataFrame:
    """rows with over_image: whether the box has any area in common with an image of its page."""
    cols = ["doc_id", "side", "page"]
    im = images.select(*cols, *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")])
    r = rows.select(*cols, *[c for c in row_id if c not in cols], *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    hits = r.join(im, cols).where(common_area(rect("r_"), rect("i_")) > 0).select(*{*cols, *row_id}).distinct().withColumn("hit", F.lit(True))
    on = F.lit(True)
    hits = hits.withColumnsRenamed({c: f"h_{c}" for c in {*cols, *row_id}})
    for c in {*cols, *row_id}:
        on = on & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    return rows.join(hits, on, "left").withColumn("over_image", F.coalesce("hit", F.lit(False))).drop("hit", *[f"h_{c}" for c in {*cols, *row_id}])


def recognised_texts(results: DataFrame) -> DataFrame:
    """Recognition results worth translating: they have a place (points, two at least) and a translatable text."""
    return results.where((F.size("points") >= 2) & should_translate(F.col("text")))


def joined_text(lines_of_spans, trimmed: bool):
    """Text of a block from an array of lines, each an array of span texts: lines trimmed and empty ones skipped, or joined as they are."""
    raw = F.transform(lines_of_spans, lambda line: F.array_join(line, ""))
    if trimmed:
        return F.array_join(F.filter(F.transform(raw, stripped), lambda x: x != ""), " ")
    return stripped(F.array_join(raw, " "))
