"""Joins of a document's two sides: pages, lines by rank, blocks by overlap, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.geometry import common_area, overlap, overlap_score, rect

LEAST_SCORE = 0.12


def page_counts(bs: DataFrame) -> DataFrame:
    """doc_id, orig_pages, trans_pages; a side without pages has 0."""
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("page"))), F.lit(0)).alias(f"{s}_pages")
    return bs.groupBy("doc_id").agg(side("orig"), side("trans"))


def page_pairs(bs: DataFrame) -> DataFrame:
    """doc_id, page of the pages of documents whose sides have equally many pages."""
    same = page_counts(bs).where("orig_pages = trans_pages").select("doc_id", F.explode(F.sequence(F.lit(1), "orig_pages")).alias("page"))
    return same


def line_pairs(ls: DataFrame) -> DataFrame:
    """Lines of both sides paired by their rank on the page: doc_id, page, rank, orig_n, trans_n."""
    w = Window.partitionBy("doc_id", "page", "side").orderBy("i", "line_id")
    r = ls.select("doc_id", "page", "side", "n", F.row_number().over(w).alias("rank"))
    o = r.where("side = 'orig'").select("doc_id", "page", "rank", F.col("n").alias("orig_n"))
    t = r.where("side = 'trans'").select("doc_id", "page", "rank", F.col("n").alias("trans_n"))
    return o.join(t, ["doc_id", "page", "rank"])


def _sides(bs: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = ["doc_id", "page", "block_id", "block_no", "text", "n", "dominant_font", "dominant_color", "x0", "y0", "x1", "y1"]
    o = bs.where("side = 'orig'").select("doc_id", "page", *[F.col(c).alias(f"o_{c}") for c in keep[2:]])
    t = bs.where("side = 'trans'").select("doc_id", "page", *[F.col(c).alias(f"t_{c}") for c in keep[2:]])
    return o, t


def best_overlap(bs: DataFrame) -> DataFrame:
    """Each `orig` block with the `trans` block of its page that it overlaps most, if by LEAST_SCORE at least.

    Of equal scores the block that stands first is taken; a `trans` block may serve several. The join is an equi join
    on document and page, and the best is a maximum, so no sort by page is needed.
    """
    o, t = _sides(bs)
    j = o.join(t, ["doc_id", "page"]).where(common_area(rect("o_"), rect("t_")) > 0)
    best = F.max(F.struct(overlap_score(rect("o_"), rect("t_")).alias("score"), (-F.col("t_block_no")).alias("a"), (-F.col("t_block_id")).alias("b"), "t_text", "t_dominant_font", "t_dominant_color")).alias("m")
    top = j.groupBy("doc_id", "page", "o_block_id", "o_block_no", "o_text", "o_dominant_font", "o_dominant_color").agg(best)
    return top.where(F.col("m.score") >= LEAST_SCORE).select(
        "doc_id", "page", "o_block_id", "o_block_no", "o_text", "o_dominant_font", "o_dominant_color",
        (-F.col("m.b")).alias("t_block_id"), "m.t_text", "m.t_dominant_font", "m.t_dominant_color", "m.score",
    )


def overlap_pairs(bs: DataFrame) -> DataFrame:
    """doc_id, side, page, pairs: how many pairs of a page's blocks overlap; pages without any are left out."""
    cols = ["doc_id", "side", "page"]
    a = bs.select(*cols, "block_no", "block_id", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = bs.select(*cols, F.col("block_no").alias("other_no"), F.col("block_id").alias("other_id"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    first = F.struct("block_no", "block_id") < F.struct("other_no", "other_id")
    return a.join(b, cols).where(first & overlap(rect("a_"), rect("b_"))).groupBy(*cols).agg(F.count("*").alias("pairs"))


def over_images(bs: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks that overlap an image of their page (left semi join). images: doc_id, side, page, x0, y0, x1, y1."""
    cols = ["doc_id", "side", "page"]
    im = images.select(*[F.col(c).alias(f"i_{c}") for c in (*cols, "x0", "y0", "x1", "y1")])
    on = [F.col(c) == F.col(f"i_{c}") for c in cols]
    b = bs.select(*cols, "block_id", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    cond = on[0] & on[1] & on[2] & overlap(rect("b_"), rect("i_"))
    return b.join(im, cond, "left_semi").select(*cols, "block_id")


def table_cells(bs: DataFrame, row: int = 5, gap: int = 30, wide: int = 3, least: int = 6) -> DataFrame:
    """Blocks that belong to tables, with the table's number: rows of `wide` blocks, rows nearer than `gap` in one table.

    A page needs four blocks and two such rows; a table needs `least` cells.
    """
    cols = ["doc_id", "side", "page"]
    b = bs.withColumn("y", (F.rint(F.col("y0") / row) * row).cast("int"))
    rows = b.groupBy(*cols, "y").agg(F.count("*").alias("m")).where(F.col("m") >= wide)
    w = Window.partitionBy(*cols).orderBy("y")
    rows = rows.withColumn("new", F.when(F.col("y") - F.lag("y").over(w) < gap, 0).otherwise(1)).withColumn("table_no", F.sum("new").over(w))
    all_rows = Window.partitionBy(*cols)
    rows = rows.withColumn("rows", F.count("*").over(all_rows)).withColumn("cells", F.sum("m").over(Window.partitionBy(*cols, "table_no")))
    return b.join(rows.where((F.col("rows") >= 2) & (F.col("cells") >= least)).select(*cols, "y", "table_no"), [*cols, "y"])


def table_matches(bs: DataFrame, **kw) -> DataFrame:
    """Each `orig` table with the `trans` table of its page with which most cells overlap: cells of both and matched cells."""
    c = table_cells(bs, **kw)
    o = c.where("side = 'orig'").select("doc_id", "page", F.col("table_no").alias("ot"), *[F.col(x).alias(f"o_{x}") for x in ("block_id", "x0", "y0", "x1", "y1")])
    t = c.where("side = 'trans'").select("doc_id", "page", F.col("table_no").alias("tt"), *[F.col(x).alias(f"t_{x}") for x in ("block_id", "x0", "y0", "x1", "y1")])
    hits = o.join(t, ["doc_id", "page"]).where(overlap(rect("o_"), rect("t_"))).groupBy("doc_id", "page", "ot", "tt").agg(F.count("*").alias("hits"))
    best = hits.groupBy("doc_id", "page", "ot").agg(F.max(F.struct("hits", (-F.col("tt")).alias("k"))).alias("m"))
    size = lambda df, k, out: df.groupBy("doc_id", "page", k).agg(F.count("*").alias(out))
    best = best.select("doc_id", "page", "ot", (-F.col("m.k")).alias("tt"), "m.hits")
    return best.join(size(o, "ot", "orig_cells"), ["doc_id", "page", "ot"]).join(size(t, "tt", "trans_cells"), ["doc_id", "page", "tt"])
