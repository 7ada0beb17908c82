"""Quality rules of page pairs and their rollup to documents.

Every rule is a column of one page row; the three methods differ in the rules they use. Comparisons use unrounded
values. Pages without blocks or lines on a side count as 0 there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.fonts import font_class
from folioscope.functions.geometry import similar_colors
from folioscope.functions.text import likely_english, stripped, suspicious_glyphs, unchanged, words
from folioscope.operators.pairing import best_overlap, line_pairs, over_images, overlap_pairs, page_counts, page_pairs, table_cells, table_matches

METHODS = {
    "structural": ("block_count_low", "font_too_small", "overlapping", "empty_blocks", "unchanged_high", "corrupted"),
    "char_count": ("char_ratio_bad", "line_ratio_bad_45", "empty_lines", "unchanged_high", "corrupted"),
    "hybrid": (
        "block_count_low", "line_count_mismatch", "line_ratio_bad_40", "untranslated_high", "font_mismatch", "color_mismatch", "over_image_excess",
        "font_too_small", "overlapping", "table_missing", "table_content_low", "char_count_low", "empty_blocks", "unchanged_high", "corrupted",
    ),
}
RULES = sorted({r for rules in METHODS.values() for r in rules})


def _by_side(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """doc_id, page, orig_<name>, trans_<name> by conditional aggregation: one shuffle for both sides."""
    return df.groupBy("doc_id", "page").agg(*[agg(s).alias(f"{s}_{name}") for name, agg in aggs.items() for s in ("orig", "trans")])


def page_stats(bs: DataFrame, ls: DataFrame, images: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per page pair of documents with equally many pages (or of `pages`), with the sums that the rules compare."""
    of = lambda c: lambda s: F.sum(F.when(F.col("side") == s, F.col(c)))
    one = lambda s: F.count(F.when(F.col("side") == s, 1))
    eng = lambda s: F.count(F.when((F.col("side") == s) & likely_english(F.col("text")), 1))
    four = lambda s: F.count(F.when((F.col("side") == s) & (F.size(words(F.col("text"))) >= 4), 1))
    size = lambda s: F.avg(F.when(F.col("side") == s, F.col("avg_size")))
    b = _by_side(bs, {"blocks": one, "block_chars": of("n"), "size": size, "english": eng, "worded": four})
    li = _by_side(ls, {"lines": one, "chars": of("n")})
    base = F.greatest("orig_n", F.lit(1))
    ratio = F.col("trans_n") / base
    lp = line_pairs(ls).groupBy("doc_id", "page").agg(F.count("*").alias("line_pairs"), F.count(F.when((ratio < 0.2) | (ratio > 4.0), 1)).alias("bad_lines"))
    m = best_overlap(bs)
    long = F.length("o_text") >= 8
    q = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("?"), F.lit("")))
    g = suspicious_glyphs(F.col("t_text"))
    fc = font_class(F.col("o_dominant_font"))
    mm = m.groupBy("doc_id", "page").agg(
        F.count(F.when(long, 1)).alias("quality_matched"),
        F.count(F.when(long & unchanged(F.col("o_text"), F.col("t_text"), True), 1)).alias("unchanged"),
        F.count(F.when(long & (g > 0), 1)).alias("corrupted_blocks"),
        F.sum(F.when(long, F.greatest(q("t_text") - q("o_text"), F.lit(0))).otherwise(0)).alias("extra_marks"),
        F.sum(F.when(long, g).otherwise(0)).alias("glyphs"),
        F.count("*").alias("matched"),
        F.count(F.when((fc != font_class(F.col("t_dominant_font"))) & (fc != "symbol"), 1)).alias("font_off"),
        F.count(F.when(~similar_colors(F.col("o_dominant_color"), F.col("t_dominant_color")), 1)).alias("color_off"),
    )
    ov = overlap_pairs(bs).where("side = 'trans'").select("doc_id", "page", "pairs")
    oi = _by_side(over_images(bs, images), {"over_image": one})
    tc = _by_side(table_cells(bs).select("doc_id", "page", "side", "table_no").distinct(), {"tables": one})
    tm = table_matches(bs).groupBy("doc_id", "page").agg(F.count(F.when(F.col("trans_cells") < F.col("orig_cells") * 0.5, 1)).alias("tables_low"))
    out = page_pairs(bs.select("doc_id", "side", "page")) if pages is None else pages
    for part in (b, li, lp, mm, ov, oi, tc, tm):
        out = out.join(part, ["doc_id", "page"], "left")
    counts = [c for c, t in out.dtypes if c not in ("doc_id", "page", "orig_size", "trans_size")]
    return out.fillna(0, counts)


def rules(stats: DataFrame) -> DataFrame:
    """doc_id, page and one boolean per rule of RULES."""
    c = F.col
    some = lambda n, d, limit: (c(d) > 0) & (c(n) > c(d) * limit)
    size_ratio = F.when(c("orig_size") > 0, c("trans_size") / c("orig_size")).otherwise(1.0)
    cond = {
        "block_count_low": (c("orig_blocks") > 0) & (c("trans_blocks") < c("orig_blocks") * 0.5),
        "font_too_small": (c("orig_blocks") > 0) & (c("trans_blocks") > 0) & F.coalesce(size_ratio < 0.6, F.lit(False)),
        "overlapping": c("pairs") > 3,
        "empty_blocks": (c("orig_blocks") > 3) & (c("trans_blocks") == 0),
        "empty_lines": (c("orig_lines") > 3) & (c("trans_lines") == 0),
        "char_ratio_bad": (c("orig_chars") > 0) & ((c("trans_chars") < c("orig_chars") * 0.25) | (c("trans_chars") > c("orig_chars") * 3.5)),
        "line_ratio_bad_45": some("bad_lines", "line_pairs", 0.45),
        "line_ratio_bad_40": some("bad_lines", "line_pairs", 0.4),
        "line_count_mismatch": (c("orig_lines") > 0) & ((c("trans_lines") < c("orig_lines") * 0.6) | (c("trans_lines") > c("orig_lines") * 1.7)),
        "untranslated_high": some("trans_english", "trans_worded", 0.3),
        "font_mismatch": some("font_off", "matched", 0.3),
        "color_mismatch": some("color_off", "matched", 0.3),
        "over_image_excess": c("trans_over_image") > c("orig_over_image") + 2,
        "table_missing": (c("orig_tables") > 0) & (c("trans_tables") == 0),
        "table_content_low": c("tables_low") > 0,
        "char_count_low": (c("orig_block_chars") > 50) & (c("trans_block_chars") < c("orig_block_chars") * 0.3),
        "unchanged_high": some("unchanged", "quality_matched", 0.12),
        "corrupted": (c("quality_matched") > 0) & ((c("corrupted_blocks") > c("quality_matched") * 0.08) | (c("extra_marks") >= 8) | (c("glyphs") >= 8)),
    }
    return stats.select("doc_id", "page", *[cond[r].alias(r) for r in RULES])


def judged(flags: DataFrame, method: str) -> DataFrame:
    """doc_id, page, issues (sorted, joined by a comma; 'OK' if none), passed."""
    found = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in sorted(METHODS[method])]))
    return flags.select("doc_id", "page", F.when(F.size(found) == 0, "OK").otherwise(F.array_join(found, ",")).alias("issues"), (F.size(found) == 0).alias("passed"))


def wanted_pages(mode: Column, pages: Column) -> Column:
    """How many pages a mode ('all', '50%', '25%', a whole number) asks for; anything else asks for a quarter.

    Blanks around and capitals don't matter; a number of none or fewer asks for one page (sampled_pages), null for a quarter.
    """
    m = F.lower(stripped(mode))
    n = F.regexp_replace(m, r"^\+|_", "").try_cast("long")
    quarter = F.greatest(F.lit(1), F.floor(pages / 4).cast("int"))
    return (
        F.when(m == "all", pages).when(m == "50%", F.greatest(F.lit(1), F.floor(pages / 2).cast("int"))).when(m == "25%", quarter)
        .when(m.rlike(r"^[+-]?\d+(_\d+)*$") & n.isNotNull(), F.least(n, pages.cast("long")).cast("int")).otherwise(quarter)
    )


def sampled_pages(pages: Column, k: Column) -> Column:
    """Array of k evenly spaced page numbers (from 1); all if k reaches the count, the middle one if k is one or less."""
    step = (pages - 1) / F.nullif(k - 1, F.lit(0)).cast("double")
    return (
        F.when(pages <= 0, F.array().cast("array<int>"))
        .when(k >= pages, F.sequence(F.lit(1), F.greatest(pages, F.lit(1))))
        .when(k <= 1, F.array(F.floor(pages / 2).cast("int") + 1))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(1))), lambda i: F.rint(i * step).cast("int") + 1))
    )


def picked_pages(bs: DataFrame, settings: DataFrame) -> DataFrame:
    """doc_id, orig_pages, trans_pages, mode, threshold, page: the sampled pages of documents with equal page counts, null for others."""
    n = page_counts(bs).join(settings, "doc_id", "left")
    n = n.select("doc_id", "orig_pages", "trans_pages", F.coalesce("mode", F.lit("25%")).alias("mode"), F.coalesce("threshold", F.lit(90)).alias("threshold"))
    pages = F.when(F.col("orig_pages") == F.col("trans_pages"), sampled_pages(F.col("orig_pages"), wanted_pages(F.col("mode"), F.col("orig_pages"))))
    return n.withColumn("page", F.explode_outer(pages))


def books(picked: DataFrame, pages: DataFrame) -> DataFrame:
    """Rollup to documents: picked as from picked_pages(), pages as from judged() of at least the picked ones.

    Documents whose sides have different page counts fail with rate 0 and no page counts.
    """
    one = ["doc_id", "orig_pages", "trans_pages", "threshold"]
    r = picked.join(pages, ["doc_id", "page"], "left").groupBy(*one).agg(F.count("page").alias("n"), F.count(F.when(~F.col("passed"), 1)).alias("f"))
    equal = F.col("orig_pages") == F.col("trans_pages")
    rate = F.when(~equal, 0.0).otherwise(F.coalesce((F.col("n") - F.col("f")) / F.nullif(F.col("n"), F.lit(0)), F.lit(1.0)))
    ok = equal & (rate >= F.col("threshold") / F.lit(100.0))
    told = F.format_string("%s: rate=%d%% (threshold=%d%%)", F.when(ok, "PASS").otherwise("FAIL"), F.bround(rate * 100).cast("int"), F.col("threshold").cast("int"))
    return r.select(
        "doc_id", "orig_pages", "trans_pages", F.when(equal, F.col("n")).alias("pages_checked"), F.when(equal, F.col("f")).alias("pages_failed"), equal.alias("same_pages"),
        F.round(rate, 3).alias("pass_rate"), ok.alias("passed"),
        F.when(equal, told).otherwise(F.format_string("PAGE_COUNT_MISMATCH: %d vs %d", "orig_pages", "trans_pages")).alias("summary"),
    )


def issue_texts() -> dict[str, Column]:
    """Issue text of each rule over the columns of page_stats()."""
    c = F.col
    two = lambda n, d: F.format_string("%.2f", c(n) / c(d))
    of = lambda code, *parts: F.concat(F.lit(code), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda n: c(n).cast("string")
    size = F.format_string("%.2f", F.when(c("orig_size") > 0, c("trans_size") / c("orig_size")).otherwise(1.0))
    bad = of("LINE_CHAR_RATIO_BAD: ", s("bad_lines"), "/", s("line_pairs"))
    return {
        "block_count_low": of("BLOCK_COUNT_LOW: ratio=", two("trans_blocks", "orig_blocks")), "font_too_small": of("FONT_TOO_SMALL: ratio=", size),
        "overlapping": of("OVERLAPPING: ", s("pairs"), " pairs"), "empty_blocks": F.lit("EMPTY_PAGE"), "empty_lines": F.lit("EMPTY_PAGE"),
        "char_ratio_bad": of("CHAR_RATIO_BAD: ", two("trans_chars", "orig_chars")), "line_ratio_bad_45": bad, "line_ratio_bad_40": bad,
        "line_count_mismatch": of("LINE_COUNT_MISMATCH: ratio=", two("trans_lines", "orig_lines")),
        "untranslated_high": of("HIGH_UNTRANSLATED: ", F.bround(c("trans_english") / c("trans_worded") * 100).cast("int").cast("string"), "%"),
        "font_mismatch": of("FONT_CATEGORY_MISMATCH: ", s("font_off"), "/", s("matched"), " blocks"), "color_mismatch": of("COLOR_MISMATCH: ", s("color_off"), "/", s("matched"), " blocks"),
        "over_image_excess": of("TEXT_OVER_IMAGE_EXCESS: orig=", s("orig_over_image"), " trans=", s("trans_over_image")),
        "table_missing": F.lit("TABLE_MISSING"), "table_content_low": of("TABLE_CONTENT_LOW: ", s("tables_low"), " tables"),
        "char_count_low": of("CHAR_COUNT_LOW: ratio=", two("trans_block_chars", "orig_block_chars")),
        "unchanged_high": of("UNCHANGED_BLOCKS_HIGH: ", s("unchanged"), "/", s("quality_matched")), "corrupted": of("CORRUPTED_GLYPHS: ", s("corrupted_blocks"), "/", s("quality_matched")),
    }


def issues(stats: DataFrame, method: str) -> DataFrame:
    """doc_id, page, issues: the texts of the rules of a method that a page breaks, with their figures, in the method's order; ['OK'] if none."""
    flags = rules(stats).drop("doc_id", "page").columns
    both = stats.join(rules(stats).withColumnsRenamed({f: f"is_{f}" for f in flags}), ["doc_id", "page"])
    texts = issue_texts()
    found = F.array_compact(F.array(*[F.when(F.col(f"is_{r}"), texts[r]) for r in METHODS[method]]))
    return both.select("doc_id", "page", F.when(F.size(found) == 0, F.array(F.lit("OK"))).otherwise(found).alias("issues"))
