"""Queries of the engine's own operators, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import fonts, text
from folioscope.functions.geometry import similar_colors
from folioscope.operators import pairing, scan, validate
from folioscope.session import broadcast_if_small, checkpointed
from folioscope.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# White space of the SQL dialect written out, as its \s is ASCII.
WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


LINES = f"""lines AS (SELECT DISTINCT line_id, side, doc_id, page, block_no, i, {squeeze('text')} AS text, x0, y0, x1, y1,
  length({squeeze('text')})::BIGINT AS n FROM (SELECT DISTINCT line_id, side, doc_id, page, block_no, i, text, x0, y0, x1, y1 FROM line_entry)
  WHERE {squeeze('text')} <> '' AND x1 > x0 AND y1 > y0)"""
BLOCKS = """blocks AS (SELECT DISTINCT block_id, side, doc_id, page, block_no, trim(text) AS text, coalesce(char_count, length(trim(text)))::BIGINT AS n,
  avg_size, dominant_font AS font, dominant_color AS color, x0, y0, x1, y1 FROM text_block WHERE trim(text) <> '')"""
SPANS = """spans AS (SELECT doc_id, side, page, block_no, i, line_id, k - 1 AS span_no, w AS text,
  ['Helvetica', 'Times-Roman', 'Courier'][((line_id + k - 1) % 3 + 1)::INT] AS font, 9.0 + (line_id + k - 1) % 4 * 0.5 AS size,
  ((line_id + k - 1) % 2 * 9109504)::INT AS color, ((line_id + k - 1) % 5)::INT AS flags, length(w)::BIGINT AS n
  FROM (SELECT *, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM lines))"""
LOB = """lob AS (SELECT doc_id, side, page, block_no, list(text ORDER BY i, line_id, text) AS texts, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  avg(greatest(y1 - y0, 1.0)) AS line_height FROM lines GROUP BY ALL)"""


def inter(a: str, b: str) -> str:
    return (
        f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0.0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0.0))"
    )


def area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def overlaps(a: str, b: str) -> str:
    c = inter(a, b)
    return f"({c} > 0 AND (({area(a)} > 0 AND {c} > {area(a)} * 0.2) OR ({area(b)} > 0 AND {c} > {area(b)} * 0.2)))"


def fclass(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(coalesce({x}, '')), '{p}') THEN '{c}'" for c, p in fonts.CLASSES)
    return f"(CASE {whens} ELSE 'sans' END)"


def rgb_diff(a: str, b: str) -> str:
    part = lambda x, s: f"((coalesce({x}, 0) >> {s}) & 255)"
    return "(" + " AND ".join(f"abs({part(a, s)} - {part(b, s)}) <= 30" for s in (16, 8, 0)) + ")"


def glyphs(t: str) -> str:
    n = lambda c: f"(length({t}) - length(replace({t}, '{c}', '')))"
    runs = f"length(array_to_string(regexp_extract_all({t}, '\\?{{3,}}'), ''))"
    return f"({n('�')} + {n('□')} + coalesce({runs}, 0) + CASE WHEN length({t}) >= 12 AND {n('?')} >= greatest(3, floor(length({t}) * 0.1)::INT) THEN {n('?')} ELSE 0 END)::BIGINT"


def word_list(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def english(t: str) -> str:
    w = word_list(squeeze(f"lower({t})"))
    among = "[" + ", ".join(f"'{x}'" for x in text.ENGLISH.split()) + "]"
    return f"(len({w}) >= 4 AND len(list_filter({w}, lambda w: list_contains({among}, w))) * 4 > len({w}))"


def lines_df(s, d):
    return scan.lines(table(s, d, "line_entry"))


def blocks_df(s, d):
    return scan.blocks(table(s, d, "text_block"))


def paired_blocks(s, d):
    """Blocks of documents that have both sides."""
    b = blocks_df(s, d)
    both = b.groupBy("doc_id").agg(F.count_distinct("side").alias("k")).where("k = 2").select("doc_id")
    return b.join(both, "doc_id", "left_semi")


@q(f"WITH {LINES} SELECT line_id, side, doc_id, page, i, text, n FROM lines")
def line_scan(s, d):
    return lines_df(s, d).select("line_id", "side", "doc_id", "page", "i", "text", "n")


TABLE_LIKE = """(len(texts) >= 3 AND ((len(list_filter(texts, lambda x: length(x) <= 36)) >= greatest(2, floor(len(texts) * 0.6)::INT) AND len(list_filter(texts, lambda x: regexp_matches(x, '\\d'))) >= 2)
  OR (len(list_filter(texts, lambda x: regexp_matches(x, '[|;:]'))) >= 1 AND len(list_filter(texts, lambda x: length(x) <= 36)) >= 2)))"""


@q(f"WITH {LINES}, {LOB} SELECT doc_id, side, page, block_no, array_to_string(texts, ' ') AS text, len(texts)::BIGINT AS line_count, {TABLE_LIKE} AS table_like, x0, y0, x1, y1 FROM lob")
def block_scan(s, d):
    b = scan.blocks_of_lines(lines_df(s, d))
    return b.select("doc_id", "side", "page", "block_no", "text", F.size("texts").cast("long").alias("line_count"), "table_like", "x0", "y0", "x1", "y1")


@q(f"WITH {LINES}, {LOB} SELECT doc_id, side, page, count(*) AS blocks, count(*) FILTER ({TABLE_LIKE}) AS table_blocks FROM lob GROUP BY ALL")
def table_like_blocks(s, d):
    b = scan.blocks_of_lines(lines_df(s, d))
    return b.groupBy("doc_id", "side", "page").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("table_like"), 1)).alias("table_blocks"))


def spans(ls: DataFrame) -> DataFrame:
    """Spans of lines: one per word, styled by rule of its place (a stand-in for what a document parser delivers)."""
    w = ls.select("doc_id", "side", "page", "block_no", "i", "line_id", F.posexplode(F.split("text", " ")).alias("span_no", "text"))
    k = F.col("line_id") + F.col("span_no")
    return w.select(
        "*",
        F.element_at(F.array(F.lit("Helvetica"), F.lit("Times-Roman"), F.lit("Courier")), (k % 3 + 1).cast("int")).alias("font"),
        (F.lit(9.0) + k % 4 * 0.5).alias("size"), (k % 2 * 9109504).cast("int").alias("color"), (k % 5).cast("int").alias("flags"),
        F.length("text").cast("long").alias("n"),
    )


@q(f"WITH {LINES}, {SPANS} SELECT doc_id, side, page, block_no, font, sum(n)::BIGINT AS chars FROM spans GROUP BY ALL")
def block_histogram(s, d):
    return scan.histogram(spans(lines_df(s, d)), "font")


@q(f"""WITH {LINES}, {SPANS}, g AS (SELECT doc_id, side, page, block_no, font, round_even(size, 1) AS size, color, flags, sum(n)::BIGINT AS chars, min((i, line_id, span_no)) AS first FROM spans GROUP BY ALL)
SELECT doc_id, side, page, block_no, font, size::DOUBLE AS size, color, flags, chars FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, side, page, block_no ORDER BY chars DESC, first) = 1""")
def dominant_style(s, d):
    return scan.dominant_style(spans(lines_df(s, d)))


@q(f"WITH {LINES}, {SPANS}, b AS (SELECT doc_id, side, page, block_no, avg(size) AS a FROM spans GROUP BY ALL) SELECT doc_id, side, page, count(*) AS blocks, round(avg(a), 6) AS mean_size FROM b GROUP BY ALL")
def block_sizes(s, d):
    b = scan.block_sizes(spans(lines_df(s, d)))
    return b.groupBy("doc_id", "side", "page").agg(F.count("*").alias("blocks"), F.round(F.avg("avg_size"), 6).alias("mean_size"))


@q(f"""WITH {LINES}, {LOB} SELECT doc_id, side, page, block_no, round(greatest(1.0, least(1.9, line_height / 10.0)), 6) AS ratio FROM lob""")
def line_height(s, d):
    b = scan.line_height_ratio(scan.blocks_of_lines(lines_df(s, d)).withColumn("size", F.lit(10.0)))
    return b.select("doc_id", "side", "page", "block_no", F.round("ratio", 6).alias("ratio"))


LETTERS = "len(regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ]'))"
SIGNS = r"^[\d\s\-–—.,:;!?()\[\]{}/|@#$%^&*+=<>~`''\"]+$"


@q(f"""WITH {BLOCKS}, b AS (SELECT block_id, {squeeze('text')} AS t FROM blocks) SELECT block_id,
 (t <> '' AND NOT regexp_matches(t, '{SIGNS}') AND {LETTERS} >= 1 AND NOT ({LETTERS} = 1 AND length(t) < 3)) AS translate FROM b""")
def should_translate(s, d):
    return blocks_df(s, d).select("block_id", text.should_translate(F.col("text")).alias("translate"))


@q(f"""WITH e AS (SELECT DISTINCT entry_id, {squeeze("coalesce(original, '')")} AS a, {squeeze("coalesce(translated, '')")} AS b FROM ocr_entry)
SELECT entry_id, (a = b AND length(a) >= 18 AND len({word_list('a')}) >= 3) AS same, (lower(a) = lower(b) AND length(lower(a)) >= 18 AND len({word_list('a')}) >= 3) AS same_folded FROM e""")
def unchanged_pairs(s, d):
    e = table(s, d, "ocr_entry").select("entry_id", "original", "translated").distinct()
    u = lambda fold: text.unchanged(F.col("original"), F.col("translated"), fold)
    return e.select("entry_id", u(False).alias("same"), u(True).alias("same_folded"))


@q(f"WITH {BLOCKS} SELECT doc_id, side, count(*) AS blocks, count(*) FILTER ({english('text')}) AS english FROM blocks GROUP BY ALL")
def likely_english(s, d):
    e = F.count(F.when(text.likely_english(F.col("text")), 1)).alias("english")
    return blocks_df(s, d).groupBy("doc_id", "side").agg(F.count("*").alias("blocks"), e)


@q(f"WITH {BLOCKS} SELECT block_id, {glyphs('text')} AS glyphs FROM blocks")
def suspicious_glyphs(s, d):
    return blocks_df(s, d).select("block_id", text.suspicious_glyphs(F.col("text")).cast("long").alias("glyphs"))


@q(f"WITH {BLOCKS} SELECT doc_id, side, page, sum(length(translate(text, chr(32) || chr(10) || chr(9), '')))::BIGINT AS chars, sum(length(translate(text, chr(32) || chr(10) || chr(9), ''))) < 30 AS scanned FROM blocks GROUP BY ALL")
def scanned_pages(s, d):
    return scan.scanned_pages(blocks_df(s, d))


FLAGGED = "SELECT block_id, dominant_font AS f, ((block_id % 3 = 0)::INT * 262144 + (block_id % 4)::INT) AS k FROM (SELECT DISTINCT block_id, dominant_font FROM text_block)"
BOLD, ITALIC = "(regexp_matches(lower(coalesce(f, '')), 'bold|black|heavy') OR (k & 262144) <> 0)", "(regexp_matches(lower(coalesce(f, '')), 'italic|oblique') OR (k & 2) <> 0)"
STAND = f"CASE {fclass('f')} WHEN 'symbol' THEN 'symb' " + " ".join(f"WHEN '{c}' THEN {v.split()}[1 + {ITALIC}::INT + {BOLD}::INT * 2]" for c, v in fonts.STAND_INS.items()) + " END"


@q(f"WITH b AS ({FLAGGED}) SELECT block_id, {fclass('f')} AS font_class, {BOLD} AS bold, {ITALIC} AS italic, {STAND} AS stand_in, 'uf' || substr(md5(lower(coalesce(f, ''))), 1, 10) AS alias FROM b")
def font_class(s, d):
    b = table(s, d, "text_block").select("block_id", F.col("dominant_font").alias("f")).distinct()
    flags = (F.when(F.col("block_id") % 3 == 0, 262144).otherwise(0) + F.col("block_id") % 4).cast("int")
    f = F.col("f")
    return b.select(
        "block_id", fonts.font_class(f).alias("font_class"), fonts.is_bold(f, flags).alias("bold"), fonts.is_italic(f, flags).alias("italic"),
        fonts.stand_in(f, flags).alias("stand_in"), fonts.alias(F.coalesce(f, F.lit(""))).alias("alias"),
    )


PAGES = """pc AS (SELECT doc_id, coalesce(max(CASE WHEN side = 'orig' THEN page END), 0) AS op, coalesce(max(CASE WHEN side = 'trans' THEN page END), 0) AS tp FROM blocks GROUP BY ALL),
pages AS (SELECT doc_id, unnest(generate_series(1, op)) AS page FROM pc WHERE op = tp)"""


@q(f"WITH {BLOCKS}, {PAGES} SELECT doc_id, page::INT AS page FROM pages")
def page_pairs(s, d):
    return pairing.page_pairs(blocks_df(s, d))


RANKED = "r AS (SELECT doc_id, page, side, n, row_number() OVER (PARTITION BY doc_id, page, side ORDER BY i, line_id) AS k FROM lines), lp AS (SELECT o.doc_id, o.page, o.k, o.n AS orig_n, t.n AS trans_n FROM r o JOIN r t ON o.doc_id = t.doc_id AND o.page = t.page AND o.k = t.k AND o.side = 'orig' AND t.side = 'trans')"


@q(f"WITH {LINES}, {RANKED} SELECT doc_id, page, k::INT AS rank, orig_n, trans_n FROM lp")
def line_pairs(s, d):
    return pairing.line_pairs(lines_df(s, d))


SCORE = f"{inter('o', 't')} / least(greatest({area('o')}, 1.0), greatest({area('t')}, 1.0))"
BEST = f"""bo AS (SELECT o.doc_id, o.page, o.block_id AS o_block_id, o.text AS o_text, o.font AS o_font, o.color AS o_color, t.block_id AS t_block_id, t.text AS t_text, t.font AS t_font, t.color AS t_color, {SCORE} AS score
 FROM blocks o JOIN blocks t ON o.doc_id = t.doc_id AND o.page = t.page AND o.side = 'orig' AND t.side = 'trans' WHERE {inter('o', 't')} > 0
 QUALIFY row_number() OVER (PARTITION BY o.block_id ORDER BY {SCORE} DESC, t.block_no, t.block_id) = 1), best AS (SELECT * FROM bo WHERE score >= 0.12)"""


@q(f"WITH {BLOCKS}, {BEST} SELECT o_block_id, t_block_id, round(score, 6) AS score FROM best")
def best_overlap(s, d):
    return pairing.best_overlap(blocks_df(s, d)).select("o_block_id", "t_block_id", F.round("score", 6).alias("score"))


@q(f"WITH {BLOCKS}, {BEST} SELECT doc_id, page, count(*) AS matched, count(*) FILTER ({rgb_diff('o_color', 't_color')}) AS alike FROM best GROUP BY ALL")
def color_similar(s, d):
    m = pairing.best_overlap(blocks_df(s, d))
    alike = F.count(F.when(similar_colors(F.col("o_dominant_color"), F.col("t_dominant_color")), 1)).alias("alike")
    return m.groupBy("doc_id", "page").agg(F.count("*").alias("matched"), alike)


OVER = f"ov AS (SELECT a.doc_id, a.side, a.page, count(*) AS pairs FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.side = b.side AND a.page = b.page AND (a.block_no, a.block_id) < (b.block_no, b.block_id) AND {overlaps('a', 'b')} GROUP BY ALL)"


@q(f"WITH {BLOCKS}, {OVER} SELECT * FROM ov")
def overlap_pairs(s, d):
    return pairing.overlap_pairs(blocks_df(s, d))


IMAGES = "images AS (SELECT DISTINCT doc_id, 'trans' AS side, page, x0, y0, x1, y1 FROM ocr_entry WHERE x1 - x0 >= 5 AND y1 - y0 >= 5)"


def images_df(s, d):
    e = scan.image_rects(table(s, d, "ocr_entry").withColumn("side", F.lit("trans")))
    return e.where("x1 - x0 >= 5 and y1 - y0 >= 5")


@q(f"WITH {BLOCKS}, {IMAGES} SELECT doc_id, side, page, block_id FROM blocks b WHERE EXISTS (SELECT 1 FROM images i WHERE i.doc_id = b.doc_id AND i.side = b.side AND i.page = b.page AND {overlaps('b', 'i')})")
def text_over_image(s, d):
    return pairing.over_images(blocks_df(s, d), images_df(s, d))


CELLS = """ty AS (SELECT *, (round_even(y0 / 5, 0) * 5)::INT AS y FROM blocks), trow AS (SELECT doc_id, side, page, y, count(*) AS m FROM ty GROUP BY ALL HAVING count(*) >= 3),
tn AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, side, page ORDER BY y) < 30 THEN 0 ELSE 1 END AS new FROM trow),
tt AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, side, page ORDER BY y) AS table_no, count(*) OVER (PARTITION BY doc_id, side, page) AS many FROM tn),
tc AS (SELECT *, sum(m) OVER (PARTITION BY doc_id, side, page, table_no) AS cells FROM tt),
cells AS (SELECT ty.*, tc.table_no FROM ty JOIN tc USING (doc_id, side, page, y) WHERE tc.many >= 2 AND tc.cells >= 6)"""


@q(f"WITH {BLOCKS}, {CELLS} SELECT doc_id, side, page, table_no::BIGINT AS table_no, count(*) AS cells FROM cells GROUP BY ALL")
def table_regions(s, d):
    return pairing.table_cells(blocks_df(s, d)).groupBy("doc_id", "side", "page", "table_no").agg(F.count("*").alias("cells"))


MATCH = f"""th AS (SELECT o.doc_id, o.page, o.table_no AS ot, t.table_no AS tt, count(*) AS hits FROM cells o JOIN cells t ON o.doc_id = t.doc_id AND o.page = t.page AND o.side = 'orig' AND t.side = 'trans' AND {overlaps('o', 't')} GROUP BY ALL),
tb AS (SELECT * FROM th QUALIFY row_number() OVER (PARTITION BY doc_id, page, ot ORDER BY hits DESC, tt) = 1),
tm AS (SELECT doc_id, page, ot::BIGINT AS ot, tt::BIGINT AS tt, hits, (SELECT count(*) FROM cells c WHERE c.doc_id = tb.doc_id AND c.page = tb.page AND c.side = 'orig' AND c.table_no = tb.ot) AS orig_cells,
 (SELECT count(*) FROM cells c WHERE c.doc_id = tb.doc_id AND c.page = tb.page AND c.side = 'trans' AND c.table_no = tb.tt) AS trans_cells FROM tb)"""


@q(f"WITH {BLOCKS}, {CELLS}, {MATCH} SELECT * FROM tm")
def table_match(s, d):
    return pairing.table_matches(blocks_df(s, d))


def stat_sql() -> str:
    side = lambda agg, name: ", ".join(f"{agg.replace('{s}', x)} AS {x}_{name}" for x in ("orig", "trans"))
    f = "FILTER (side = '{s}')"
    worded = f"len({word_list(squeeze('text'))}) >= 4"
    qm = lambda c: f"(length({c}) - length(replace({c}, '?', '')))"
    same = f"({squeeze('lower(o_text)')} = {squeeze('lower(t_text)')} AND length({squeeze('lower(o_text)')}) >= 18 AND len({word_list(squeeze('o_text'))}) >= 3)"
    return f"""{PAGES}, {RANKED}, {BEST}, {OVER}, {IMAGES}, {CELLS}, {MATCH},
sb AS (SELECT doc_id, page, {side('count(*) ' + f, 'blocks')}, {side('sum(n) ' + f, 'block_chars')}, {side('avg(avg_size) ' + f, 'size')},
 {side("count(*) FILTER (side = '{s}' AND " + english('text') + ")", 'english')}, {side("count(*) FILTER (side = '{s}' AND " + worded + ")", 'worded')} FROM blocks GROUP BY ALL),
sl AS (SELECT doc_id, page, {side('count(*) ' + f, 'lines')}, {side('sum(n) ' + f, 'chars')} FROM lines GROUP BY ALL),
slp AS (SELECT doc_id, page, count(*) AS line_pairs, count(*) FILTER (trans_n / greatest(orig_n, 1) < 0.2 OR trans_n / greatest(orig_n, 1) > 4.0) AS bad_lines FROM lp GROUP BY ALL),
sm AS (SELECT doc_id, page, count(*) FILTER (length(o_text) >= 8) AS quality_matched, count(*) FILTER (length(o_text) >= 8 AND {same}) AS unchanged,
 count(*) FILTER (length(o_text) >= 8 AND {glyphs('t_text')} > 0) AS corrupted_blocks, coalesce(sum(greatest({qm('t_text')} - {qm('o_text')}, 0)) FILTER (length(o_text) >= 8), 0) AS extra_marks,
 coalesce(sum({glyphs('t_text')}) FILTER (length(o_text) >= 8), 0) AS glyphs, count(*) AS matched,
 count(*) FILTER ({fclass('o_font')} <> {fclass('t_font')} AND {fclass('o_font')} <> 'symbol') AS font_off, count(*) FILTER (NOT {rgb_diff('o_color', 't_color')}) AS color_off FROM best GROUP BY ALL),
so AS (SELECT doc_id, page, pairs FROM ov WHERE side = 'trans'),
si AS (SELECT doc_id, page, {side('count(*) ' + f, 'over_image')} FROM blocks b WHERE EXISTS (SELECT 1 FROM images i WHERE i.doc_id = b.doc_id AND i.side = b.side AND i.page = b.page AND {overlaps('b', 'i')}) GROUP BY ALL),
st AS (SELECT doc_id, page, {side("count(DISTINCT table_no) FILTER (side = '{s}')", 'tables')} FROM cells GROUP BY ALL),
stm AS (SELECT doc_id, page, count(*) FILTER (trans_cells < orig_cells * 0.5) AS tables_low FROM tm GROUP BY ALL),
stats AS (SELECT * FROM pages p LEFT JOIN sb USING (doc_id, page) LEFT JOIN sl USING (doc_id, page) LEFT JOIN slp USING (doc_id, page) LEFT JOIN sm USING (doc_id, page)
 LEFT JOIN so USING (doc_id, page) LEFT JOIN si USING (doc_id, page) LEFT JOIN st USING (doc_id, page) LEFT JOIN stm USING (doc_id, page))"""


def z(c: str) -> str:
    return f"coalesce({c}, 0)"


RULE_SQL = {
    "block_count_low": f"{z('orig_blocks')} > 0 AND {z('trans_blocks')} < {z('orig_blocks')} * 0.5",
    "font_too_small": f"{z('orig_blocks')} > 0 AND {z('trans_blocks')} > 0 AND coalesce(CASE WHEN orig_size > 0 THEN trans_size / orig_size ELSE 1.0 END < 0.6, false)",
    "overlapping": f"{z('pairs')} > 3",
    "empty_blocks": f"{z('orig_blocks')} > 3 AND {z('trans_blocks')} = 0",
    "empty_lines": f"{z('orig_lines')} > 3 AND {z('trans_lines')} = 0",
    "char_ratio_bad": f"{z('orig_chars')} > 0 AND ({z('trans_chars')} < {z('orig_chars')} * 0.25 OR {z('trans_chars')} > {z('orig_chars')} * 3.5)",
    "line_ratio_bad_45": f"{z('line_pairs')} > 0 AND {z('bad_lines')} > {z('line_pairs')} * 0.45",
    "line_ratio_bad_40": f"{z('line_pairs')} > 0 AND {z('bad_lines')} > {z('line_pairs')} * 0.4",
    "line_count_mismatch": f"{z('orig_lines')} > 0 AND ({z('trans_lines')} < {z('orig_lines')} * 0.6 OR {z('trans_lines')} > {z('orig_lines')} * 1.7)",
    "untranslated_high": f"{z('trans_worded')} > 0 AND {z('trans_english')} > {z('trans_worded')} * 0.3",
    "font_mismatch": f"{z('matched')} > 0 AND {z('font_off')} > {z('matched')} * 0.3",
    "color_mismatch": f"{z('matched')} > 0 AND {z('color_off')} > {z('matched')} * 0.3",
    "over_image_excess": f"{z('trans_over_image')} > {z('orig_over_image')} + 2",
    "table_missing": f"{z('orig_tables')} > 0 AND {z('trans_tables')} = 0",
    "table_content_low": f"{z('tables_low')} > 0",
    "char_count_low": f"{z('orig_block_chars')} > 50 AND {z('trans_block_chars')} < {z('orig_block_chars')} * 0.3",
    "unchanged_high": f"{z('quality_matched')} > 0 AND {z('unchanged')} > {z('quality_matched')} * 0.12",
    "corrupted": f"{z('quality_matched')} > 0 AND ({z('corrupted_blocks')} > {z('quality_matched')} * 0.08 OR {z('extra_marks')} >= 8 OR {z('glyphs')} >= 8)",
}
def flags_df(s, d):
    b, ls = checkpointed(blocks_df(s, d)), checkpointed(lines_df(s, d))
    return validate.rules(validate.page_stats(b, ls, images_df(s, d)))


def judged_sql(method: str) -> str:
    parts = ", ".join(f"CASE WHEN {RULE_SQL[r]} THEN '{r}' END" for r in sorted(validate.METHODS[method]))
    return f"""WITH {BLOCKS}, {LINES}, {stat_sql()}, j AS (SELECT doc_id, page, list_filter([{parts}], lambda x: x IS NOT NULL) AS found FROM stats)
SELECT doc_id, page::INT AS page, CASE WHEN len(found) = 0 THEN 'OK' ELSE array_to_string(found, ',') END AS issues, len(found) = 0 AS passed FROM j"""


@q(judged_sql("char_count"))
def validate_char_count(s, d):
    return validate.judged(flags_df(s, d), "char_count")


@q(judged_sql("structural"))
def validate_structural(s, d):
    return validate.judged(flags_df(s, d), "structural")


@q(judged_sql("hybrid"))
def validate_hybrid(s, d):
    return validate.judged(flags_df(s, d), "hybrid")


MODES = """st0 AS (SELECT b.doc_id, min(c.validation_mode) AS mode, min(c.fidelity_threshold) AS threshold FROM book b JOIN config_set c USING (config_id) GROUP BY ALL)"""
M = f"lower(regexp_replace(mode, '^{WS}|{WS}$', '', 'g'))"
SAMPLE = f"""n AS (SELECT pc.doc_id, op, tp, coalesce(mode, '25%') AS mode, coalesce(threshold, 90) AS threshold FROM pc LEFT JOIN st0 USING (doc_id)),
w AS (SELECT *, CASE WHEN {M} = 'all' THEN op WHEN {M} = '50%' THEN greatest(1, op // 2) WHEN {M} = '25%' THEN greatest(1, op // 4)
 WHEN regexp_matches({M}, '^[+-]?\\d+(_\\d+)*$') THEN least(replace(replace({M}, '_', ''), '+', '')::BIGINT, op) ELSE greatest(1, op // 4) END AS k FROM n WHERE op = tp),
picked AS (SELECT *, unnest(CASE WHEN op <= 0 THEN [] WHEN k >= op THEN generate_series(1, op) WHEN k <= 1 THEN [op // 2 + 1] ELSE list_transform(generate_series(0, k - 1), lambda i: (round_even(i * ((op - 1) / (k - 1)), 0))::BIGINT + 1) END)::INT AS page FROM w)"""


def settings_df(s, d):
    b, c = table(s, d, "book").select("doc_id", "config_id"), table(s, d, "config_set")
    return b.join(broadcast_if_small(c), "config_id").groupBy("doc_id").agg(F.min("validation_mode").alias("mode"), F.min("fidelity_threshold").alias("threshold"))


@q(f"WITH {BLOCKS}, {PAGES}, {MODES}, {SAMPLE} SELECT doc_id, mode, page FROM picked")
def page_sample(s, d):
    return validate.picked_pages(blocks_df(s, d), settings_df(s, d)).where("page is not null").select("doc_id", "mode", "page")


def book_sql() -> str:
    j = judged_sql("hybrid").removeprefix("WITH ").rpartition("\nSELECT")
    return f"""WITH {j[0]}, jj AS (SELECT {j[2]}), {MODES}, {SAMPLE},
bk AS (SELECT p.doc_id, count(*) AS pages_checked, count(*) FILTER (NOT jj.passed) AS pages_failed FROM picked p LEFT JOIN jj USING (doc_id, page) GROUP BY ALL),
x AS (SELECT n.doc_id, op, tp, pages_checked, pages_failed, threshold, op = tp AS same_pages, CASE WHEN op <> tp THEN 0.0 ELSE coalesce((pages_checked - pages_failed) / nullif(pages_checked, 0), 1.0) END AS rate FROM n LEFT JOIN bk USING (doc_id)),
y AS (SELECT *, (same_pages AND rate >= threshold / 100.0) AS passed FROM x)
SELECT doc_id, op AS orig_pages, tp AS trans_pages, pages_checked, pages_failed, same_pages, round(rate, 3) AS pass_rate, passed, CASE WHEN NOT same_pages THEN 'PAGE_COUNT_MISMATCH: ' || op || ' vs ' || tp
 ELSE CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ': rate=' || round_even(rate * 100, 0)::INT || '% (threshold=' || threshold::INT || '%)' END AS summary FROM y"""


@q(book_sql())
def validate_book(s, d):
    b, ls = checkpointed(blocks_df(s, d)), lines_df(s, d)
    picked = checkpointed(validate.picked_pages(b, settings_df(s, d)))
    pages = picked.where("page is not null").select("doc_id", "page")
    # Only sampled pages are judged.
    only = lambda df: checkpointed(df.join(pages, ["doc_id", "page"], "left_semi"))
    stats = validate.page_stats(only(b), only(ls), images_df(s, d), pages)
    return validate.books(picked, validate.judged(validate.rules(stats), "hybrid"))


@q(f"WITH t AS ({book_sql()}) SELECT count(*) AS books, count(*) FILTER (passed) AS passing, count(*) FILTER (NOT passed) AS failing, coalesce(sum(pages_failed), 0)::BIGINT AS pages_failed FROM t")
def validation_totals(s, d):
    v = validate_book(s, d)
    return v.agg(F.count("*").alias("books"), F.count(F.when(F.col("passed"), 1)).alias("passing"), F.count(F.when(~F.col("passed"), 1)).alias("failing"), F.coalesce(F.sum("pages_failed"), F.lit(0)).alias("pages_failed"))


def issue_sql(method: str) -> str:
    two = lambda a, b: f"format('{{:.2f}}', {z(a)} / {b})"
    v = lambda c: f"{z(c)}::BIGINT"
    bad = f"'LINE_CHAR_RATIO_BAD: ' || {v('bad_lines')} || '/' || {v('line_pairs')}"
    texts = {
        "block_count_low": f"'BLOCK_COUNT_LOW: ratio=' || {two('trans_blocks', 'orig_blocks')}",
        "font_too_small": "'FONT_TOO_SMALL: ratio=' || format('{:.2f}', CASE WHEN orig_size > 0 THEN trans_size / orig_size ELSE 1.0 END)",
        "overlapping": f"'OVERLAPPING: ' || {v('pairs')} || ' pairs'", "empty_blocks": "'EMPTY_PAGE'", "empty_lines": "'EMPTY_PAGE'",
        "char_ratio_bad": f"'CHAR_RATIO_BAD: ' || {two('trans_chars', 'orig_chars')}", "line_ratio_bad_45": bad, "line_ratio_bad_40": bad,
        "line_count_mismatch": f"'LINE_COUNT_MISMATCH: ratio=' || {two('trans_lines', 'orig_lines')}",
        "untranslated_high": "'HIGH_UNTRANSLATED: ' || round_even(trans_english / trans_worded * 100, 0)::INT || '%'",
        "font_mismatch": f"'FONT_CATEGORY_MISMATCH: ' || {v('font_off')} || '/' || {v('matched')} || ' blocks'", "color_mismatch": f"'COLOR_MISMATCH: ' || {v('color_off')} || '/' || {v('matched')} || ' blocks'",
        "over_image_excess": f"'TEXT_OVER_IMAGE_EXCESS: orig=' || {v('orig_over_image')} || ' trans=' || {v('trans_over_image')}", "table_missing": "'TABLE_MISSING'",
        "table_content_low": f"'TABLE_CONTENT_LOW: ' || {v('tables_low')} || ' tables'", "char_count_low": f"'CHAR_COUNT_LOW: ratio=' || {two('trans_block_chars', 'orig_block_chars')}",
        "unchanged_high": f"'UNCHANGED_BLOCKS_HIGH: ' || {v('unchanged')} || '/' || {v('quality_matched')}", "corrupted": f"'CORRUPTED_GLYPHS: ' || {v('corrupted_blocks')} || '/' || {v('quality_matched')}",
    }
    parts = ", ".join(f"CASE WHEN {RULE_SQL[r]} THEN {texts[r]} END" for r in validate.METHODS[method])
    return f"""WITH {BLOCKS}, {LINES}, {stat_sql()}, j AS (SELECT doc_id, page, list_filter([{parts}], lambda x: x IS NOT NULL) AS found FROM stats)
SELECT doc_id, page::INT AS page, CASE WHEN len(found) = 0 THEN 'OK' ELSE array_to_string(found, ' | ') END AS issues FROM j"""


@q(issue_sql("hybrid"))
def validate_issues(s, d):
    b, ls = checkpointed(blocks_df(s, d)), checkpointed(lines_df(s, d))
    stats = checkpointed(validate.page_stats(b, ls, images_df(s, d)))
    return validate.issues(stats, "hybrid").select("doc_id", "page", F.array_join("issues", " | ").alias("issues"))


def top_sql(x: str) -> str:
    return f"SELECT doc_id, side, page, block_no, v FROM (SELECT doc_id, side, page, block_no, {x} AS v, sum(n) AS n, min((i, line_id, span_no)) AS f FROM spans GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, side, page, block_no ORDER BY n DESC, f) = 1"


HIST = "SELECT doc_id, side, page, block_no, string_agg(v || '=' || n, ';' ORDER BY v) AS h FROM (SELECT doc_id, side, page, block_no, {}::VARCHAR AS v, sum(n)::BIGINT AS n FROM spans GROUP BY ALL) GROUP BY ALL"


@q(f"""WITH {LINES}, {SPANS}, hf AS ({HIST.format('font')}), hc AS ({HIST.format('color')}), hg AS ({HIST.format('flags')}), tf AS ({top_sql('font')}), tc AS ({top_sql('color')}), tg AS ({top_sql('flags')}),
a AS (SELECT doc_id, side, page, block_no, round(avg(size), 6) AS avg_size FROM spans GROUP BY ALL)
SELECT doc_id, side, page, block_no, hf.h AS fonts, hc.h AS colors, hg.h AS flags, tf.v AS dominant_font, tc.v AS dominant_color, tg.v AS dominant_flags, avg_size FROM a
 JOIN hf USING (doc_id, side, page, block_no) JOIN hc USING (doc_id, side, page, block_no) JOIN hg USING (doc_id, side, page, block_no) JOIN tf USING (doc_id, side, page, block_no) JOIN tc USING (doc_id, side, page, block_no) JOIN tg USING (doc_id, side, page, block_no)""")
def detailed_blocks(s, d):
    b = scan.detailed_blocks(spans(lines_df(s, d)))
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias(m)
    return b.select("doc_id", "side", "page", "block_no", told("fonts"), told("colors"), told("flags"), "dominant_font", "dominant_color", "dominant_flags", F.round("avg_size", 6).alias("avg_size"))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


@q(f"""WITH l AS (SELECT doc_id, side, page, block_no, list(text ORDER BY i, line_id, text) AS ts FROM (SELECT DISTINCT line_id, side, doc_id, page, block_no, i, text FROM line_entry WHERE text IS NOT NULL) GROUP BY ALL)
SELECT doc_id, side, page, block_no, {strip("array_to_string(ts, ' ')")} AS raw, array_to_string(list_filter(list_transform(ts, lambda x: {strip('x')}), lambda x: x <> ''), ' ') AS trimmed FROM l""")
def block_texts(s, d):
    e = table(s, d, "line_entry").select("line_id", "side", "doc_id", "page", "block_no", "i", "text").where("text is not null").distinct()
    g = e.groupBy("doc_id", "side", "page", "block_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line_id", "text"))), lambda x: F.array(x["text"])).alias("ls"))
    return g.select("doc_id", "side", "page", "block_no", scan.joined_text(F.col("ls"), False).alias("raw"), scan.joined_text(F.col("ls"), True).alias("trimmed"))


@q(f"""WITH {LINES}, {LOB}, {IMAGES}, b AS (SELECT *, {TABLE_LIKE} AS tl FROM lob), r AS (
 SELECT doc_id, side, page, block_no, NULL::INT AS i, array_to_string(texts, ' ') AS text, len(texts)::INT AS line_count, x0, y0, x1, y1 FROM b WHERE NOT tl
 UNION ALL SELECT l.doc_id, l.side, l.page, l.block_no, l.i, l.text, 1, l.x0, l.y0, l.x1, l.y1 FROM lines l JOIN b USING (doc_id, side, page, block_no) WHERE tl)
SELECT r.*, EXISTS (SELECT 1 FROM images m WHERE m.doc_id = r.doc_id AND m.side = r.side AND m.page = r.page AND {inter('r', 'm')} > 0) AS over_image FROM r WHERE x1 - x0 >= 5 AND y1 - y0 >= 3""")
def translation_scan(s, d):
    r = scan.request_rows(lines_df(s, d))
    r = scan.over_any_image(r, images_df(s, d), ["block_no", "i"])
    return r.select("doc_id", "side", "page", "block_no", "i", "text", "line_count", "x0", "y0", "x1", "y1", "over_image")


@q(f"""WITH e AS (SELECT DISTINCT entry_id, {squeeze("coalesce(original, '')")} AS t FROM ocr_entry WHERE x0 IS NOT NULL)
SELECT entry_id FROM e WHERE t <> '' AND NOT regexp_matches(t, '{SIGNS}') AND {LETTERS} >= 1 AND NOT ({LETTERS} = 1 AND length(t) < 3)""")
def ocr_results(s, d):
    e = table(s, d, "ocr_entry").select("entry_id", F.col("original").alias("text"), "x0", "y0", "x1", "y1").where("x0 is not null").distinct()
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return scan.recognised_texts(e.withColumn("points", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")))).select("entry_id").distinct()
