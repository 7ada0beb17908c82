"""Queries of batching, replies, logs, listings and sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text
from folioscope.operators import batching, images, lineage, queueing, scan, translate
from folioscope.plans.core import BLOCKS, LETTERS, LINES, LOB, QUERIES, SIGNS, SQL, TABLE_LIKE, WS, blocks_df, lines_df, q, squeeze
from folioscope.sources.tables import table

__all__ = ["QUERIES", "SQL"]


@q(f"""WITH {BLOCKS}, g AS (SELECT doc_id, page, list(block_id ORDER BY block_no, block_id) AS ids, list(greatest(length(text), 1) ORDER BY block_no, block_id) AS ls FROM blocks WHERE side = 'orig' GROUP BY ALL),
f AS (SELECT doc_id, page, ids, list_reduce(ls, lambda s, n: CASE WHEN s.k >= 10 OR (s.k > 0 AND s.used + n > 2200)
 THEN struct_pack(k := 1::BIGINT, used := n::BIGINT, b := s.b + 1, res := list_append(s.res, s.b + 1))
 ELSE struct_pack(k := s.k + 1, used := s.used + n, b := greatest(s.b, 1), res := list_append(s.res, greatest(s.b, 1))) END,
 struct_pack(k := 0::BIGINT, used := 0::BIGINT, b := 0::BIGINT, res := []::BIGINT[])).res AS bs FROM g)
SELECT doc_id, page, unnest(ids) AS block_id, unnest(bs)::INT AS batch_no FROM f""")
def batch_packing(s, d):
    return batching.page_batches(blocks_df(s, d))


def wrap_sql(words: str, budgets: str, count: str, expansion: float, exact: bool) -> str:
    """SQL of rewrapped(): words into lines with a budget each."""
    room = f"greatest(4, floor({budgets}[least(len(s.ls), len({budgets}))] * {expansion})::INT)"
    last = "s.ls[len(s.ls)]"
    put = f"list_append(s.ls[1:len(s.ls) - 1], CASE WHEN {last} = '' THEN w ELSE {last} || ' ' || w END)"
    fold = f"list_reduce({words}, lambda s, w: CASE WHEN {last} = '' OR length({last}) + 1 + length(w) <= {room} OR len(s.ls) >= {count} THEN struct_pack(ls := {put}) ELSE struct_pack(ls := list_append(s.ls, w)) END, struct_pack(ls := ['']))"
    if exact:
        return f"array_to_string(list_concat({fold}.ls, list_transform(generate_series(1, greatest({count} - len({fold}.ls), 0)), lambda i: '')), chr(10))"
    return f"array_to_string(list_filter({fold}.ls, lambda x: x <> ''), chr(10))"


WRAPS = f"""b AS (SELECT doc_id, side, page, block_no, array_to_string(texts, ' ') AS t, list_transform(texts, lambda x: length(x)) AS lens, len(texts)::INT AS n, list_filter(string_split(array_to_string(texts, ' '), ' '), lambda w: w <> '') AS ws FROM lob)"""


@q(f"""WITH {LINES}, {LOB}, {WRAPS} SELECT doc_id, side, page, block_no, CASE WHEN len(ws) = 0 OR n <= 1 THEN trim(t) ELSE {wrap_sql('ws', 'lens', 'n', 1.25, True)} END AS exact,
 CASE WHEN len(ws) = 0 OR n <= 1 THEN trim(t) ELSE {wrap_sql('ws', 'lens', 'n', 0.5, False)} END AS tight FROM b""")
def rewrap_lines(s, d):
    b = scan.blocks_of_lines(lines_df(s, d))
    lens, n = F.transform("texts", lambda x: F.length(x)), F.size("texts")
    return b.select("doc_id", "side", "page", "block_no", text.rewrapped(F.col("text"), lens, n, 1.25, True).alias("exact"), text.rewrapped(F.col("text"), lens, n, 0.5, False).alias("tight"))


def adapted_sql() -> str:
    t = squeeze("translated")
    ws = f"list_filter(string_split({t}, ' '), lambda w: w <> '')"
    wrap = lambda e: f"CASE WHEN n <= 1 THEN {t} ELSE {wrap_sql(ws, 'lens', 'n', e, True)} END"
    return f"CASE WHEN {t} = '' THEN t WHEN tl THEN {wrap(1.08)} ELSE {wrap(1.25)} END"


@q(f"""WITH {LINES}, {LOB}, b AS (SELECT doc_id, page, block_no, array_to_string(texts, ' ') AS t, list_transform(texts, lambda x: length(x)) AS lens, len(texts)::INT AS n, {TABLE_LIKE} AS tl,
 lower(array_to_string(texts, '  ')) || CASE WHEN block_no % 3 = 0 THEN '' ELSE ' ok' END AS translated FROM lob WHERE side = 'orig'), a AS (SELECT *, {adapted_sql()} AS adapted FROM b)
SELECT doc_id, page, block_no, adapted FROM a WHERE adapted <> '' AND adapted <> t""")
def translation_changes(s, d):
    b = scan.blocks_of_lines(lines_df(s, d).where("side = 'orig'"))
    tr = F.concat(F.lower(F.array_join("texts", "  ")), F.when(F.col("block_no") % 3 == 0, "").otherwise(" ok"))
    a = batching.adapted_layout(tr, F.col("text"), F.transform("texts", lambda x: F.length(x)), F.col("table_like"), "hybrid")
    return b.select("doc_id", "page", "block_no", "text", a.alias("adapted")).where("adapted <> '' and adapted <> text").drop("text")


def fit_sql() -> str:
    comp = "trim(replace(replace(t, ' ,', ','), ' .', '.'))"
    avg = "greatest(8, floor(list_sum(lens) / greatest(n, 1))::INT)"
    ws = f"list_filter(string_split({comp}, ' '), lambda w: w <> '')"
    out = ["t", comp]
    for more in (0, 1, 2):
        room = f"list_concat(lens, [{', '.join([avg] * more)}])" if more else "lens"
        out.append(f"CASE WHEN tl THEN NULL WHEN n + {more} <= 1 THEN {comp} ELSE trim({wrap_sql(ws, room, f'(n + {more})', 1.1, True)}) END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL AND x <> '')"


@q(f"""WITH {LINES}, {LOB}, b AS (SELECT doc_id, side, page, block_no, array_to_string(texts, ' ') AS t, list_transform(texts, lambda x: length(x)::BIGINT) AS lens, len(texts)::INT AS n, {TABLE_LIKE} AS tl, line_height FROM lob),
f AS (SELECT *, {fit_sql()} AS v, greatest(1.0, least(1.9, line_height / 10.0)) AS ratio FROM b)
SELECT doc_id, side, page, block_no, (SELECT count(DISTINCT x) FROM (SELECT unnest(v) AS x)) AS variants, v[1] AS first, len(list_distinct(list_transform([1.0, 0.96, 0.92, 0.88, 0.84, 0.8, 0.76], lambda k: greatest(0.75, least(1.6, ratio * k)))))::INT AS heights,
 round(greatest(4.0, 5.0, 10.0 * 0.58), 6)::DOUBLE AS smallest, round(greatest(2.2, least(greatest(4.0, 5.0, 10.0 * 0.58), 10.0 * 0.22)), 6)::DOUBLE AS hardest FROM f""")
def fit_plan(s, d):
    b = scan.line_height_ratio(scan.blocks_of_lines(lines_df(s, d)).withColumn("size", F.lit(10.0)))
    v = batching.fit_variants(F.col("text"), F.transform("texts", lambda x: F.length(x)), F.col("table_like"), "hybrid")
    small, hard = batching.smallest_size(F.col("size"), F.col("table_like"), "hybrid", 0.65, 5.0)
    return b.select(
        "doc_id", "side", "page", "block_no", F.size(v).cast("long").alias("variants"), F.get(v, 0).alias("first"),
        F.size(batching.line_heights(F.col("ratio"), "hybrid")).alias("heights"), F.round(small, 6).alias("smallest"), F.round(hard, 6).alias("hardest"),
    )


REPLIES = """e AS (SELECT DISTINCT entry_id, doc_id, translated FROM ocr_entry WHERE translated IS NOT NULL),
g AS (SELECT doc_id, list(translated ORDER BY entry_id, translated) AS ts FROM e GROUP BY ALL), p AS (SELECT doc_id, len(ts)::INT AS expected, (doc_id % 5)::INT AS m, ts FROM g),
rp AS (SELECT doc_id, expected, CASE WHEN m = 4 THEN '```json' || chr(10) ELSE '' END || array_to_string(list_transform(ts, lambda t, k: CASE WHEN m = 3 OR (m = 1 AND k = expected) THEN '' ELSE '[' || CASE WHEN m = 2 AND k > 1 THEN k - 1 ELSE k END || '] ' END
 || CASE WHEN m = 4 THEN '"**' || t || '**"' ELSE t END), chr(10)) || CASE WHEN m = 4 THEN chr(10) || '```' ELSE '' END AS reply FROM p)"""


def replies(s, d):
    """One reply per document, built from its entries: by rule well formed, a label missing, doubled, none, or fenced."""
    e = table(s, d, "ocr_entry").select("entry_id", "doc_id", "translated").distinct().where("translated is not null")
    g = e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "translated"))), lambda x: x["translated"]).alias("ts"))
    g = g.withColumn("m", (F.col("doc_id") % 5).cast("int")).withColumn("expected", F.size("ts"))
    label = lambda k: F.when((F.col("m") == 1) & (k + 1 == F.col("expected")), F.lit("")).otherwise(F.concat(F.lit("["), (F.when((F.col("m") == 2) & (k > 0), k).otherwise(k + 1)).cast("string"), F.lit("] ")))
    body = F.array_join(F.transform("ts", lambda t, k: F.concat(F.when(F.col("m") == 3, "").otherwise(label(k)), F.when(F.col("m") == 4, F.concat(F.lit('"**'), t, F.lit('**"'))).otherwise(t))), "\n")
    return g.select("doc_id", "expected", F.when(F.col("m") == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("reply"))


def cleaned_sql(t: str) -> str:
    c = f"replace(replace(regexp_replace({t}, '```[a-z]*\\n?', '', 'g'), '**', ''), '__', '')"
    return f"regexp_replace(CASE WHEN length({c}) > 2 AND regexp_matches({c}, '^[\"''“]') AND regexp_matches({c}, '[\"''”]$') AND NOT suffix({c}, chr(10)) THEN substr({c}, 2, length({c}) - 2) ELSE {c} END, '^{WS}|{WS}$', '', 'g')"


# A reply cut at its labels: what follows the k-th label is the k-th part.
PARSED = f"""{REPLIES}, lb AS (SELECT *, list_transform(regexp_extract_all(reply, '\\[(\\d+)\\]', 1), lambda x: try_cast(x AS BIGINT)) AS ls, list_transform(regexp_split_to_array(reply, '\\[\\d+\\]')[2:], lambda x: {cleaned_sql("x")}) AS xs,
 list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(regexp_replace(trim(x), '^\\[\\d+\\]\\s*', ''))), lambda x: x <> '') AS lines FROM rp),
pd AS (SELECT doc_id, expected, CASE WHEN len(ls) >= expected AND len(list_filter(generate_series(1, expected), lambda k: NOT list_contains(ls, k))) = 0
 THEN list_transform(generate_series(1, expected), lambda k: xs[len(ls) + 1 - list_position(list_reverse(ls), k)])
 WHEN len(lines) = expected THEN list_transform(lines, lambda x: {cleaned_sql("x")}) END AS parts FROM lb)"""


@q(f"WITH {PARSED} SELECT doc_id, expected, array_to_string(parts, chr(31)) AS parts FROM pd")
def parse_batch_reply(s, d):
    r = replies(s, d)
    return r.select("doc_id", "expected", F.array_join(text.parsed_reply(F.col("reply"), F.col("expected")), "\x1f").alias("parts"))


@q(f"""WITH {PARSED}, rq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry_id, original, translated) AS ordinal, entry_id, original AS text FROM (SELECT DISTINCT entry_id, doc_id, original, translated FROM ocr_entry WHERE translated IS NOT NULL))
SELECT entry_id, ordinal::INT AS ordinal, coalesce(parts[ordinal], text) AS translated FROM rq LEFT JOIN pd USING (doc_id)""")
def answered_requests(s, d):
    w = Window.partitionBy("doc_id").orderBy("entry_id", "original", "translated")
    e = table(s, d, "ocr_entry").select("entry_id", "doc_id", "original", "translated").where("translated is not null").distinct()
    rq = e.select("doc_id", "entry_id", F.col("original").alias("text"), F.row_number().over(w).alias("ordinal"))
    r = replies(s, d)
    p = r.select("doc_id", text.parsed_reply(F.col("reply"), F.col("expected")).alias("parts")).where("parts is not null")
    return batching.answered(rq, p, ["doc_id"]).select("entry_id", "ordinal", "translated")


CLEAN = r"""regexp_replace(replace(replace(regexp_replace(t, '```[a-z]*\n?', '', 'g'), '**', ''), '__', ''), 'x^', '')"""


@q(f"""WITH e AS (SELECT DISTINCT entry_id, coalesce(CASE entry_id % 4 WHEN 0 THEN '```text' || chr(10) || translated || chr(10) || '```' WHEN 1 THEN '"' || translated || '"' WHEN 2 THEN '**' || translated || '**' ELSE translated END, '') AS t FROM ocr_entry),
c AS (SELECT entry_id, {CLEAN} AS t FROM e)
SELECT entry_id, regexp_replace(CASE WHEN length(t) > 2 AND regexp_matches(t, '^["''“]') AND regexp_matches(t, '["''”]$') AND NOT suffix(t, chr(10)) THEN substr(t, 2, length(t) - 2) ELSE t END, '^{WS}|{WS}$', '', 'g') AS cleaned FROM c""")
def clean_reply(s, d):
    e = table(s, d, "ocr_entry").select("entry_id", "translated").distinct()
    k, t = F.col("entry_id") % 4, F.col("translated")
    raw = F.when(k == 0, F.concat(F.lit("```text\n"), t, F.lit("\n```"))).when(k == 1, F.concat(F.lit('"'), t, F.lit('"'))).when(k == 2, F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
    return e.select("entry_id", text.clean_reply(raw).alias("cleaned")).distinct()


@q(r"""WITH b AS (SELECT DISTINCT name || CASE doc_id % 3 WHEN 0 THEN ': a/b?' WHEN 1 THEN ' – x' ELSE '' END AS n FROM book)
SELECT n AS name, substr(trim(translate(n, '<>:"/\|?*', '')), 1, 200) AS safe, regexp_replace(n, '\s*[-–—]\s*', ' - ', 'g') AS title FROM b""")
def sanitize_name(s, d):
    k = F.col("doc_id") % 3
    b = table(s, d, "book").select(F.concat("name", F.when(k == 0, ": a/b?").when(k == 1, " – x").otherwise("")).alias("name")).distinct()
    return b.select("name", text.safe_name(F.col("name")).alias("safe"), text.dashed_title(F.col("name")).alias("title"))


@q(f"""WITH {BLOCKS}, w AS (SELECT DISTINCT text, {squeeze('text')} AS t FROM blocks WHERE side = 'orig')
SELECT text FROM w WHERE t <> '' AND NOT regexp_matches(t, '{SIGNS}') AND {LETTERS} >= 1 AND NOT ({LETTERS} = 1 AND length(t) < 3)
 AND text NOT IN (SELECT trim(original) FROM ocr_entry WHERE original IS NOT NULL)""")
def cache_misses(s, d):
    memory = table(s, d, "ocr_entry").select(F.lit("default").alias("model"), F.col("original").alias("source_text")).where("source_text is not null").distinct()
    return batching.cache_misses(blocks_df(s, d).where("side = 'orig'").select("text"), memory)


@q(f"""WITH {BLOCKS}, m AS (SELECT trim(original) AS k, min(translated) AS t FROM ocr_entry WHERE original IS NOT NULL GROUP BY ALL)
SELECT block_id, coalesce(m.t, text) AS translated FROM blocks LEFT JOIN m ON m.k = text""")
def cache_lookup(s, d):
    memory = table(s, d, "ocr_entry").where("original is not null").select(F.lit("default").alias("model"), F.trim("original").alias("source_text"), F.col("translated").alias("target_text"))
    return batching.looked_up(blocks_df(s, d), memory).select("block_id", "translated")


@q(f"""WITH {BLOCKS}, g AS (SELECT doc_id, page, list(text ORDER BY block_no, block_id) AS ts FROM blocks WHERE side = 'orig' GROUP BY ALL)
SELECT doc_id, page, md5('Translate each numbered text to Português Brasileiro. Keep the numbers.' || chr(10) || array_to_string(list_transform(ts, lambda t, k: '[' || k || '] ' || t), chr(10))) AS digest FROM g""")
def request_prompts(s, d):
    g = blocks_df(s, d).where("side = 'orig'").groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block_id", "text"))), lambda x: x["text"]).alias("ts"))
    return g.select("doc_id", "page", F.md5(batching.batch_prompt(F.col("ts"), "Português Brasileiro")).alias("digest"))


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


@q(f"""WITH e AS (SELECT DISTINCT entry_id, original, {strip_sql("coalesce(translated, '')")} AS t, x0, y0, x1, y1 FROM ocr_entry)
SELECT entry_id, x0, y0, x1, y1, greatest(1, len(list_filter(string_split(original, chr(10)), lambda x: {strip_sql('x')} <> '')))::BIGINT AS source_line_count FROM e
WHERE t <> '' AND t <> {strip_sql("coalesce(original, '')")} AND x1 - x0 >= 5 AND y1 - y0 >= 5""")
def ocr_entries(s, d):
    e = table(s, d, "ocr_entry").select("entry_id", "original", "translated", "x0", "y0", "x1", "y1").distinct()
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pts = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    return scan.ocr_entries(e.withColumn("points", pts)).drop("original", "translated")


# What the logs of the tables write where the translation log has its own words for it.
TIME = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"
OPENS, ENDS = r"Arquivo aberto: (\S+\.pdf)", r"Livro concluído: (\S+\.pdf)"
HERE = {"begin": OPENS, "open": TIME + ".*" + OPENS, "saved": TIME + ".*" + ENDS, "done": ENDS}
STAMP = f"try_cast(replace(regexp_extract(text, '{{}}', 1), 'T', ' ') AS TIMESTAMP)"
_KIND = lambda k, p, two: f"SELECT log_id, line_no, '{k}' AS kind, trim(regexp_extract(text, '{p}', {2 if two else 1})) AS name, {STAMP.format(p) if two else 'NULL::TIMESTAMP'} AS ts FROM tx WHERE regexp_matches(text, '{p}')"
LOGS = "tx AS (SELECT DISTINCT log_id, line_no, text FROM log_line WHERE text IS NOT NULL), ll AS (" + " UNION ALL ".join(_KIND(k, p, k in ("open", "saved")) for k, p in HERE.items()) + ")"


def logs(s, d):
    return lineage.log_events(table(s, d, "log_line"), HERE)


@q(f"WITH {LOGS} SELECT log_id, line_no, kind, name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM ll")
def log_events(s, d):
    return logs(s, d).select("log_id", "line_no", "kind", "name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@q(f"""WITH {LOGS}, g AS (SELECT *, coalesce(sum((kind = 'done')::INT) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM ll),
f AS (SELECT *, last_value(CASE WHEN kind = 'begin' THEN name END IGNORE NULLS) OVER (PARTITION BY log_id, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM g)
SELECT log_id, name AS target, src AS source FROM f WHERE kind = 'done' AND src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id, name ORDER BY line_no DESC) = 1""")
def log_mapping_validator(s, d):
    return lineage.strict_mapping(logs(s, d))


OPENED = f"{LOGS}, f AS (SELECT *, last_value(CASE WHEN kind = 'open' THEN name END IGNORE NULLS) OVER w AS src, last_value(CASE WHEN kind = 'open' THEN ts END IGNORE NULLS) OVER w AS t0 FROM ll WINDOW w AS (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@q(f"WITH {OPENED} SELECT log_id, name AS target, src AS source FROM f WHERE kind = 'done' AND src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id, name ORDER BY line_no DESC) = 1")
def log_mapping_server(s, d):
    return lineage.mapping(logs(s, d))


TIMES = f"{OPENED}, tm AS (SELECT log_id, src AS source, (epoch_us(ts) - epoch_us(t0)) / 1e6 AS seconds FROM f WHERE kind = 'saved' AND src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id, src ORDER BY line_no DESC) = 1)"


@q(f"""WITH {TIMES}, s AS (SELECT *, greatest(floor(seconds)::BIGINT, 0) AS z FROM tm) SELECT log_id, source, round(seconds, 3) AS seconds,
 CASE WHEN z >= 3600 THEN (z // 3600) || 'h' || lpad((z % 3600 // 60)::VARCHAR, 2, '0') || 'm' ELSE (z // 60) || 'm' || lpad((z % 60)::VARCHAR, 2, '0') || 's' END AS shown FROM s""")
def timings(s, d):
    return lineage.timings(logs(s, d)).select("log_id", "source", F.round("seconds", 3).alias("seconds"), text.duration(F.col("seconds")).alias("shown"))


PER_BOOK = "pb AS (SELECT source, max(seconds) AS seconds FROM tm GROUP BY ALL)"
PACE = f"""{TIMES}, {PER_BOOK}, b AS (SELECT DISTINCT name, coalesce(size_bytes, 0) AS size_bytes FROM book WHERE stage = 'traduzidos'), j AS (SELECT b.*, pb.seconds FROM b LEFT JOIN pb ON pb.source = replace(b.name, 'doc_', 'b')),
pace AS (SELECT coalesce(sum(seconds), 0.0) AS seconds, coalesce(sum(size_bytes / 1048576.0) FILTER (seconds <> 0), 0.0) AS megabytes FROM j)"""


def pace(s, d):
    """Seconds and megabytes of all timed outputs, the longest timing of a source in any log holding."""
    b = queueing.listing(table(s, d, "book"), "traduzidos")
    t = lineage.timings(logs(s, d)).groupBy("source").agg(F.max("seconds").alias("seconds"))
    j = b.select("name", "size_bytes").distinct().join(t, F.replace("name", F.lit("doc_"), F.lit("b")) == F.col("source"), "left")
    return lineage.throughput(j)


@q(f"WITH {PACE} SELECT round(seconds, 3) AS seconds, round(megabytes, 6) AS megabytes FROM pace")
def throughput(s, d):
    return pace(s, d).select(F.round("seconds", 3).alias("seconds"), F.round("megabytes", 6).alias("megabytes"))


@q("SELECT count(DISTINCT name) FILTER (stage = 'traduzidos') AS completed, count(DISTINCT name) FILTER (stage = 'queue') AS waiting, count(DISTINCT name) FILTER (stage = 'traduzindo') AS working, count(DISTINCT name) FILTER (stage = 'traduzidos') + count(DISTINCT name) FILTER (stage = 'queue') + count(DISTINCT name) FILTER (stage = 'traduzindo') AS total FROM book")
def unit_totals(s, d):
    return lineage.unit_totals(table(s, d, "book"))


@q(f"""WITH {PACE}, w AS (SELECT sum(size_bytes / 1048576.0) AS mb FROM (SELECT DISTINCT name, coalesce(size_bytes, 0) AS size_bytes, mtime FROM book WHERE stage = 'queue' AND suffix(lower(name), '.pdf'))),
c AS (SELECT coalesce(size_bytes, 0) / 1048576.0 AS size_mb, epoch_us(mtime) // 1000000 AS started FROM book WHERE stage = 'traduzindo' ORDER BY mtime DESC NULLS LAST, name DESC LIMIT 1),
x AS (SELECT pace.seconds / nullif(pace.megabytes, 0) AS per, mb, size_mb, (SELECT max(epoch_us(mtime)) // 1000000 FROM book) + 3600 AS as_of, started FROM pace, w, c),
y AS (SELECT *, mb * per + greatest(0.0, size_mb * per - (as_of - started)) AS s FROM x)
SELECT round(per, 4) AS seconds_per_mb, round(s, 2) AS remaining_seconds, CASE WHEN s IS NULL THEN 'Calculando...' WHEN s >= 3600 THEN (floor(s)::BIGINT // 3600) || 'h' || lpad((floor(s)::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || 'm' ELSE (floor(s)::BIGINT // 60) || 'm' || lpad((floor(s)::BIGINT % 60)::VARCHAR, 2, '0') || 's' END AS eta,
 coalesce(strftime(make_timestamp((as_of + floor(s)::BIGINT) * 1000000), '%d/%m %H:%M'), '--') AS finish, (as_of - started)::BIGINT AS elapsed_seconds FROM y""")
def progress_estimate(s, d):
    b = table(s, d, "book")
    as_of = F.timestamp_seconds(F.lit(b.agg(F.unix_timestamp(F.max("mtime")) + 3600).first()[0]).cast("bigint"))
    mb = queueing.listing(b, "queue").agg(F.sum(F.col("size_bytes") / 1048576.0).alias("megabytes"))
    c = b.where("stage = 'traduzindo'").orderBy(F.col("mtime").desc_nulls_last(), F.col("name").desc()).limit(1)
    c = c.select((F.coalesce("size_bytes", F.lit(0)) / 1048576.0).alias("size_mb"), F.col("mtime").alias("started"), F.lit(0).alias("page"), F.lit(0).alias("pages"))
    e = lineage.estimate(pace(s, d), mb, c, as_of)
    return e.select(F.round("seconds_per_mb", 4).alias("seconds_per_mb"), F.round("remaining_seconds", 2).alias("remaining_seconds"), "eta", "finish", "elapsed_seconds")


@q("""WITH s AS (SELECT * FROM (VALUES ('running'), ('paused'), ('completed'), ('idle'), (NULL)) a(status), (VALUES (true), (false)) b(alive), (VALUES ('run'), ('pause'), (NULL)) c(command))
SELECT *, CASE WHEN alive AND command = 'pause' THEN 'paused' WHEN NOT alive THEN 'idle' ELSE coalesce(status, 'idle') END AS shown FROM s""")
def effective_status(s, d):
    rows = [(a, b, c) for a in ("running", "paused", "completed", "idle", None) for b in (True, False) for c in ("run", "pause", None)]
    x = s.createDataFrame(rows, "status string, alive boolean, command string")
    return x.withColumn("shown", lineage.effective_status(F.col("status"), F.col("alive"), F.col("command")))


@q(f"""WITH {OPENED}, a AS (SELECT name AS target, max(src) AS source FROM f WHERE kind = 'done' AND src IS NOT NULL GROUP BY ALL),
m AS (SELECT translated_name AS target, max(original_name) AS source FROM manual_mapping GROUP BY ALL)
SELECT coalesce(m.target, a.target) AS target, coalesce(m.source, a.source) AS source FROM a FULL JOIN m ON a.target = m.target""")
def mapping_override(s, d):
    f = lineage._filled(logs(s, d), F.when(F.col("kind") == "open", F.col("name"))).where("kind = 'done' and last is not null")
    manual = table(s, d, "manual_mapping").select(F.col("translated_name").alias("target"), F.col("original_name").alias("source"))
    return lineage.overridden(f.select(F.col("name").alias("target"), F.col("last").alias("source")), manual)


@q(f"""WITH {LOGS} SELECT log_id, line_no, kind, name FROM ll WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY ts DESC, line_no DESC, kind DESC, name DESC) = 1""")
def latest_line(s, d):
    return queueing.latest_by(logs(s, d).where("ts is not null"), ["log_id"], ["ts", "line_no"]).select("log_id", "line_no", "kind", "name")


LISTED = "(SELECT DISTINCT name, coalesce(size_bytes, 0) AS size_bytes, mtime FROM book WHERE stage = '{}' AND suffix(lower(name), '.pdf'))"
MARKS = " OR ".join(f"contains(n, '{m}')" for m in text.QUEUE_MARKS)
AGAIN = "SELECT DISTINCT name FROM book WHERE stage = 'queue' AND doc_id % 13 = 0"
WAITING = f"""qq AS {LISTED.format('queue')}, dd AS {LISTED.format('original')}, ag AS ({AGAIN}),
wait AS (SELECT qq.*, name IN (SELECT name FROM ag) AS again FROM (SELECT *, lower(regexp_replace(name, '\\.[pP][dD][fF]$', '')) AS n FROM qq) qq
 WHERE name IN (SELECT name FROM ag) OR (name NOT IN (SELECT name FROM dd) AND NOT ({MARKS})))"""


def waiting(s, d):
    b = table(s, d, "book")
    return queueing.waiting(b, b.where("stage = 'queue' and doc_id % 13 = 0").select("name"))


@q(f"WITH {WAITING} SELECT name, size_bytes, again, row_number() OVER (ORDER BY again DESC, size_bytes, name)::INT AS place FROM wait")
def queue_order(s, d):
    return queueing.ordered(waiting(s, d)).select("name", "size_bytes", "again", "place")


@q(f"""WITH {WAITING}, cu AS (SELECT DISTINCT name, (doc_id % 10)::INT AS rank FROM book WHERE doc_id % 10 < 4)
SELECT name, again, row_number() OVER (ORDER BY again DESC, coalesce(rank, 999999), name)::INT AS place FROM wait LEFT JOIN cu USING (name)""")
def queue_custom(s, d):
    custom = table(s, d, "book").where("doc_id % 10 < 4").select("name", (F.col("doc_id") % 10).cast("int").alias("rank")).distinct()
    return queueing.ordered(waiting(s, d), "custom", custom).select("name", "again", "place")


@q(f"SELECT name, size_bytes, mtime, row_number() OVER (ORDER BY mtime DESC NULLS LAST, lower(name) DESC, name DESC)::INT AS place FROM {LISTED.format('traduzidos')}")
def file_listing(s, d):
    return queueing.named(table(s, d, "book"), "traduzidos", "mtime_desc")


@q(f"SELECT name, size_bytes, mtime, row_number() OVER (ORDER BY lower(name), name, mtime, size_bytes)::INT AS place FROM {LISTED.format('original')}")
def name_listing(s, d):
    return queueing.named(table(s, d, "book"), "original")


@q(f"SELECT name, size_bytes, mtime FROM {LISTED.format('original')} WHERE name = (SELECT min(name) FROM book WHERE stage = 'original')")
def rerun_book(s, d):
    b = table(s, d, "book")
    return queueing.rerun(b, b.where("stage = 'original'").agg(F.min("name")).first()[0] or "")


EVENT_SQL = "ev AS (SELECT 'doc_' || regexp_extract(name, '\\d+') || '.pdf' AS name, log_id, line_no, CASE kind WHEN 'open' THEN 'start' ELSE 'finish' END AS event FROM ll WHERE kind IN ('open', 'saved'))"


@q(f"""WITH {LOGS}, {EVENT_SQL}, la AS (SELECT name, arg_max(event, (log_id, line_no, CASE event WHEN 'finish' THEN 3 ELSE 1 END)) AS event FROM ev GROUP BY ALL), b AS (SELECT name, min(stage) AS was, max((stage = 'original')::INT) AS kept FROM book WHERE name IS NOT NULL GROUP BY ALL)
SELECT name, CASE WHEN kept = 1 OR event = 'finish' THEN 'original' WHEN event = 'start' THEN 'traduzindo' WHEN event IS NOT NULL THEN 'queue' ELSE was END AS stage, was FROM b LEFT JOIN la USING (name)""")
def stage_transitions(s, d):
    e = logs(s, d).where("kind in ('open', 'saved')")
    e = e.select(F.concat(F.lit("doc_"), F.regexp_extract("name", r"\d+", 0), F.lit(".pdf")).alias("name"), F.struct("log_id", "line_no").alias("at"), F.when(F.col("kind") == "open", "start").otherwise("finish").alias("event"))
    return queueing.transitions(table(s, d, "book").where("name is not null"), e)


@q(f"SELECT DISTINCT name FROM {LISTED.format('traduzindo')} WHERE NOT suffix(lower(name), '_pt.pdf') AND name NOT IN (SELECT name FROM {LISTED.format('queue')})")
def recovered_books(s, d):
    return queueing.recovered(table(s, d, "book"), False)


@q(f"""WITH {BLOCKS}, w AS (SELECT DISTINCT text, {squeeze('text')} AS t FROM blocks WHERE side = 'orig')
SELECT text, regexp_replace(replace(replace('»' || text, '**', ''), '__', ''), '^{WS}|{WS}$', '', 'g') AS translated FROM w WHERE t <> '' AND NOT regexp_matches(t, '{SIGNS}') AND {LETTERS} >= 1 AND NOT ({LETTERS} = 1 AND length(t) < 3)""")
def batch_translate(s, d):
    return translate.misses(blocks_df(s, d).where("side = 'orig'").select("text"), lambda: translate.Asked(translate.EchoAsk()))


@q(f"""WITH b AS (SELECT DISTINCT name, regexp_replace(regexp_replace(name, '(?i)\\.pdf$', ''), '\\s*[-–—]\\s*', ' - ', 'g') AS t FROM book WHERE name IS NOT NULL), n AS (SELECT name, t, lower(t) AS n FROM b)
SELECT name, left(trim(translate(CASE WHEN {" OR ".join(f"contains(n, '{m}')" for m in text.NAME_MARKS)} THEN t ELSE '»' || t END || ' traduzido.pdf', '<>:"/\\|?*', '')), 200) AS output FROM n""")
def output_names(s, d):
    return translate.titled(table(s, d, "book").where("name is not null"), lambda: translate.Asked(translate.EchoAsk()))


@q("""WITH b AS (SELECT DISTINCT doc_id, side, page, dominant_font AS f FROM text_block), m AS (SELECT config_id, validation_mode AS mode FROM config_set)
SELECT config_id, mode, 'structural' AS layout, 'legacy' AS image FROM m UNION ALL SELECT 100, ' Hybrid ', 'hybrid', 'legacy' UNION ALL SELECT 101, 'AI_Rebuild', 'structural', 'ai_rebuild'""")
def mode_resolution(s, d):
    c = table(s, d, "config_set").select("config_id", F.col("validation_mode").alias("mode")).unionByName(s.createDataFrame([(100, " Hybrid "), (101, "AI_Rebuild")], "config_id int, mode string"))
    return c.select("config_id", "mode", batching.layout_mode(F.col("mode")).alias("layout"), batching.image_mode(F.col("mode"), F.lit(False)).alias("image"))


@q()
def image_text_fit(s, d):
    """Image texts in lines of their box, and the first fitting size; the text fit is a stand-in, so there is no SQL."""
    e = table(s, d, "ocr_entry").select("entry_id", "translated", "source_line_count", "x0", "y0", "x1", "y1").where("translated is not null").distinct()
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ls = batching.image_lines(F.col("translated"), w / 5.0, F.coalesce("source_line_count", F.lit(1)).cast("int"), True)
    fit = batching.fitted_text(F.array(F.col("translated"), F.array_join("ls", "\n")), F.array(F.lit(1.2), F.lit(1.0)), F.lit(12.0), F.lit(5.0), F.lit(0.4), w, h)
    return e.withColumn("ls", ls).select("entry_id", F.size("ls").alias("line_count"), fit["size"].alias("size"), fit["line_height"].alias("line_height"), images.drawn_size(F.col("ls"), w, h, F.lit(24)).alias("drawn"))


@q(f"SELECT name, mtime FROM {LISTED.format('traduzindo')} ORDER BY mtime DESC NULLS LAST, name DESC LIMIT 1")
def latest_preview(s, d):
    return queueing.listing(table(s, d, "book"), "traduzindo").orderBy(F.col("mtime").desc_nulls_last(), F.col("name").desc()).limit(1).select("name", "mtime")


@q(f"""WITH b AS (SELECT DISTINCT name, lower(name) AS n FROM book) SELECT name, ({MARKS}) AS queue_mark, ({" OR ".join(f"contains(n, '{m}')" for m in text.NAME_MARKS)}) AS name_mark FROM b""")
def name_filter(s, d):
    b = table(s, d, "book").select("name").distinct()
    return b.select("name", text.marked(F.col("name"), text.QUEUE_MARKS).alias("queue_mark"), text.marked(F.col("name"), text.NAME_MARKS).alias("name_mark"))


@q("SELECT stage, count(DISTINCT name) AS books FROM book GROUP BY ALL")
def stage_counts(s, d):
    return table(s, d, "book").groupBy("stage").agg(F.count_distinct("name").alias("books"))


@q(f"SELECT o.name FROM {LISTED.format('traduzidos')} o WHERE o.name NOT IN (SELECT name FROM book WHERE doc_id % 3 = 0 AND name IS NOT NULL)")
def pending_validation(s, d):
    b = table(s, d, "book")
    return queueing.pending(queueing.listing(b, "traduzidos"), b.where("doc_id % 3 = 0").select("name")).select("name")


@q(f"""WITH {TIMES}, o AS {LISTED.format('traduzidos')}, n AS (SELECT max(translated_name) AS source, original_name AS name FROM manual_mapping GROUP BY ALL)
SELECT o.name, n.source, round(t.seconds, 3) AS seconds, CASE WHEN regexp_extract(o.name, '\\d+')::INT % 2 = 0 THEN 'PASS' END AS result FROM o LEFT JOIN n USING (name) LEFT JOIN (SELECT source, max(seconds) AS seconds FROM tm GROUP BY ALL) t ON t.source = n.source""")
def books_overview(s, d):
    b = table(s, d, "book")
    o = queueing.listing(b, "traduzidos")
    names = table(s, d, "manual_mapping").groupBy(F.col("original_name").alias("target")).agg(F.max("translated_name").alias("source"))
    t = lineage.timings(logs(s, d)).groupBy("source").agg(F.max("seconds").alias("seconds"))
    reports = o.where(F.regexp_extract("name", r"\d+", 0).cast("int") % 2 == 0).select("name", F.lit("PASS").alias("result")).distinct()
    return queueing.overview(o, names, t, reports).select("name", "source", F.round("seconds", 3).alias("seconds"), "result")


@q("""SELECT 'doc_' || doc_id || '.pdf' AS name, CASE WHEN n % 10 < 8 THEN 'PASS' ELSE 'FAIL' END AS result, (n % 101)::INT AS rate FROM (SELECT doc_id, count(*) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id + 1000000, length(text) FROM documents WHERE text IS NOT NULL) WHERE doc_id IS NOT NULL""")
def report_blocks(s, d):
    docs = table(s, d, "documents").where("doc_id is not null")
    r = docs.groupBy("doc_id").agg(F.count("*").alias("n")).unionByName(docs.where("text is not null").select((F.col("doc_id") + 1000000).alias("doc_id"), F.length("text").cast("long").alias("n")))
    res = F.when(F.col("n") % 10 < 8, "PASS").otherwise("FAIL")
    t = F.format_string("\n[x] VALIDATING: doc_%d.pdf\nlines\nRESULT: %s (rate=%d%%)\n", F.col("doc_id"), res, F.col("n") % 101)
    whole = r.groupBy((F.col("doc_id") % 50).alias("file")).agg(F.array_join(F.collect_list(t), "=" * 60).alias("value"))
    return lineage.report_blocks(whole)


TIERS = "CASE WHEN ram >= 48 THEN 2048 WHEN ram >= 32 THEN 1024 WHEN ram >= 16 THEN 512 ELSE 256 END"


@q(f"""SELECT ram, {TIERS}::INT AS num_batch, greatest(8192, CASE WHEN ram >= 48 THEN 32768 WHEN ram >= 24 THEN 16384 ELSE 0 END)::INT AS num_ctx,
 least(greatest(ram * 20, 60), 1800)::INT AS timeout_s, least(greatest(ram // 4, 1), 12)::INT AS radius FROM (SELECT unnest(generate_series(0, 128, 4))::INT AS ram)""")
def resource_tiers(s, d):
    ram = F.col("ram")
    batch = F.when(ram >= 48, 2048).when(ram >= 32, 1024).when(ram >= 16, 512).otherwise(256)
    ctx = F.greatest(F.lit(8192), F.when(ram >= 48, 32768).when(ram >= 24, 16384).otherwise(0))
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi)).cast("int")
    return s.range(0, 129, 4).select(F.col("id").cast("int").alias("ram")).select("ram", batch.alias("num_batch"), ctx.alias("num_ctx"), clamp(ram * 20, 60, 1800).alias("timeout_s"), clamp(F.floor(ram / 4), 1, 12).alias("radius"))


@q("""WITH c AS (SELECT config_id, '{"max_batch_size": ' || max_batch_size || ', "validation_mode": "' || validation_mode || CASE WHEN config_id = 3 THEN '' ELSE '"}' END AS j FROM config_set)
SELECT config_id, CASE WHEN json_valid(j) THEN (j->>'$.max_batch_size')::INT ELSE 10 END AS max_batch_size, CASE WHEN json_valid(j) THEN j->>'$.validation_mode' ELSE '25%' END AS validation_mode, 2200 AS max_batch_chars FROM c""")
def config_merge(s, d):
    c = table(s, d, "config_set")
    end = F.when(F.col("config_id") == 3, "").otherwise('"}')
    j = F.concat(F.lit('{"max_batch_size": '), F.col("max_batch_size").cast("string"), F.lit(', "validation_mode": "'), "validation_mode", end)
    p = F.from_json(j, "max_batch_size int, validation_mode string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    ok = p["_corrupt_record"].isNull()
    return c.select("config_id", F.coalesce(F.when(ok, p["max_batch_size"]), F.lit(10)).alias("max_batch_size"), F.coalesce(F.when(ok, p["validation_mode"]), F.lit("25%")).alias("validation_mode"), F.lit(2200).alias("max_batch_chars"))


@q("""WITH b AS (SELECT DISTINCT doc_id, dominant_font AS f FROM text_block), c AS (SELECT * FROM (VALUES (1, 'Symbol'), (2, 'Courier'), (3, 'Helvetica')) t(ord, f))
SELECT doc_id, arg_min(c.f, ord) AS font FROM b JOIN c USING (f) GROUP BY ALL""")
def first_candidate(s, d):
    c = s.createDataFrame([(1, "Symbol"), (2, "Courier"), (3, "Helvetica")], "ord int, f string")
    b = table(s, d, "text_block").select("doc_id", F.col("dominant_font").alias("f")).distinct()
    return b.join(F.broadcast(c), "f").groupBy("doc_id").agg(F.min_by("f", "ord").alias("font"))
