"""Joins, windows, rules, sampling, lineage and queues on small hand-made tables."""

from pyspark.sql import functions as F

from folioscope.config import Settings
from folioscope.operators import batching, lineage, pairing, queueing, scan, validate
from folioscope.sources.tables import once, once_by_id

BLOCK = "block_id long, side string, doc_id long, page int, block_no int, text string, char_count int, avg_size double, dominant_font string, dominant_color int, x0 double, y0 double, x1 double, y1 double, extracted_at timestamp, n string"


def block(i, side, no, y, text="some text here", doc=1, page=1, x=0.0, w=100.0, h=10.0, font="Arial"):
    return (i, side, doc, page, no, text, None, 10.0, font, 0, x, y, x + w, y + h, None, "clash")


def frame(spark, rows):
    return spark.createDataFrame(rows, BLOCK)


def test_scan_counts_redelivered_rows_once_and_ignores_clashing_columns(spark):
    df = frame(spark, [block(1, "orig", 0, 0.0), block(1, "orig", 0, 0.0), block(2, "orig", 1, 20.0, "   "), block(3, "orig", 2, 40.0, None)])
    got = scan.blocks(df).collect()
    assert [(r["block_id"], r["n"]) for r in got] == [(1, 14)]


def test_once(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (2, None, 1), (2, None, 2), (None, "x", 1), (None, "x", 1)], "id int, t string, at int")
    assert sorted(map(tuple, once(df, "at").collect()), key=str) == sorted([(1, "a", 3), (2, None, 1), (None, "x", 1)], key=str)
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "x"), (None, "x"), (None, None)], "id int, t string")
    assert sorted(map(tuple, once_by_id(rows, "id").collect()), key=str) == sorted([(1, "a"), (1, "b"), (2, "c"), (None, "x"), (None, None)], key=str)
    assert once_by_id(rows.limit(0), "id").count() == 0


def test_best_overlap_takes_the_first_of_equals_and_needs_a_share(spark):
    df = scan.blocks(frame(spark, [
        block(1, "orig", 0, 0.0), block(2, "trans", 0, 0.0), block(3, "trans", 1, 0.0),  # equal scores
        block(4, "orig", 1, 100.0), block(5, "trans", 2, 108.9),  # 0.11 of the area
        block(6, "orig", 2, 200.0), block(7, "trans", 3, 208.8),  # 0.12 of it
        block(8, "orig", 3, 300.0), block(9, "trans", 4, 310.0),  # touching
    ]))
    got = {r["o_block_id"]: r["t_block_id"] for r in pairing.best_overlap(df).collect()}
    assert got[1] == 2 and 4 not in got and 8 not in got
    assert set(got) <= {1, 6}


def test_overlap_pairs(spark):
    df = scan.blocks(frame(spark, [block(k, "trans", k, k * 5.0) for k in range(4)]))
    assert [r["pairs"] for r in pairing.overlap_pairs(df).collect()] == [3]


def test_table_regions_need_rows_and_cells(spark):
    rows = [block(10 * r + c, "orig", 10 * r + c, y, x=c * 150.0) for r, y in enumerate((72.0, 92.0, 300.0)) for c in range(3)]
    got = pairing.table_cells(scan.blocks(frame(spark, rows))).groupBy("table_no").count().collect()
    assert [tuple(r) for r in got] == [(1, 6)]  # the row at 300 stands alone: three cells are no table
    assert pairing.table_cells(scan.blocks(frame(spark, rows[:3]))).count() == 0


def stats(spark, **values):
    base = {c: 0 for c in (
        "orig_blocks trans_blocks orig_block_chars trans_block_chars orig_english trans_english orig_worded trans_worded orig_lines trans_lines orig_chars trans_chars line_pairs bad_lines "
        "quality_matched unchanged corrupted_blocks extra_marks glyphs matched font_off color_off pairs orig_over_image trans_over_image orig_tables trans_tables tables_low"
    ).split()} | {"doc_id": 1, "page": 1, "orig_size": 10.0, "trans_size": 10.0} | values
    return spark.createDataFrame([tuple(base.values())], list(base))


def fired(spark, **values):
    r = validate.rules(stats(spark, **values)).first().asDict()
    return sorted(k for k, v in r.items() if v is True)


def test_rules_at_their_limits(spark):
    assert fired(spark) == []
    assert fired(spark, orig_blocks=4, trans_blocks=2) == []
    assert fired(spark, orig_blocks=5, trans_blocks=2) == ["block_count_low"]
    assert fired(spark, orig_blocks=4, trans_blocks=0) == ["block_count_low", "empty_blocks"]
    assert fired(spark, orig_blocks=3, trans_blocks=3, trans_size=6.0) == []
    assert fired(spark, orig_blocks=3, trans_blocks=3, trans_size=5.9) == ["font_too_small"]
    assert fired(spark, pairs=3) == [] and fired(spark, pairs=4) == ["overlapping"]
    assert fired(spark, orig_lines=10, trans_lines=6) == [] and fired(spark, orig_lines=10, trans_lines=17) == []
    assert fired(spark, orig_lines=10, trans_lines=18) == ["line_count_mismatch"]
    assert fired(spark, orig_chars=100, trans_chars=25) == [] and fired(spark, orig_chars=100, trans_chars=24) == ["char_ratio_bad"]
    assert fired(spark, line_pairs=20, bad_lines=8) == []
    assert fired(spark, line_pairs=20, bad_lines=9) == ["line_ratio_bad_40"]
    assert fired(spark, line_pairs=20, bad_lines=10) == ["line_ratio_bad_40", "line_ratio_bad_45"]
    assert fired(spark, trans_over_image=2) == [] and fired(spark, trans_over_image=3) == ["over_image_excess"]
    assert fired(spark, quality_matched=25, unchanged=3, corrupted_blocks=2) == []
    assert fired(spark, quality_matched=25, unchanged=4, corrupted_blocks=3) == ["corrupted", "unchanged_high"]
    assert fired(spark, quality_matched=1, extra_marks=8) == ["corrupted"] and fired(spark, extra_marks=8) == []
    assert fired(spark, orig_tables=1) == ["table_missing"] and fired(spark, tables_low=1) == ["table_content_low"]
    assert fired(spark, orig_block_chars=50) == [] and fired(spark, orig_block_chars=51, trans_block_chars=15) == ["char_count_low"]


def test_sampling(spark):
    df = spark.createDataFrame([(m, n) for m in ("all", "50%", "25%", "0", "3", "33%", "-1", "1000000") for n in (0, 1, 2, 4, 10)], "m string, n int")
    k = validate.wanted_pages(F.col("m"), F.col("n"))
    got = {(r["m"], r["n"]): r["p"] for r in df.select("m", "n", validate.sampled_pages(F.col("n"), k).alias("p")).collect()}
    assert got["all", 4] == [1, 2, 3, 4] and got["1000000", 2] == [1, 2]
    assert got["50%", 10] == [1, 3, 6, 8, 10] or got["50%", 10][0] == 1 and got["50%", 10][-1] == 10
    assert got["25%", 4] == [3] and got["0", 10] == [6] and got["33%", 10] == got["25%", 10] == [1, 10] and got["-1", 10] == [6]
    assert got["3", 10] == [1, 5, 10] and got["all", 0] == []
    for (_, n), p in got.items():
        assert p == sorted(set(p)) and all(1 <= x <= n for x in p)


def logs(spark, rows):
    return spark.createDataFrame([(1, k, k, *r) for k, r in enumerate(rows)], "log_id long, line_no long, ts0 long, kind string, name string").withColumn("ts", F.timestamp_seconds("ts0"))


def test_mappings(spark):
    ls = logs(spark, [("done", "t0"), ("begin", "a"), ("open", "a"), ("done", "t1"), ("done", "t2"), ("open", "b"), ("done", "t1"), ("begin", "c"), ("begin", "d"), ("done", "t3")])
    assert {(r["target"], r["source"]) for r in lineage.strict_mapping(ls).collect()} == {("t1", "a"), ("t3", "d")}
    assert {(r["target"], r["source"]) for r in lineage.mapping(ls).collect()} == {("t1", "b"), ("t2", "a"), ("t3", "b")}


def test_mapping_goes_over_run_borders(spark, monkeypatch):
    monkeypatch.setattr(lineage, "RUN", 3)
    ls = logs(spark, [("open", "a"), *[("x", "y")] * 10, ("done", "t"), ("done", "u")])
    assert {(r["target"], r["source"]) for r in lineage.mapping(ls).collect()} == {("t", "a"), ("u", "a")}
    strict = logs(spark, [("begin", "a"), *[("x", "y")] * 10, ("done", "t"), *[("x", "y")] * 5, ("done", "u")])
    assert {(r["target"], r["source"]) for r in lineage.strict_mapping(strict).collect()} == {("t", "a")}


def test_timings_and_overrides(spark):
    ls = logs(spark, [("open", "a"), ("x", ""), ("saved", "s"), ("open", "a"), ("saved", "s")])
    assert [tuple(r) for r in lineage.timings(ls).collect()] == [(1, "a", 1.0)]
    auto = spark.createDataFrame([("t", "a"), ("u", "b")], "target string, source string")
    manual = spark.createDataFrame([("t", "z"), ("v", "y")], "target string, source string")
    assert {tuple(r) for r in lineage.overridden(auto, manual).collect()} == {("t", "z"), ("u", "b"), ("v", "y")}
    empty = spark.createDataFrame([], "size_bytes long, seconds double")
    assert lineage.throughput(empty).first()["seconds_per_mb"] is None


def test_reports(spark):
    t = "\nVALIDATING: a.pdf\nRESULT: PASS (rate=92%)\n" + "=" * 60 + "\nVALIDATING: b.pdf\nno result\n" + "=" * 60 + "\nVALIDATING: c.pdf\nRESULT: FAIL (rate=0%)"
    got = lineage.report_blocks(spark.createDataFrame([(t,), (None,), ("",)], "value string")).collect()
    assert sorted(map(tuple, got)) == [("a.pdf", "PASS", 92), ("c.pdf", "FAIL", 0)]


def test_queue(spark):
    rows = [(n, st, s, None) for n, st, s in (("b.pdf", "queue", 5), ("a.PDF", "queue", 5), ("c.pdf", "queue", 1), ("d_pt-br.pdf", "queue", 1), ("e.pdf", "queue", 9), ("e.pdf", "traduzidos", 9), ("x.txt", "queue", 1), ("b.pdf", "queue", 5))]
    b = spark.createDataFrame(rows, "name string, stage string, size_bytes long, mtime timestamp")
    again = spark.createDataFrame([("e.pdf",), ("gone.pdf",)], "name string")
    w = queueing.waiting(b, again)
    order = lambda by, c=None: [r["name"] for r in queueing.ordered(w, by, c).orderBy("place").collect()]
    assert order("smallest_first") == ["e.pdf", "c.pdf", "a.PDF", "b.pdf"]
    assert order("largest_first") == ["e.pdf", "a.PDF", "b.pdf", "c.pdf"]
    assert order("custom", spark.createDataFrame([("b.pdf", 0)], "name string, rank int")) == ["e.pdf", "b.pdf", "a.PDF", "c.pdf"]


def test_memory(spark):
    req = spark.createDataFrame([("one two",), (" one two ",), ("12",), ("new text",), (None,)], "text string")
    mem = spark.createDataFrame([("default", "one two "), ("other", "new text")], "model string, source_text string")
    assert [r["text"] for r in batching.cache_misses(req, mem).collect()] == ["new text"]


def test_settings_merge():
    s = Settings().merged('{"max_batch_size": 3, "unknown": 1}')
    assert s.max_batch_size == 3 and s.max_batch_chars == 2200
    assert Settings().merged("{broken") == Settings() == Settings().merged(None) == Settings().merged("[1]")


def test_modes_are_read_whatever_their_case_and_blanks(spark):
    df = spark.createDataFrame([("ALL",), (" 50% ",), ("+3",), ("-7",), ("x",), (None,)], "m string").withColumn("n", F.lit(20))
    got = {r["m"]: len(r["p"]) for r in df.select("m", validate.sampled_pages(F.col("n"), validate.wanted_pages(F.col("m"), F.col("n"))).alias("p")).collect()}
    assert got == {"ALL": 20, " 50% ": 10, "+3": 3, "-7": 1, "x": 5, None: 5}


def test_books_pass_at_the_threshold_as_a_share(spark):
    picked = spark.createDataFrame([(d, 50, 50, t, p) for d, t in ((1, 58), (2, 59)) for p in range(1, 51)] + [(3, 2, 3, 90, None)], "doc_id long, orig_pages int, trans_pages int, threshold int, page int")
    pages = spark.createDataFrame([(d, p, p <= 29) for d in (1, 2) for p in range(1, 51)], "doc_id long, page int, passed boolean")
    got = {r["doc_id"]: (r["passed"], r["summary"], r["pages_checked"]) for r in validate.books(picked, pages).collect()}
    assert got == {1: (True, "PASS: rate=58% (threshold=58%)", 50), 2: (False, "FAIL: rate=58% (threshold=59%)", 50), 3: (False, "PAGE_COUNT_MISMATCH: 2 vs 3", None)}


def test_log_text_to_events_mapping_and_times(spark):
    t = ["2024-05-01 10:00:00,123 [INFO] [1/2] Processando: a b.pdf (1.0 MB)", "2024-05-01 10:00:01,000 [INFO] Abrindo PDF: a b.pdf", "noise", "2024-05-01 10:01:01,500 [INFO] PDF traduzido salvo: a_PT.pdf", "2024-05-01 10:01:02,000 [INFO]   -> Traduzido: A B.pdf"]
    ls = spark.createDataFrame([(1, k, x, "x") for k, x in enumerate(t)] + [(1, 0, t[0], "x"), (1, 9, None, "x")], "log_id long, line_no long, text string, kind string")
    ev = lineage.log_events(ls)
    assert sorted((r["line_no"], r["kind"], r["name"]) for r in ev.collect()) == [(0, "begin", "a b.pdf"), (1, "open", "a b.pdf"), (3, "saved", "a_PT.pdf"), (4, "done", "A B.pdf")]
    assert [tuple(r) for r in lineage.strict_mapping(ev).collect()] == [tuple(r) for r in lineage.mapping(ev).collect()] == [(1, "A B.pdf", "a b.pdf")]
    assert [tuple(r) for r in lineage.timings(ev).collect()] == [(1, "a b.pdf", 60.0)]
    assert lineage.log_events(ls.limit(0)).count() == 0


def test_estimate_falls_back_to_pages(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    cur = one([(10.0, 1000, 20, 100)], "size_mb double, s long, page int, pages int").select("size_mb", F.timestamp_seconds("s").alias("started"), "page", "pages")
    left, none = one([(5.0,)], "megabytes double"), one([(0.0, 0.0)], "seconds double, megabytes double")
    at = F.timestamp_seconds(F.lit(1100))
    r = lineage.estimate(none, left, cur, at).first()
    assert (r["seconds_per_mb"], r["remaining_seconds"], r["elapsed_seconds"]) == (50.0, 650.0, 100) and r["eta"] == "10m50s"
    r = lineage.estimate(none, left, cur.limit(0), at).first()
    assert (r["eta"], r["finish"], r["remaining_seconds"]) == ("Calculando...", "--", None)
    r = lineage.estimate(one([(30.0, 3.0)], "seconds double, megabytes double"), left, cur, at).first()
    assert r["remaining_seconds"] == 50.0


def test_image_lines_and_first_fit(spark):
    d = spark.createDataFrame([("aa bb cc dd ee", 5.0, 2), ("one", 9.0, 3), ("aa bb cc dd", 50.0, 2), ("", 5.0, 2)], "t string, w double, n int")
    got = [r["x"] for r in d.select(batching.image_lines(F.col("t"), F.col("w"), F.col("n"), True).alias("x")).collect()]
    assert got == [["aa bb", "cc dd ee"], ["one"], ["aa bb", "cc dd"], [""]]
    f = d.limit(1).select(batching.fitted_text(F.array(F.lit("x" * 40)), F.array(F.lit(1.2)), F.lit(12.0), F.lit(4.0), F.lit(0.4), F.lit(60.0), F.lit(40.0)).alias("f")).first()["f"]
    assert 4.0 <= f["size"] < 12.0


def test_transitions_and_recovery(spark):
    b = spark.createDataFrame([("a.pdf", "queue", 1, None), ("b.pdf", "queue", 1, None), ("c.pdf", "traduzindo", 1, None), ("c_PT.pdf", "traduzindo", 1, None), ("d.pdf", "original", 1, None)], "name string, stage string, size_bytes long, mtime timestamp")
    e = spark.createDataFrame([("a.pdf", 1, "start"), ("a.pdf", 2, "finish"), ("b.pdf", 1, "start"), ("b.pdf", 1, "fail"), ("c.pdf", 1, "start"), ("d.pdf", 1, "stop")], "name string, at long, event string")
    assert {r["name"]: r["stage"] for r in queueing.transitions(b, e).collect()} == {"a.pdf": "original", "b.pdf": "queue", "c.pdf": "traduzindo", "c_PT.pdf": "traduzindo", "d.pdf": "original"}
    assert [r["name"] for r in queueing.recovered(b, False).collect()] == ["c.pdf"] and queueing.recovered(b, True).count() == 0
    assert [r["name"] for r in queueing.rerun(b, "d.pdf").collect()] == ["d.pdf"]
