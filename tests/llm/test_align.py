"""Alignment of invented bilingual books with moves, merges and omissions."""

import random

from folioscope.llm import align
from folioscope.llm.align import found

SOURCE = [f"{a}{b}" for a in ("lorn", "brim", "dask", "velm", "torp", "quil") for b in ("et", "ow", "in", "ash", "ud")]
TARGET = [f"{b}{a}" for a in ("zor", "mip", "fek", "gul", "hax", "nev") for b in ("po", "ta", "ri", "su", "le")]
WORD = dict(zip(SOURCE, TARGET))


def book(rnd, doc, first):
    """(rows, true pairs) of a book: one sentence left out, two swapped, two merged."""
    n = 14
    src = [[rnd.choice(SOURCE) for _ in range(7)] for _ in range(n)]
    order = list(range(n))
    order.remove(rnd.randrange(n))
    i = rnd.randrange(len(order) - 1)
    order[i], order[i + 1] = order[i + 1], order[i]
    text = lambda ws: " ".join(["The", *ws]) + "."
    other = lambda ws: " ".join(["Un", *[WORD[w] for w in rnd.sample(ws, len(ws))]]) + "."
    rows = [(first + k, "orig", doc, k, text(ws)) for k, ws in enumerate(src)]
    pairs, lines, k = set(), [], 0
    merged = rnd.randrange(len(order) - 1)
    while k < len(order):
        group = order[k : k + 2] if k == merged else order[k : k + 1]
        line = first + 100 + len(lines)
        lines.append((line, "trans", doc, len(lines), " ".join(other(src[g]) for g in group)))
        pairs |= {(first + g, line) for g in group}
        k += len(group)
    return rows + lines, pairs


def test_books(spark):
    rnd = random.Random(3)
    rows, want = [], set()
    for d in range(60):
        r, p = book(rnd, d, d * 1000)
        rows += r
        want |= p
    rows += [rows[0], (999_001, "orig", 1, 50, None), (999_002, "trans", 1, 50, ""), (999_003, "orig", 777, 0, "Only one side here of it."), (999_004, "orig", None, 0, "No book at all in this.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "line_id long, side string, doc_id long, i int, text string, line_id_a string")
    got = {tuple(r) for r in found(df).collect()}
    assert all(a < b for a, b in got)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_large_book_that_lacks_its_beginning_and_has_a_block_moved(spark, monkeypatch):
    monkeypatch.setattr(align, "PIECE", 16)
    rnd = random.Random(5)
    word = {f"{a}{b}": f"{y}{x}" for a, x in (("lorn", "zor"), ("brim", "mip"), ("dask", "fek"), ("velm", "gul"), ("torp", "hax"), ("quil", "nev")) for b, y in (("et", "po"), ("ow", "ta"), ("in", "ri"), ("ash", "su"), ("ud", "le"), ("alk", "bo"), ("om", "ki"), ("ers", "da"))}
    rows, want, line = [], {}, 0
    for doc, n in [(0, 160), *((d, 12) for d in range(1, 61))]:
        src = [rnd.sample(list(word), 7) for _ in range(n)]
        order = [*range(90, 160), *range(60, 90)] if doc == 0 else list(range(n))
        rows += [(line + k, "orig", doc, k, "The " + " ".join(ws) + ".") for k, ws in enumerate(src)]
        rows += [(line + n + k, "trans", doc, k, "Un " + " ".join(word[w] for w in src[g]) + ".") for k, g in enumerate(order)]
        want[doc] = {(line + g, line + n + k) for k, g in enumerate(order)}
        line += n + len(order)
    df = spark.createDataFrame(rows, "line_id long, side string, doc_id long, i int, text string")
    got = {tuple(r) for r in found(df).collect() if r[0] < 260}
    assert len(got & want[0]) >= 0.95 * len(want[0]) and len(got & want[0]) >= 0.95 * len(got)


def test_empty(spark):
    df = spark.createDataFrame([], "line_id long, side string, doc_id long, i int, text string")
    assert found(df).count() == 0


def test_sentences_of_any_script_are_kept(spark):
    texts = ["The old clock stood by the river.", "وقفت الساعة القديمة بجانب النهر.", "पुरानी घड़ी नदी के पास खड़ी थी।", "오래된 시계가 강가에 서 있었다.", "THE OLD CLOCK STOOD BY THE RIVER.", "Старые часы стояли у реки.", "השעון הישן עמד ליד הנהר.", "古い時計は川のそばにあった。", "TASVI-452", "Quenga Wexlotos", "96,86 kg"]
    df = spark.createDataFrame([(k, "orig", k, 0, t) for k, t in enumerate(texts)], "line_id long, side string, doc_id long, i int, text string")
    assert {r["line_id"] for r in align.sentences(df).collect()} == set(range(8))


def test_lines_of_many_sentences_keep_their_order(spark):
    many = " ".join(f"The clock number n{k} stood there." for k in range(5000))
    df = spark.createDataFrame([(1, "orig", 1, 0, many), (2, "orig", 1, 1, "The last one was here.")], "line_id long, side string, doc_id long, i int, text string")
    got = align.sentences(df).orderBy("at").collect()
    assert len({r["at"] for r in got}) == len(got) == 5001 and got[-1]["line_id"] == 2
