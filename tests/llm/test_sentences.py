"""Sentence units in several scripts, with their positions."""

import re

import pytest

from folioscope.llm.sentences import sentence_units

CASES = [
    ("It cost 3.5 km. See www.a.org now! OK?", ["It cost 3.5 km.", "See www.a.org now!", "OK?"]),
    ("Mr. Hill saw No. 5, e.g. maps, etc. Then J. K. Rowan left.", ["Mr. Hill saw No. 5, e.g. maps, etc.", "Then J. K. Rowan left."]),
    ("“Stop. It broke,” said Ann. “Who?” he asked. She wrote: “All is lost.” Rain fell.", ["“Stop. It broke,” said Ann.", "“Who?” he asked.", "She wrote: “All is lost.”", "Rain fell."]),
    ("Am 12. Mai kam die 3. Auflage, z. B. hier. „Halt. Nein“, sagte er.", ["Am 12. Mai kam die 3. Auflage, z. B. hier.", "„Halt. Nein“, sagte er."]),
    ("« Halte. Non », dit-il. Il partit ! Et toi ?", ["« Halte. Non », dit-il.", "Il partit !", "Et toi ?"]),
    ("книги и т. д. Рис. 5 на стр. 4. Кто это?", ["книги и т. д.", "Рис. 5 на стр. 4.", "Кто это?"]),
    ("谁来？他说：“停下。坏了。”门开了……“好吗？”他问。", ["谁来？", "他说：“停下。坏了。”", "门开了……", "“好吗？”他问。"]),
    ("彼は「行け！」と言った。「待て。ない」と言った。終わり…次。", ["彼は「行け！」と言った。", "「待て。ない」と言った。", "終わり…", "次。"]),
    ("क्या यह है? यह है। बस।", ["क्या यह है?", "यह है।", "बस।"]),
    ("هل هذا؟ نعم. هذا 6.41 هنا.", ["هل هذا؟", "نعم.", "هذا 6.41 هنا."]),
    ("Ποιος είναι; Ο μαθητής, δηλ. εγώ.", ["Ποιος είναι;", "Ο μαθητής, δηλ. εγώ."]),
    ("นักแปลเปิด ช่างเก็บ", ["นักแปลเปิด", "ช่างเก็บ"]),
    ("Chapter 4\n\nIt was\nlate. Very.\r\n\r\n- one item. more\n- two\n\n1. first\n2. second", ["Chapter 4", "It was\nlate.", "Very.", "- one item. more", "- two", "1. first", "2. second"]),
    ("He said... nothing! (It was late.) End.", ["He said... nothing!", "(It was late.)", "End."]),
    ("word", ["word"]), ("!", ["!"]), ("", []), (None, []), (" \n\t　", []),
]


def test_units(spark):
    df = spark.createDataFrame([(k, t, 1, 2) for k, (t, _) in enumerate(CASES)], "doc_id long, text string, sent_no int, start_pos int")
    got = {}
    for r in sentence_units(df).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r["doc_id"], []).append((r["sent_no"], r["start_pos"], r["end_pos"]))
    for k, (text, want) in enumerate(CASES):
        units = got.get(k, [])
        assert [text[a:b] for _, a, b in units] == want, text
        assert [n for n, _, _ in units] == list(range(1, len(want) + 1))


def test_units_cover_all_but_white_space(spark):
    text = "A b. C d.\n\n• x\n• y. Z “q. r.” 😀 " * 40
    df = spark.createDataFrame([(1, text), (1, text), (None, "Ab. Cd.")], "doc_id long, text string")
    rows = sentence_units(df).collect()
    mine = sorted((r["start_pos"], r["end_pos"]) for r in rows if r["doc_id"] == 1)[::2]
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in mine)) == re.sub(r"\s", "", text)
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_empty_table(spark):
    assert sentence_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [20_000])
def test_long_text(spark, n):
    df = spark.createDataFrame([(1, "Ab cd. " * n)], "doc_id long, text string")
    assert sentence_units(df).count() == n


def test_long_quotations_are_one_unit(spark):
    said = " ".join(f"It was day {'x' * k}." for k in range(60))
    for o, c in (("“", "”"), ("«", "»"), ("(", ")")):
        text = f"He said {o}{said}{c} and left. Next one."
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        got = [text[r["start_pos"] : r["end_pos"]] for r in sentence_units(df).orderBy("sent_no").collect()]
        assert got == [f"He said {o}{said}{c} and left.", "Next one."]


def test_marks_without_a_partner_hide_nothing(spark):
    text = "It rained (a little). We left. See b). They stayed. One (two. Three."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [text[r["start_pos"] : r["end_pos"]] for r in sentence_units(df).orderBy("sent_no").collect()]
    assert got == ["It rained (a little).", "We left.", "See b).", "They stayed.", "One (two.", "Three."]
