"""Canonical forms against plain per-string code, and pairs of texts that look alike."""

import unicodedata

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import canon


def form(*xs):
    return canon.canonical_array(pa.array(xs, pa.string())).to_pylist()


def test_known_forms():
    assert form("ｅｍ　x", "ﬁn", "Cafe‌́", "a‑b", "x  y ", "Τhе") == ["em x", "fin", "Café", "a-b", "x y", "The"]
    assert form("x²", "x2", "É", "é", "E", "47", "４7") == ["x²", "x2", "É", "é", "E", "47", "47"]
    assert form(None, "", "​", " ") == [None, "", "", ""]
    assert form("가", "가", "각", "각") == ["가", "가", "각", "각"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=("Cs", "Co", "Cn")), max_size=12), max_size=6))
def test_all_normal_forms_of_a_text_have_one_form_and_it_is_stable(xs):
    got = form(*xs)
    assert form(*[unicodedata.normalize("NFD", x) for x in xs]) == got
    assert form(*[unicodedata.normalize("NFC", x) for x in xs]) == got
    assert form(*got) == got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=33, max_codepoint=0x24F, exclude_characters="­-ıŉǀǄǅǆǇǈǉǊǋǌǱǲǳĲĳĿŀ", exclude_categories=("Cc", "Cf", "Sk", "No", "Lm")), max_size=20)))
def test_plain_latin_is_only_composed(xs):
    same = [x for x in xs if all(canon._expansion(ord(c), {}) == unicodedata.normalize("NFD", c) for c in x)]
    assert form(*same) == [unicodedata.normalize("NFC", x) for x in same]


def test_long_texts_and_slices():
    x = "ａ́" * 50_000
    arr = pa.array(["skip", x, None, "b"])
    assert canon.canonical_array(arr[1:]).to_pylist() == ["á" * 50_000, None, "b"]


def test_pairs(spark):
    rows = [(1, 9, "Café 1", "k"), (2, 9, "Café 1", "k"), (2, 9, "Café 1", "late"), (3, 9, "Café 1", "k"), (4, 9, "cafe 1", "k"), (5, 8, "Café 1", "k"), (6, 9, None, "k"), (7, None, "Café 1", "k"), (8, 9, "", "k")]
    df = spark.createDataFrame(rows, "line_id long, doc_id long, text string, canonical string")
    got = {tuple(r) for r in canon.alike_pairs(df, "line_id", "line_entry").collect()}
    assert got == {("line_entry", 1, 2), ("line_entry", 2, 3)}
    assert canon.alike_pairs(df.limit(0), "line_id", "line_entry").count() == 0
    out = canon.with_canonical(df).orderBy("line_id").collect()
    assert out[0]["canonical"] == "Café 1" and len(out) == 9
