"""Token ids against a reference encoder of the same vocabulary, and the way back."""

import base64

import public_tokenizers
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm.encode import decoded, default_path, token_ids

TEXTS = ["", None, " ", "Hello world", "don't we'll I'M", "  two  spaces \n\n tabs\t\t", "naïve Tasskoneth x²½", "谁描述了词汇表？", "क्या यह है?", "👍🏽 ﾊﾛｰ", "a b　c​d\x1cx\x85", "<|endoftext|>", "0123456789" * 20, "Zumora" * 300]


def encoder():
    with open(default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(spark, texts):
    df = spark.createDataFrame([(k, t, ["x"]) for k, t in enumerate(texts)], "doc_id long, text string, ids array<string>")
    got = {r["doc_id"]: (r["ids"], r["back"]) for r in token_ids(df).withColumn("back", decoded(F.col("ids"))).collect()}
    e = encoder()
    for k, t in enumerate(texts):
        assert got[k] == (e.encode_ordinary(t or ""), t or ""), t


def test_texts(spark):
    check(spark, TEXTS)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=30), min_size=30, max_size=60))
def test_any_text(spark, xs):
    check(spark, xs)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "Qzxvuneth"), (1, "Qzxvuneth"), (1, "Ulmgaruvek b"), (None, "Tasmorvek"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), tuple(r["ids"])) for r in token_ids(df).collect())
    e = encoder()
    assert got == sorted((str(a), tuple(e.encode_ordinary(b or ""))) for a, b in [(1, "Qzxvuneth"), (1, "Qzxvuneth"), (1, "Ulmgaruvek b"), (None, "Tasmorvek"), (None, None)])
    assert token_ids(df.limit(0)).count() == 0
