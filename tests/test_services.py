"""Stand-ins of the opaque services, and the continuous validator."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import translate
from folioscope.streaming.continuous import QualityTooLow, Validator, states


def test_batches_are_halved_until_they_pass():
    e = translate.Echo(fail_over=2)
    assert translate.translated(list("abcde"), e, lambda _: None) == ["»a", "»b", "»c", "»d", "»e"]
    dead = translate.Echo(fail_over=0)
    assert translate.translated(["a", "b"], dead, lambda _: None) == ["a", "b"]
    assert translate.translated([], e) == []


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        translate.with_retries(call, 3, waits.append)
    assert waits == [1.0, 2.0] and len(calls) == 3


def test_misses_are_sent_once(spark):
    df = spark.createDataFrame([("ab cd",), ("ab cd ",), ("12",), ("x" * 3000,)], "text string")
    got = {r["text"]: r["translated"] for r in translate.misses(df, translate.Echo).collect()}
    assert got["ab cd"] == "»ab cd" and len(got) == 2


def test_plain_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("l1\nl2\n\nb2\fp2".encode())
    rows = translate.read_documents(spark, str(tmp_path), translate.plain_reader).orderBy("page", "block_no", "line_no").collect()
    assert [(r["page"], r["block_no"], r["line_no"], r["text"]) for r in rows] == [(1, 0, 0, "l1"), (1, 0, 1, "l2"), (1, 1, 0, "b2"), (2, 0, 0, "p2")]


def test_continuous_validation(spark, tmp_path):
    out, state = str(tmp_path / "out"), {"map": [("a", "A")], "command": "run"}
    rows = lambda xs: spark.createDataFrame(xs, "name string, doc_id long").write.mode("append").parquet(out)
    v = Validator(
        spark, out, str(tmp_path / "reports"), str(tmp_path / "pending"),
        lambda: spark.createDataFrame(state["map"], "name string, source string"),
        lambda df, settings: df.withColumn("passed", F.when(F.col("doc_id") < 100, F.col("doc_id") % 2 == 1)).withColumn("rate", F.when(F.col("name") == "d", 0.4994).otherwise(0.5)),
        control=lambda: state["command"],
    )
    check = str(tmp_path / "check")
    rows([("a", 1), ("b", 2)])
    v.run(check)
    read = lambda: sorted((r["name"], r["status"], r["passed"]) for r in spark.read.parquet(str(tmp_path / "reports")).collect())
    assert read() == [("a", "checked", True)]  # b has no source yet and waits
    state["map"] += [("b", "B"), ("c", "C")]
    rows([("a", 1), ("c", 200)])
    v.run(check)
    assert read() == [("a", "checked", True), ("b", "checked", False), ("c", "skipped", None)]
    state["map"] += [("d", "D")]
    state["command"] = "pause"
    rows([("d", 4)])
    v.run(check)
    assert len(read()) == 3  # d waits
    state["command"] = "run"
    rows([("e", 5)])
    with pytest.raises(Exception, match="d: 0.499 of its pages pass"):
        v.run(check)
    assert issubclass(QualityTooLow, RuntimeError)


def test_replies_are_taken_apart_and_unchanged_ones_asked_again():
    asked = []

    def ask(system, user):
        asked.append(user)
        if "numbered" in user:
            return "[1] um [2] the same long text here [2] the same long text here"
        return "novo texto" if "unchanged" in user else "the same long text here"

    t = translate.Asked(ask, sleep=lambda _: None)
    assert t(["one", "the same long text here"]) == ["um", "novo texto"] and len(asked) == 3
    assert translate.parts_of("a\nb", 2) == ["a", "b"] and translate.parts_of("a", 2) is None

    def dead(system, user):
        raise OSError

    waits = []
    d = translate.Asked(dead, sleep=waits.append)
    assert translate.translated(["a b", "c d"], d, waits.append) == ["a b", "c d"] and waits[:2] == [1.0, 2.0]
    assert d.title("Old - Book") == "Old - Book" and translate.output_name("a–b: c", lambda x: "Título") == "Título traduzido.pdf"


def test_control_and_state_files(tmp_path):
    from folioscope import config

    p = str(tmp_path / "control.json")
    assert config.read_json(p, config.CONTROL) == config.CONTROL
    config.write_json(p, {"command": "pause"})
    assert config.read_json(p, config.CONTROL) == {"command": "pause", "model": "default"}
    (tmp_path / "control.json").write_text("{broken")
    assert config.read_json(p, config.CONTROL) == config.CONTROL


def test_images(spark, tmp_path):
    import numpy as np

    from folioscope.operators import images

    w, h, px = images.raster(np.array([[10, 10, 30, 20]]), 60, 40)
    (tmp_path / "a.ppm").write_bytes(b"P6 %d %d 255\n" % (w, h) + px)
    (tmp_path / "b.ppm").write_bytes(b"no image")
    df = images.images(spark, str(tmp_path))
    assert [(r["width"], r["height"]) for r in df.collect()] == [(60, 40)]
    boxes = df.selectExpr("*", "10D x0", "10D y0", "30D x1", "20D y1").unionByName(df.selectExpr("*", "null x0", "10D y0", "30D x1", "20D y1"))
    assert {(r["background"], r["ink"]) for r in images.colors(boxes).collect()} == {(0xFFFFFF, 0), (None, None)}
    assert set(images.erased(w, h, px, [(10, 10, 30, 20)])) == {255}

    def make(card):
        if card:
            raise RuntimeError
        return lambda content: [([(0, 0), (5, 5)], "text")] if content.startswith(b"P6") else 1 / 0

    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r["text"] for r in images.recognised(files, make).collect()] == ["text"]


def test_state_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(1, 0, "run"), (1, 60, "pause"), (2, 0, "stop"), (1, 9000, "run")], "user_id long, s long, event_type string").select(
        F.timestamp_seconds("s").alias("ts"), "user_id", "event_type"
    ).write.parquet(src)
    stream = states(spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(src))
    query = stream.writeStream.format("memory").queryName("st").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["user_id"], r["last"], r["n"]) for r in spark.sql("select * from st").collect()} == {(1, "pause", 2), (2, "stop", 1)}
