"""Streams: masked text without state, numbers that persist, windowed counts, settings that change between batches."""

import shutil

import pytest
from pyspark.sql import functions as F

from maskwright.operators import mask as M
from maskwright.plans.config import Config
from maskwright.plans.engine import Engine
from maskwright.streaming import live

OPEN = Config(allow_domains=())
SCHEMA = "seq long, value string"


def feed(folder, name, rows):
    import json

    (folder / f"{name}.json").write_text("".join(json.dumps({"seq": s, "value": v}) + "\n" for s, v in rows))


def run(writer, checkpoint):
    q = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


BATCHES = [
    [(1, "b@x.co and 10.0.0.7"), (2, "a@x.co b@x.co"), (3, None)],
    [(4, "10.0.0.8 c@x.co"), (5, "A@X.co 10.0.0.7"), (6, "none")],
    [(7, "d@x.co c@x.co e@x.co")],
]


def test_numbers_go_on_from_batch_to_batch(spark, tmp_path):
    src, out, numbers = tmp_path / "in", tmp_path / "out", tmp_path / "numbers"
    src.mkdir()
    engine = Engine(OPEN.only("email", "ipv4"))
    write = lambda df, i: df.select("seq", "masked").write.mode("overwrite").json(f"{out}/{i}")
    for i, rows in enumerate(BATCHES):  # each run reads one new file, as a stream that is started again does
        feed(src, i, rows)
        stream = spark.readStream.schema(SCHEMA).json(str(src))
        run(live.mask_numbered(engine, stream, f"file://{numbers}", "seq", write), tmp_path / "checkpoint")
    got = {r["seq"]: r["masked"] for i in range(len(BATCHES)) for r in spark.read.schema("seq long, masked string").json(f"{out}/{i}").collect()}
    whole = spark.createDataFrame([r for rows in BATCHES for r in rows], SCHEMA)
    want = {r["seq"]: r["masked"] for r in M.mask_shared(engine, whole, "seq", "seq", "value").collect()}
    assert got == want and got[5] == "<EMAIL_2> <IPV4_1>" and got[7] == "<EMAIL_4> <EMAIL_3> <EMAIL_5>" and got[3] is None
    # a batch that runs again gets the same numbers
    again = live.number_batch(engine, spark.createDataFrame(BATCHES[1], SCHEMA), 1, f"file://{numbers}", "seq")
    assert {r["seq"]: r["masked"] for r in again.collect()} == {k: want[k] for k in (4, 5, 6)}


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"ts": "2024-01-01T00:00:10", "value": "a@x.co b@x.co"}\n{"ts": "2024-01-01T00:01:10", "value": "c@x.co 10.0.0.7"}\n')
    stream = spark.readStream.schema("ts timestamp, value string").json(str(src))
    counts = live.windowed_counts(live.span_stream(Engine(OPEN.only("email", "ipv4")), stream, ["ts"]), "ts")
    q = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r["window"]["start"].minute, r["id"], r["n"]) for r in spark.table("window_counts").collect())
    assert got == [(0, "email", 2), (1, "email", 1), (1, "ipv4", 1)]


def test_settings_that_change(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    engines = [Engine(OPEN.only("email").changed(template="[{label}]")), Engine(OPEN.only("ipv4").changed(template="[{label}]"))]
    write = lambda df, i: df.select("masked").write.mode("overwrite").text(f"{out}/{i}")
    for i in range(2):
        (src / f"{i}.txt").write_text("a@x.co 10.0.0.7\n")
        run(live.reload_each_batch(spark.readStream.schema("value string").text(str(src)), lambda i=i: engines[i], write), tmp_path / "checkpoint")
    assert [spark.read.text(f"{out}/{i}").first()[0] for i in range(2)] == ["[EMAIL] 10.0.0.7", "a@x.co [IPV4]"]


@pytest.fixture(autouse=True)
def clean(tmp_path):
    yield
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_values_of_other_spellings_are_one(spark):
    values = ["ﾃﾞｰﾀ", "データ", "ABC", "ａｂｃ", "090-1234-5678", "０９０ １２３４ ５６７８", "①", "1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(M.normalized(F.col("v"))).collect()]
    assert got == ["データ", "データ", "abc", "abc", "09012345678", "09012345678", "1", "1"]
