"""Streams over files give what the batch operators give."""

import json
import os

import pytest

from lectern.operators import progress as batch
from lectern.streaming import progress as stream


@pytest.fixture(autouse=True)
def batches_with_data_only(spark):
    """State with timeouts asks for batches without end, so a run over all that is there would not stop."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.fixture
def feed(spark, tmp_path):
    """feed(schema, parts): a stream that reads one file of rows after another."""

    def make(schema, parts):
        d = tmp_path / "in"
        d.mkdir()
        for i, rows in enumerate(parts):
            (d / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(d / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by age
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))

    return make


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name)


def test_debounce(spark, feed, tmp_path):
    pos = [0, 3, 4, 6, 8, 10, 12]
    rows = [{"item_id": k, "seq": i, "position": float(p)} for k in "ab" for i, p in enumerate(pos)]
    schema = "item_id string, seq long, position double"
    got = run(spark, stream.debounce(feed(schema, [rows[:4] + rows[7:9], rows[4:7] + rows[9:]])), tmp_path, "debounced")
    want = batch.debounced(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "item_id", ["seq"], "position")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("item_id", "seq", "position").collect()))


def test_latest_table(spark, feed, tmp_path):
    from lectern.sources.sinks import current

    rows = [{"item_id": "a", "ts": t, "seq": t, "position": t * 1.0} for t in range(5)] + [{"item_id": "b", "ts": 1, "seq": 9, "position": 7.0}]
    q = stream.latest_table(feed("item_id string, ts long, seq long, position double", [rows[3:], rows[:3]]), str(tmp_path / "t"), str(tmp_path / "cp"), ["item_id"], ["ts", "seq"])
    assert q.awaitTermination(60)
    assert sorted((r["item_id"], r["position"]) for r in current(spark, str(tmp_path / "t")).collect()) == [("a", 4.0), ("b", 7.0)]


def test_queue(spark, feed, tmp_path):
    events = [("x", "enqueue"), ("x", "enqueue"), ("x", "done"), ("x", "launch"), ("y", "enqueue"), ("x", "done"), ("y", "launch"), ("y", "fail"), ("x", "consume"), ("x", "enqueue")]
    rows = [{"text": t, "seq": i, "event": e} for i, (t, e) in enumerate(events)]
    got = run(spark, stream.queue_states(feed("text string, seq long, event string", [rows[:5], rows[5:]])), tmp_path, "queue")
    assert sorted(map(tuple, got.collect())) == [("x", 0, "queued"), ("x", 3, "pending"), ("x", 5, "ready"), ("x", 8, "gone"), ("x", 9, "queued"), ("y", 4, "queued"), ("y", 6, "pending"), ("y", 7, "failed")]


def test_fresh_rows(spark, feed, tmp_path):
    rows = [{"session": "s", "seq": i, "generation": g, "idx": x} for i, (g, x) in enumerate([(1, 1), (1, 3), (1, 2), (2, 1), (1, 9), (2, 2)])]
    got = run(spark, stream.fresh_rows(feed("session string, seq long, generation long, idx long", [rows[:3], rows[3:]])), tmp_path, "fresh")
    assert sorted(r["seq"] for r in got.collect()) == [0, 1, 3, 5]


def test_degrade(spark, feed, tmp_path):
    rows = [{"session": "s", "seq": i, "rtf": v} for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0])]
    got = run(spark, stream.degrade(feed("session string, seq long, rtf double", [rows[:5], rows[5:]])), tmp_path, "stages")
    assert sorted((r["seq"], r["stage"]) for r in got.collect()) == [(3, 1), (6, 2)]


def test_finished(spark, feed, tmp_path):
    rows = [{"session": s, "seq": i, "t": t, "last_end": 10.0, "idle": idle, "ts": "2024-01-01T00:00:00Z"} for i, (s, t, idle) in enumerate([("a", 10.5, True), ("a", 11.0, False), ("a", 11.0, True), ("a", 12.0, True), ("b", 3.0, True)])]
    got = run(spark, stream.finished(feed("session string, seq long, t double, last_end double, idle boolean, ts timestamp", [rows])), tmp_path, "ends")
    assert [r["session"] for r in got.collect()] == ["a"]


def test_highlight(spark, feed, tmp_path):
    spans = spark.createDataFrame([("b", 1, 0.0), ("b", 2, 5.0)], "book string, index int, start_time double")
    seen = []
    q = stream.highlight(feed("book string, t double", [[{"book": "b", "t": 1.0}], [{"book": "b", "t": 6.0}]]), spans, str(tmp_path / "cp"), lambda df, i: seen.extend(r["index"] for r in df.collect()))
    assert q.awaitTermination(60) and sorted(seen) == [1, 2]
