import datetime as dt
import json

from scriptorium.sources import records
from scriptorium.sources.mailbox import MailboxSource
from scriptorium.streaming import live


def message(i, at):
    return {"id": f"m{i}", "threadId": "t", "labelIds": ["SENT"], "snippet": "s", "internalDate": at, "payload": {"mimeType": "text/plain"}}


def test_mailbox(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for i in range(5):
        (box / f"{i}.json").write_text(json.dumps(message(i, str(1000 + i // 2))))
    (box / "bad.json").write_text("{")
    spark.dataSource.register(MailboxSource)
    assert spark.read.format("mailbox").load(str(box)).count() == 5
    assert spark.read.format("mailbox").option("after", 1000).load(str(box)).count() == 3
    stream = spark.readStream.format("mailbox").option("count", 1).load(str(box))
    for want in (2, 4, 5):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(once=True).start()
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_records(spark, tmp_path):
    raw, filtered = tmp_path / "raw", tmp_path / "filtered"
    raw.mkdir()
    (raw / "a.json").write_text(json.dumps({"url": "u1", "text": "x\ny", "date_posted": "2024"}))
    (raw / "b.json").write_text(json.dumps({"url": "u2", "text": "z"}))
    (raw / "c.json").write_text("{oops")
    assert [r.url for r in records.load_posts(spark, str(filtered), str(raw)).collect()] == ["u2", "u1"]
    filtered.mkdir()
    (filtered / "a.json").write_text(json.dumps({"url": "u3"}))
    assert [r.url for r in records.load_posts(spark, str(filtered), str(raw)).collect()] == ["u3"]
    names = records.numbered(spark.range(300).selectExpr("id % 7 AS k", "id"), "id", "post").orderBy("id").collect()
    assert [r.record_name for r in names] == [f"post_{i + 1:03d}" for i in range(300)]
    state = str(tmp_path / "state")
    assert records.load_state(spark, state).first().total_fetched == 0
    records.save_state(spark.createDataFrame([(3, 9, 1)], "total_fetched bigint, newest bigint, oldest bigint"), state)
    assert tuple(records.load_state(spark, state).first()) == (3, 9, 1)


def test_streams(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 8, at + dt.timedelta(minutes=10 * (i % 8)), i % 2, "click", 1.0, None) for i in range(10)] + [(99, at + dt.timedelta(hours=9), 1, "view", 2.0, None)]
    folder = tmp_path / "events"
    spark.createDataFrame(rows, live.EVENTS).coalesce(1).write.parquet(str(folder))
    stream = live.events(spark, str(folder), "*.parquet")
    once = live.drain(live.once_each(stream, ["event_id"]))
    assert once.count() == 9
    hours = {(r.start.hour, r.n) for r in live.drain(live.tumbling(stream)).collect()}
    assert hours == {(0, 8), (1, 2)}
    spans = live.drain(live.sessions(stream)).collect()
    assert {(r.user_id, r.n) for r in spans} == {(0, 5), (1, 5)}
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    live.upsert_batches(stream.select("event_id", "ts", "value"), table, "event_id", "ts", log).awaitTermination()
    assert spark.read.parquet(f"{table}/v0").count() == 9
