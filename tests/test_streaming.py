"""A replayed stream gives what one batch gives."""

import base64
import json
import random

from pyspark.sql import functions as F

from tidewater.operators import snapshots
from tidewater.sources import sqltext
from tidewater.streaming import replay, stateful

SCHEMA = "op string, seq long, path string, size long"


def test_log_stream_equals_batch(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    base.write.parquet(f"{tmp_path}/snap/v0")
    logs = [[("F", 1, "c", 3), ("D", 2, "a", 0)], [("F", 3, "a", 9), ("F", 4, "b", 5)]]
    (tmp_path / "log").mkdir()
    for i, rows in enumerate(logs):
        (tmp_path / "log" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("op", "seq", "path", "size"), r))) for r in rows))
        for _ in range(2):  # the second start finds nothing new
            replay.apply_log(spark, f"{tmp_path}/log", SCHEMA, f"{tmp_path}/snap", f"{tmp_path}/cp", "path").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/snap/v2").collect()))
    whole = spark.createDataFrame([r for rows in logs for r in rows], SCHEMA)
    assert got == sorted(map(tuple, snapshots.merge(base, whole, "path").collect())) == [("a", 9), ("b", 5), ("c", 3)]


class Feed:
    """A folder of JSON files, one a batch, and a query over it that is stopped and started again with each."""

    def __init__(self, spark, path, schema, made):
        self.spark, self.path, self.schema, self.made, self.n = spark, path, schema, made, 0
        (path / "in").mkdir(parents=True)

    def send(self, rows):
        names = [c.split()[0] for c in self.schema.split(", ")]
        (self.path / "in" / f"{self.n:03}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))
        q = self.made(stream).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp")).outputMode("append")
        q.trigger(availableNow=True).start().awaitTermination()

    def rows(self):
        return self.spark.read.parquet(str(self.path / "out"))


def test_dump_stream_goes_on_at_its_place(spark, tmp_path):
    text = "SELECT 'a;b';\n-- c;\nSELECT é, \"x\\\";\";/* ; */ INSERT INTO t VALUES (1);;  UPDATE t SET a = 'it''s;' WHERE `b;` = 2; -- end"
    data, size = text.encode(), 7
    chunks = [(n, data[n * size : (n + 1) * size]) for n in range(-(-len(data) // size))]
    feed = Feed(
        spark, tmp_path, "dump string, seq long, data string, last boolean", lambda s: stateful.statements(s.withColumn("data", F.unbase64("data")))
    )
    rows = [(d, n, base64.b64encode(c).decode(), n == len(chunks) - 1) for n, c in chunks for d in ("one", "two")]
    rows.append(("cut", 0, base64.b64encode(b"SELECT 1; SELECT 'open").decode(), True))
    random.Random(3).shuffle(rows)
    for at in range(0, len(rows), 9):
        feed.send(rows[at : at + 9] + rows[at - 2 : at])  # some come twice
    want = [(n, len(text[:a].encode()), len(text[:b].encode()), "ok", s) for n, (a, b, s) in enumerate(sqltext.split(text))]
    got = {d: sorted(tuple(r)[1:] for r in feed.rows().where(F.col("dump") == d).collect()) for d in ("one", "two", "cut")}
    assert got["one"] == got["two"] == want
    assert got["cut"] == [(0, 0, 9, "ok", "SELECT 1;"), (1, 9, 22, "unended", " SELECT 'open")]


def test_a_statement_without_end_is_given_in_pieces(spark, tmp_path):
    feed = Feed(spark, tmp_path, "dump string, seq long, data string, last boolean", lambda s: stateful.statements(s.withColumn("data", F.unbase64("data")), limit=50))
    parts = ["SELECT 1; SELECT '", "x;" * 40, "y;" * 40, "z'; SELECT 2;"]
    for n, p in enumerate(parts):
        feed.send([("d", n, base64.b64encode(p.encode()).decode(), n == 3)])
    got = sorted(tuple(r)[1:] for r in feed.rows().collect())
    assert [(r[0], r[3]) for r in got] == [(0, "ok"), (1, "stalled"), (1, "stalled"), (1, "stalled"), (2, "ok")]
    assert "".join(r[4] for r in got) == "".join(parts)


def test_failing_keys_equal_the_batch(spark, tmp_path):
    at = lambda m: f"2024-01-01T{m // 60:02}:{m % 60:02}:00"
    schema = "key string, at timestamp, ok boolean"
    feed = Feed(spark, tmp_path, schema, lambda s: stateful.failing(s, late="5 minutes", forget_ms=60 * 60_000))
    batches = [
        [("a", at(1), False), ("b", at(1), False), ("c", at(1), True)],
        [("a", at(3), False), ("b", at(2), True), ("b", at(3), False), ("d", at(3), False)],
        [("a", at(4), False), ("a", at(5), False), ("b", at(6), False), ("e", at(20), False)],
        [("b", at(21), True), ("late", at(2), False), ("e", at(22), False)],
        [("e", at(23), False), ("f", at(24), False)],
    ]
    for b in batches:
        feed.send(b)
    seen = [tuple(r) for r in feed.rows().select("key", "failures", "status", "at").orderBy("at").collect()]
    assert [r[:3] for r in seen if r[0] == "a"] == [("a", 1, "failing"), ("a", 2, "failing"), ("a", 3, "quarantined"), ("a", 4, "quarantined")]
    assert [r[:3] for r in seen if r[0] == "b"][-1] == ("b", 0, "cleared") and not [r for r in seen if r[0] in ("late", "c")]
    on_time = spark.createDataFrame([r for b in batches for r in b if r[0] != "late"], "key string, at string, ok boolean").withColumn("at", F.to_timestamp("at"))
    last = {}
    for k, n, s, _ in seen:
        last[k] = (n, s)
    assert {k: v for k, v in last.items() if v[0]} == {r.key: (r.failures, r.status) for r in stateful.failing_batch(on_time).collect()}
    feed.send([("z", at(300), True)])
    feed.send([("z", at(301), True)])
    gone = {r.key for r in feed.rows().where("status = 'forgotten'").collect()}
    assert gone == {"a", "d", "e", "f"}


def test_windows_drop_late_rows(spark, tmp_path):
    at = lambda m: f"2024-01-01T{m // 60:02}:{m % 60:02}:00"
    count = lambda s: replay.windowed_counts(s, "at", "key", "10 minutes", "5 minutes", "5 minutes").select("key", F.col("window.start").alias("start"), "n")
    feed = Feed(spark, tmp_path, "key string, at timestamp", count)
    sent = [[("a", at(1)), ("a", at(7))], [("a", at(30))], [("a", at(2)), ("b", at(31))], [("a", at(90))], [("a", at(91))]]
    for rows in sent:
        feed.send(rows)
    got = {(r.key, r.start, r.n) for r in feed.rows().collect()}
    whole = spark.createDataFrame([r for b in sent[:2] + [[("b", at(31))]] for r in b], "key string, at string").withColumn("at", F.to_timestamp("at"))
    assert got == {tuple(r) for r in count(whole).collect()}
