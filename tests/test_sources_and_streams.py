"""Readers, sinks and streams on small files of our own."""

import json

import pytest
from pyspark.sql import functions as F

from cartulary.sources import artifacts, sinks
from cartulary.streaming import events


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.bin").write_bytes(b"\x00\x01")
    return tmp_path


def test_corpus(spark, folder):
    rows = {r.ext: r for r in artifacts.corpus(spark, str(folder)).collect()}
    assert rows["html"].text == "<p>x</p>" and not rows["html"].skipped
    assert rows["bin"].skipped and rows["bin"].text is None and rows["bin"].bytes == 2


def test_har(spark, tmp_path):
    entry = lambda m, u: {"request": {"method": m, "url": u, "headers": [{"name": "Cookie", "value": "s"}, {"name": "Accept", "value": "*"}]}, "response": {"status": 200}}
    (tmp_path / "x.har").write_text(json.dumps({"log": {"entries": [entry("GET", "https://h/a?q=1"), entry("GET", "https://h/a"), entry("POST", "https://h/b")]}}))
    rows = sorted(tuple(r) for r in artifacts.har_calls(spark, str(tmp_path)).collect())
    assert rows == [("GET", "/a", ["accept"], 0), ("POST", "/b", ["accept"], 2)]


def test_text_artifacts(spark, tmp_path):
    (tmp_path / "s.sql").write_text("CREATE TABLE users (id int);\ncreate table if not exists `orders` (x int);")
    assert {r.table for r in artifacts.ddl_tables(spark, str(tmp_path / "s.sql")).collect()} == {"users", "orders"}
    (tmp_path / "f.csv").write_text('id, "na,me" ,x\n1,2,3\n')
    assert artifacts.csv_fields(spark, str(tmp_path / "f.csv")).first().fields == ["id", '"na', 'me"', "x"]
    line = '1.2.3.4 - - [10/Oct/2024:13:55:36 +0000] "GET {} HTTP/1.1" {} {}\n'
    (tmp_path / "a.log").write_text(line.format("/x?a=1", 404, 10) + line.format("/x", 404, "-") + line.format("/y", 404, 1) + line.format("/z", 200, 1) + "junk\n")
    log = artifacts.access_log(spark, str(tmp_path / "a.log"))
    assert log.count() == 4
    assert [tuple(r) for r in artifacts.missing_demand(log).collect()] == [("/x", 2), ("/y", 1)]


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "t.sql").write_text("create\n  table if not exists\n  one (a int);\nCREATE TABLE two (b int);")
    assert {r.table for r in artifacts.ddl_tables(spark, str(tmp_path / "t.sql")).collect()} == {"one", "two"}
    (tmp_path / "h.csv").write_text("a, b\nc,d\n")
    assert [r.fields for r in artifacts.csv_fields(spark, str(tmp_path / "h.csv")).collect()] == [["a", "b"]]
    (tmp_path / "r.txt").write_text("".join(f"User-agent: {a}\nDisallow: /{a}{i}\n" for i in range(200) for a in ("x", "*")))
    assert {r.pattern for r in artifacts.robots_rules(spark, str(tmp_path / "r.txt")).collect()} == {f"/*{i}" for i in range(200)}
    (tmp_path / "m.xml").write_text("<urlset><url><loc>\n  https://h/a\n</loc></url></urlset>")
    assert [r.url for r in artifacts.sitemap_urls(spark, str(tmp_path / "m.xml"), "https://h/").collect()] == ["https://h/a"]


def test_robots_and_sitemap(spark, tmp_path):
    (tmp_path / "robots.txt").write_text("User-agent: bad\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /a/b # tie\n")
    rules = artifacts.robots_rules(spark, str(tmp_path / "robots.txt"))
    paths = spark.createDataFrame([("/a/x",), ("/a/b/c",), ("/z",)], "path string")
    assert {r.path: r.allowed for r in artifacts.robots_verdicts(paths, rules).collect()} == {"/a/x": False, "/a/b/c": True, "/z": True}
    (tmp_path / "m.xml").write_text("<urlset><url><loc> https://h/a </loc></url><url><loc>https://o/b</loc></url></urlset>")
    assert [r.url for r in artifacts.sitemap_urls(spark, str(tmp_path / "m.xml"), "https://h/").collect()] == ["https://h/a"]


def test_openapi(spark, tmp_path):
    spec = {"paths": {"/u/{id}": {"get": {"operationId": "getU"}, "delete": {"deprecated": True}, "parameters": []}}, "components": {"a": {"$ref": "#/components/b"}, "b": {"type": "string"}}}
    (tmp_path / "o.json").write_text(json.dumps(spec))
    rows = sorted(tuple(r) for r in artifacts.openapi_operations(spark, str(tmp_path / "o.json")).collect())
    assert rows == [("DELETE", "/u/{id}", None, True), ("GET", "/u/{id}", "getU", False)]
    assert artifacts.deref(spec, {"$ref": "#/components/a"}) == {"type": "string"}


def test_sinks(spark, tmp_path):
    run = spark.createDataFrame([(1, 5)], "run int, n int")
    sinks.append_history(run, str(tmp_path / "h"))
    sinks.append_history(run, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
    sinks.write_findings(spark.createDataFrame([("a", 1), ("b", 2)], "kind string, n int"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("kind = 'a'").count() == 1
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "c"), (None, "new")], "id long, v string").coalesce(1)
    out = {r.v: r.id for r in sinks.upsert(store, changes, "id").collect()}
    assert out["a"] == 1 and out["c"] == 2 and out["new"] > 2 and "b" not in out


@pytest.fixture
def stream_folder(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    ids = e.agg(F.expr("percentile_approx(ts, 0.5)").alias("m")).first().m
    e.where(F.col("ts") <= ids).coalesce(1).write.parquet(str(tmp_path / "in"))
    e.where(F.col("ts") > ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), e


def drain(spark, df, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName("drained").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("drained")


def test_windows(spark, stream_folder, tmp_path):
    folder, e = stream_folder
    got = drain(spark, events.windowed_counts(events.watch(spark, folder), "1 day"), tmp_path, "complete")
    want = e.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert got.select("start", "event_type", "n").exceptAll(want).count() == 0 and got.count() == want.count()


def test_sessions(spark, stream_folder, tmp_path):
    folder, e = stream_folder
    got = drain(spark, events.sessions(events.watch(spark, folder)), tmp_path)
    want = e.groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").agg(F.count("*").alias("n"))
    assert 0 < got.count() <= want.count()
    assert got.select("user_id", "n", "start").exceptAll(want.select("user_id", "n", F.col("s.start"))).count() == 0


def test_transitions_keep_state(spark, stream_folder, tmp_path):
    folder, e = stream_folder
    got = drain(spark, events.transitions(events.watch(spark, folder, files_per_trigger=1)), tmp_path)
    users = e.select("user_id").distinct().count()
    assert got.agg(F.sum("n")).first()[0] == e.count() - users
