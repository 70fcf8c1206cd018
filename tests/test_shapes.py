"""Routes, boxes, covers, runs, steps, names, dates and maps against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from cartulary.functions import dates, maps, strings, urls
from cartulary.operators import graph, learning, shapes
from cartulary.sources import artifacts


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "base, href, want",
    [("/a/b/c.html", "../d", "/a/d"), ("/a/b/c", "./d/./e", "/a/b/d/e"), ("/a/b/c", "../../../x", "/x"), ("/a/b/", "..", "/a/"), ("/a/b", ".", "/a/"), ("/a", "//other.example/x", None), ("/a", "mailto:x", None), ("/a", "HTTP://h/x", None), ("", "x", "/x"), ("/a/b", "#top", "/a/b"), ("/a/b", "?q=1", "/a/b"), ("/a/b", "/c//d?x#y", "/c//d"), ("/a/b", "c..d", "/a/c..d")],
)
def test_links_resolve(spark, base, href, want):
    assert one(spark, urls.resolve(F.lit(base), F.lit(href))) == want


def test_endpoint_names_keep_long_segments(spark):
    assert one(spark, urls.endpoint_name(F.lit("GET"), F.lit("/" + "a" * 3000))) == "getA" + "a" * 2999


def test_nested_routes(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d"), (5, 99, "lost"), (6, 7, "x"), (7, 6, "y")]
    got = {r.id: (r.full_path, r.level) for r in shapes.flatten_paths(spark.createDataFrame(rows, "id int, parent int, segment string")).collect()}
    assert got == {1: ("/a", 0), 2: ("/a/b", 1), 3: ("/a/b/c", 2), 4: ("/d", 0)}


def test_box_spacing(spark):
    # on screen 1, b lies 16.5 below a, c 8 to the right of a; d is below both but too far; e overlaps nothing
    rows = [(1, "a", 0, 0, 100, 20), (1, "b", 10, 36.5, 50, 10), (1, "c", 108, 5, 30, 10), (1, "d", 0, 400, 100, 10), (1, "e", 500, 500, 1, 1), (2, "f", 0, 30, 100, 10)]
    boxes = spark.createDataFrame([(s, b, *map(float, r)) for s, b, *r in rows], "screen int, box string, x double, y double, w double, h double")
    got = sorted(tuple(r) for r in shapes.nearest_gaps(boxes).collect())
    assert got == [(1, "a", "x", 8), (1, "a", "y", 17)]
    assert shapes.nearest_gaps(boxes.limit(0)).count() == 0


def test_hops(spark):
    chain = [(i, i + 1) for i in range(20)]
    hops = spark.createDataFrame([*chain, (100, 101), (101, 100), (200, 200), (300, 9), (300, 305)], "src int, dst int")
    got = {r.start: (r.end, r.hops) for r in shapes.resolve_hops(spark.createDataFrame([(i,) for i in (10, 9, 20, 100, 200, 300, 555, 10)], "s int"), hops).collect()}
    assert got == {10: (20, 10), 9: (9, None), 20: (20, 0), 100: (100, None), 200: (200, None), 300: (300, None), 555: (555, 0)}
    closed = {r.src: (r.dst, r.cyclic) for r in graph.redirect_closure(hops).collect()}
    lone = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(500, 501), (501, 500), (502, 500)], "src int, dst int")
    ends = {r.src: (None if r.cyclic else r.dst) for r in graph.redirect_closure(lone).collect()}
    assert ends == {**{i: 70 for i in range(70)}, 500: None, 501: None, 502: None}
    assert graph.redirect_closure(lone.limit(0)).count() == 0
    assert closed[300] == (20, False) and closed[0] == (20, False) and closed[100][1] and len(closed) == 24


def test_cover_states(spark):
    df = lambda rows: spark.createDataFrame(rows, "host string, target string")
    got = shapes.cover_states(df([("h", "/a"), ("h", "/b"), ("h", "/c.png"), ("h", "/d.html"), ("g", "/a"), (None, "/a")]), df([("h", "/a"), ("h", "/b")]), df([("h", "/b")]), ["host", "target"], "target")
    assert {(r.host, r.target): r.state for r in got.collect()} == {("h", "/a"): "live", ("h", "/b"): "redirected", ("h", "/c.png"): "asset", ("h", "/d.html"): "uncovered", ("g", "/a"): "uncovered", (None, "/a"): "uncovered"}


def test_run_deltas(spark):
    runs = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (5, 2)], "run int, n int")
    notes = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "z"), (2, "z"), (3, "z"), (5, "w")], "run int, note string")
    got = [tuple(r) for r in shapes.run_deltas(runs, "run", "n", notes, "note").orderBy("run").collect()]
    assert got == [(1, 5, None, "first", 0, 0), (2, 7, 2, "up", 1, 1), (3, 7, 0, "same", 0, 1), (5, 2, -5, "down", 1, 1)]


def test_references_by_name():
    found = shapes.name_references({"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey", "o_key"], "nation": ["n_nationkey"], "documents": ["doc_id"], "labels": ["doc_id", "quality"]})
    assert sorted(found) == [("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"), ("orders", "o_custkey", "customer", "c_custkey")]


def test_recorded_steps(spark):
    steps = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", None), (4, "c", False)], "seq int, kind string, ok boolean")
    cases, counts = shapes.recorded_steps(steps, F.col("ok"), ["kind"], "seq")
    assert [tuple(r) for r in cases.collect()] == [("a", 1, 2)] and tuple(counts.first()) == (2, 2)


def test_robots_without_a_bound_on_rules(spark):
    rules = spark.createDataFrame([(False, "/"), (True, "/open"), (False, "/open/not"), (True, "/tie"), (False, "/tie")] + [(False, f"/r{i}") for i in range(12_000)], "allow boolean, pattern string")
    paths = spark.createDataFrame([("/open/a",), ("/open/not/x",), ("/tie",), ("/r11999",), ("/x",), (None,), ("",)], "path string")
    got = {r.path: r.allowed for r in artifacts.robots_verdicts(paths, rules).collect()}
    assert got == {"/open/a": True, "/open/not/x": False, "/tie": True, "/r11999": False, "/x": False, None: True, "": True}
    assert artifacts.robots_verdicts(paths, rules.limit(0)).where("allowed").count() == 7


@pytest.mark.parametrize("name, want", [("userName", ("UserName", "userName", "user_name", "user-name", "USER_NAME")), (" a--b  C2d ", ("ABC2d", "aBC2d", "a_b_c2d", "a-b-c2d", "A_B_C2D")), ("", ("", "", "", "", ""))])
def test_case_styles(spark, name, want):
    assert tuple(one(spark, getattr(strings, f)(F.lit(name))) for f in ("pascal", "camel", "snake", "kebab", "constant")) == want


def test_texts(spark):
    assert one(spark, strings.decoded(F.lit("a &lt;b&gt; &amp;lt; &quot;"))) == 'a <b> &lt; "'
    assert one(spark, strings.squeezed(F.lit("  a \n\t b "))) == "a b"
    assert one(spark, strings.slug(F.lit("One two, three! Four five six seven"))) == "one-two-three-four-five-six"
    assert one(spark, strings.redacted(F.lit("UA-12345"))) == "UA-1****" and one(spark, strings.redacted(F.lit("ab"))) == "ab"
    assert one(spark, strings.pseudo(F.lit("Save"))) == "[Sávé]"
    assert [tuple(r) for r in one(spark, strings.match_ranges(F.lit("Aa.aaa.A"), F.lit("aa")))] == [(0, 2), (3, 5)]
    assert [tuple(r) for r in one(spark, strings.match_ranges(F.lit("x.y.z"), F.lit(".")))] == [(1, 2), (3, 4)]
    assert one(spark, strings.match_ranges(F.lit("abc"), F.lit(""))) == [] == one(spark, strings.match_ranges(F.lit("abc"), F.lit("z")))


def test_relative_dates(spark):
    now = datetime.datetime(2024, 3, 1, 12)
    told = lambda **gap: one(spark, dates.relative(F.lit(now - datetime.timedelta(**gap)), F.lit(now)))
    assert [told(seconds=30), told(minutes=1), told(hours=-5), told(days=6), told(days=13), told(days=61), told(days=-800)] == ["just now", "1 minute ago", "in 5 hours", "6 days ago", "1 week ago", "2 months ago", "in 2 years"]


def test_maps(spark):
    m = lambda **d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.expr("cast(map() as map<string,string>)")
    assert one(spark, maps.merged(m(a="1", b="2"), m(b="3"))) == {"a": "1", "b": "3"}
    assert one(spark, maps.picked(m(a="1", b="2"), "a", "z")) == {"a": "1"} and one(spark, maps.omitted(m(a="1", b="2"), "a")) == {"b": "2"}
    assert one(spark, maps.inverted(m(a="1", b="1", c="2"))) == {"1": "b", "2": "c"} and one(spark, maps.inverted(m())) == {}
    assert one(spark, maps.changed(m(a="1", b="2", c="3"), m(b="2", c="4", d="5"))) == ["a", "c", "d"]


def test_leave_one_out_and_positions(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [0.8, 0.0]), (4, 1, [5.0, 0.0]), (5, 2, [9.0, 9.0]), (6, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    got = [tuple(r) for r in learning.leave_one_out(df, "label", "v").collect()]
    want = []
    for i, label, v in rows[:-1]:
        mean = {k: [w for j, m, w in rows if m == k and j != i] for k in (0, 1, 2)}
        far = {k: sum((sum(c) / len(c) - x) ** 2 for c, x in zip(zip(*ws), v)) for k, ws in mean.items() if ws}
        want.append((label, min(far, key=far.get)))
    assert sorted(got) == sorted(want)
    code = one(spark, learning.sinusoidal(F.lit(3), F.lit(4)))
    assert [round(x, 6) for x in code] == [0.14112, -0.989992, 0.029996, 0.99955]
    kept = learning.robustness(df.where("id < 5"), "id", "label", "v", 1e-9).collect()
    assert len(kept) == 4 and all(r.predicted == r.after for r in kept)
