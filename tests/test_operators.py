"""Operators on small inputs of our own: edge cases that the tables do not hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.functions import numbers, urls
from cartulary.operators import graph, greedy, learning, markup, relational, text
from cartulary.plans import catalog, core_queries  # noqa: F401  (registers its queries)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_url_functions(spark):
    assert one(spark, urls.shape(F.lit("/a/{id}/b/:x/12/3"))) == "/a/*/b/*/*/*"
    assert one(spark, urls.masked(F.lit("/v2/u/a1"))) == "/v2/u/:id"
    assert one(spark, urls.endpoint_name(F.lit("GET"), F.lit("/api/users/12"))) == "getApiUsers"
    h = 2166136261
    for c in b"page=2":
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    assert one(spark, urls.fnv1a32(F.lit("page=2"))) == f"{h:08x}"


def test_number_functions(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2
    df = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "x int")
    assert df.agg(numbers.upper_median(F.col("x"))).first()[0] == 3
    assert math.isclose(one(spark, numbers.contrast(F.lit("ffffff"), F.lit("000000"))), 21)
    assert [one(spark, numbers.syllables(F.lit(w))) for w in ("the", "house", "banana")] == [1, 1, 3]


def test_medians_and_modes(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.randint(0, 9)) for _ in range(300)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, x int")
    got = {r.g: r.median for r in relational.upper_median_per_group(df, ["g"], "x").collect()}
    for g in range(4):
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == v[len(v) // 2]
    assert 9 not in got


def test_keep_first_and_diff(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None)], "k string, seq int, v string")
    assert {tuple(r) for r in relational.keep_first(df, ["k"], ["seq"]).collect()} == {("a", 1, "x"), ("b", 5, None)}
    a, b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, v string"), spark.createDataFrame([(2, "r"), (3, "s")], "k int, v string")
    assert {(r.k, r.change) for r in relational.diff(a, b, ["k"], "v").collect()} == {(1, "removed"), (2, "changed"), (3, "added")}


def test_gate_stops_above_the_ceiling(spark):
    card = relational.scorecard({"a": (spark.range(5), F.col("id") > 1), "b": None})
    assert {r.concern: r.n for r in card.collect()} == {"a": 3, "b": None}
    assert relational.gate(card, 3).first().total == 3
    with pytest.raises(Exception, match="ceiling"):
        relational.gate(card, 2).collect()


def test_redirects(spark):
    hops = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 10), (20, 20)]
    got = {r.src: (r.dst if not r.cyclic else None, r.cyclic) for r in graph.redirect_closure(spark.createDataFrame(hops, "src int, dst int")).collect()}
    assert got == {1: (4, False), 2: (4, False), 3: (4, False), 10: (None, True), 11: (None, True), 12: (None, True), 20: (None, True)}


def test_components_and_search(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9)], "a long, b long")
    assert {tuple(r) for r in graph.connected_components(edges, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    way = spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")
    assert {tuple(r) for r in graph.reachable(way, spark.createDataFrame([(0,)], "node int"), 3).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_flatten_reaches_every_sample(spark, tmp_path):
    vectors = [("a", [1.0, 2.0, 4.0]), ("a", [8.0]), ("b", []), ("b", [16.0, 32.0])]
    spark.createDataFrame(vectors, "label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["r25_nested_flatten"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("a", 4, 15.0), ("b", 2, 48.0)}


def test_components_over_all_orders(spark, tmp_path):
    rng = random.Random(5)
    orders = [(i, rng.randint(1, 60), rng.choice(["1-URGENT", "3-MEDIUM", "5-LOW"])) for i in range(70)]
    lines = [(rng.randint(0, 69), rng.randint(1, 40), float(rng.randint(1, 50))) for _ in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    customer = {k: c for k, c, _ in orders}
    for k, s, _ in lines:
        a, b = find(customer[k]), find(1000000000 + s)
        parent[max(a, b)] = min(a, b)
    want = {(v, find(v)) for v in list(parent)}
    assert len({root for _, root in want}) > 3
    got = catalog.queries()["r50_components_all"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_retrieval_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha gamma words\n\nshort\n\nbeta beta beta beta beta"), (2, None), (3, "nothing of interest in this one")], "id int, t string")
    got = text.retrieve(text.paragraphs(docs, "id", "t"), "Alpha, beta!", 5).collect()
    idf = lambda df: math.log(1 + 3 / (1 + df))
    assert [(r.id, r.pos) for r in got] == [(1, 0), (1, 2)]
    assert math.isclose(got[0].score, idf(1) * (1 + math.log(2)) + idf(2), abs_tol=1e-6)
    assert math.isclose(got[1].score, idf(2) * (1 + math.log(5)), abs_tol=1e-6)


def test_set_similarity_loses_no_pair(spark):
    rng = random.Random(4)
    base = [rng.sample(range(60), rng.randint(1, 12)) for _ in range(25)]
    sets = {i: sorted({*b, *rng.sample(range(60), rng.randint(0, 3))} - {b[0]} or {b[0]}) for i, b in enumerate(base * 5)}
    sets = {i: s for i, s in sets.items() if s not in [sets[j] for j in range(i)]}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id int, s array<string>")
    got = {(r.a, r.b): r.similarity for r in text.set_similarity(df, "id", "s").collect()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b:
                j = math.floor(len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) * 100 + 0.5) / 100
                if j >= 0.6:
                    want[a, b] = j
    assert got == want and want


def test_greedy_passes(spark):
    rows = [("h", 1, ["a", "b"]), ("h", 2, ["a", "b", "c"]), ("h", 3, ["x"]), ("h", 4, ["c", "a"]), ("k", 5, ["a"])]
    df = spark.createDataFrame(rows, "host string, id long, props array<string>")
    got = {r.id: r.entity for r in greedy.ordered_pass(df, "host", ["id"], greedy.entity_step(), "id long, entity long").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    v = spark.createDataFrame([("g", x) for x in (1.0, 2.5, 3.0, 3.5, 9.0)], "group string, value double")
    assert [r.bucket for r in sorted(greedy.ordered_pass(v, "group", ["value"], greedy.tolerance_step(2.0), "group string, value double, bucket long").collect())] == [0, 0, 0, 1, 2]
    assert greedy.raster_components([1, 0, 1, 1, 0, 0, 0, 0, 1], 3) == 3


def test_markup():
    nodes = markup.parse('<div><p>a<b>x</p></i><img src="q">t</div>')
    assert [(n[4], n[1], n[3]) for n in nodes] == [("div", -1, 0), ("p", 0, 1), ("#text", 1, 2), ("b", 1, 2), ("#text", 3, 3), ("img", 0, 1), ("#text", 0, 1)]
    assert markup.to_markdown('<h1>T</h1><script>x</script><p>a <b>b</b> <a href="/l">l</a></p><ul><li>i</li></ul>') == "# T\n\na **b** [l](/l)\n\n- i"
    assert markup.parse(None) == [] and markup.to_markdown("") == ""


def test_learning(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id int, label int, v array<double>")
    protos = learning.prototypes(df, "label", "v")
    means = np.stack([x[np.arange(40) % 3 == k].mean(axis=0) for k in range(3)])
    assert np.allclose([p for _, p in protos], means)
    d = np.linalg.norm(x[:, None] - means, axis=2)
    for r in learning.classify(df, protos, "v").collect():
        e = np.exp(-d[r.id])
        assert r.predicted == d[r.id].argmin() and math.isclose(r.confidence, e.max() / e.sum(), rel_tol=1e-9)
        assert math.isclose(r.margin, np.sort(d[r.id])[1] - d[r.id].min(), rel_tol=1e-9)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose([r.v for r in learning.standardized(df, "v").orderBy("id").collect()], z)
    norm = df.select(learning.layer_norm(F.col("v"), 0.0).alias("v")).first().v
    assert np.allclose(norm, (x[0] - x[0].mean()) / x[0].std())
    out = learning.attention(df.withColumn("g", F.lit(1)), "g", "id", "v", 2).orderBy("id").collect()
    for i in (0, 1, 7):
        k = x[max(0, i - 2) : i + 1]
        w = np.exp(k @ x[i] / 2)
        assert np.allclose(out[i].mixed, (w / w.sum()) @ k)
