"""Embedding near-duplicates and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import ann, embedding_dedup
from cartulary.llm.vectors import sample_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(n, dims, seed, spread=0.012):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dims))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dims)) * rng.choice([1, 8], size=(n, 1))
    return x.astype(np.float32)


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LISTS_PER_ROOT", 1 / 3)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    x = clusters(900, 16, 1)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(1000 + i, x[5].tolist(), 1) for i in range(50)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0), (2004, x[3].tolist(), None), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [], 0), (2008, [float("inf")] + [0.0] * 15, 1), (None, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash"))
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    usable = [(i, np.asarray(v, dtype=np.float64), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = {}, {k: k for k in range(len(usable))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (i, u, c) in enumerate(usable):
        links[a] = 0
        for b, (j, v, d) in enumerate(usable):
            if a != b and c == d and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[a] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for a, (i, *_) in enumerate(usable):
        if i is not None:
            smallest[find(a)] = min(i, smallest.get(find(a), i))
    want = {i: (links[a], smallest[find(a)]) for a, (i, *_) in enumerate(usable)}
    for r in got:
        assert (r.n_links, r.component_id) == want.get(r.id, (0, r.id))
    assert sum(r.n_links for r in got) > 500
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_probes_and_codes_lose_nothing():
    x = clusters(800, 12, 2)
    x = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    q = embedding_dedup.Quantiser.fit(x[:300], 9)
    cell, codes, error = q.encode(x)
    probes = q.probes(x, 0.2)
    far = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    for a, b in zip(*np.nonzero(far <= 0.2)):
        assert probes[a, cell[b]]
        assert q.asymmetric(x[a : a + 1], cell[b], codes[b : b + 1])[0, 0] <= 0.2 + error[b] + 1e-6


def brute(rows, query, k):
    q = np.asarray(rows[query], dtype=np.float64)
    s = [(-(np.asarray(v, dtype=np.float64) * q).sum(), i) for i, v in rows.items() if i != query and len(v) == len(q)]
    return [(i, -v) for v, i in sorted(s)[:k]]


def test_search_in_partitions(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 150)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    x = clusters(1500, 16, 4, 0.1)
    rows = {i: v.tolist() for i, v in enumerate(x)} | {5000 + i: x[20].tolist() for i in range(700)}
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()] + [(9000, None, 1), (9020, [0.0] * 16, 1), (None, x[0].tolist(), 1), (9040, [None] * 16, 0)], SCHEMA).withColumn("part", F.lit("clash"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    hit = 0
    for query, p in got.groupby("query_id"):
        p = p.sort_values("rank")
        want = brute(rows, query, 20)
        assert p["rank"].tolist() == list(range(1, 21)) and (np.diff(p.score) <= 0).all()
        hit += (p.score >= want[-1][1] - 1e-12).sum()
        if query == 20:
            assert p.vec_id.tolist() == [i for i, _ in want]
    assert got.query_id.nunique() == sum(i % 20 == 0 for i in rows)
    assert hit / len(got) >= 0.9


def test_search_of_a_given_table_goes_through_partitions(spark, monkeypatch):
    visited = []
    keep = ann.learn
    monkeypatch.setattr(ann, "learn", lambda x, parts: visited.append(parts) or keep(x, parts))
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    assert visited and min(visited) >= 4
    rows = {r.vec_id: list(r.embedding) for r in table.collect() if r.vec_id is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)}
    hit = sum((p.score >= brute(rows, q, 20)[-1][1] - 1e-9).sum() for q, p in got.groupby("query_id"))
    assert hit / len(got) >= 0.9


def test_large_partitions_are_parted_again(spark, monkeypatch):
    for name, value in (("PART_ROWS", 40), ("MAX_PARTS", 6), ("INNER_PARTS", 8)):
        monkeypatch.setattr(ann, name, value)
    made = []
    keep = ann.parted_again
    monkeypatch.setattr(ann, "parted_again", lambda *a: made.append(keep(*a)) or made[-1])
    x = clusters(4000, 16, 5)
    rows = {i: v.tolist() for i, v in enumerate(x)} | {5000 + i: x[7].tolist() for i in range(400)}
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], SCHEMA).repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    assert len(made) == 1 and isinstance(made[0][16], ann.Tree) and len(made[0][16].inner) >= 4
    hit = 0
    for query, p in got.groupby("query_id"):
        p = p.sort_values("rank")
        assert p["rank"].tolist() == list(range(1, 21)) and query not in set(p.vec_id)
        hit += (p.score >= brute(rows, query, 20)[-1][1] - 1e-9).sum()
    assert got.query_id.nunique() == 220 and hit / len(got) >= 0.9


def test_sample_counts_a_group_of_copies_once(spark):
    x = [[float(i), 1.0] for i in range(50)]
    df = spark.createDataFrame([(v,) for v in x] + [(x[3],)] * 500, "vec array<double>")
    some = sample_vectors(df, 30)
    assert len(some) == 30 == len({tuple(v) for v in some})
    assert sample_vectors(df.limit(0), 30) == []


def test_search_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [2.0, 0.0], 0), (20, [1.0], 0)], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_routing_reaches_enough_rows():
    p = np.array([[0.96, 0.03, 0.01], [0.4, 0.35, 0.25]])
    assert ann.route(p, np.array([500, 10, 10]), 100) == [[0], [0, 1, 2]]
    assert ann.route(p, np.array([5, 200, 10]), 100)[0] == [0, 1]
