"""The registered queries against their SQL, and the pipeline against a brute-force version."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartulary.llm import quality, queries, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple("" if v is None or v is pd.NA or v != v else str(v).removesuffix(".0") for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "some lonely text without an id at all", "en", "s", 5), (None, "some lonely text without an id at all", "en", "s", 5), (70001, None, None, None, None), (70002, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 3"))
    texts = docs.toPandas()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score(np.array([quality.statistics(t if isinstance(t, str) else None) for t in texts.text]))
    kept = texts[score >= quality.THRESHOLD].reset_index(drop=True)
    stage1 = corpus_pipeline.keep_quality(spark, docs, SF)
    assert stage1.columns == docs.columns and stage1.count() == len(kept)
    fps = [simhash.simhash64(t if isinstance(t, str) else None) for t in kept.text]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(kept.doc_id[i])
    want = sorted(str(min((x for x in g if x == x), default=None)) for g in groups.values())
    stage2 = corpus_pipeline.keep_one_of_each_group(spark, stage1, SF)
    got = stage2.toPandas()
    assert stage2.columns == docs.columns
    assert sorted(str(float(x)) if x == x and x is not None else "None" for x in got.doc_id) == want
    stage3 = corpus_pipeline.remove_secrets(spark, stage2, SF)
    clean = stage3.toPandas()
    assert stage3.columns == docs.columns and len(clean) == len(got)
    assert secrets.scan_secrets(stage3.where("text is not null")).where(F.size("spans") > 0).where(~F.col("text").contains("REMOVED")).count() == 0
    packed = corpus_pipeline.pack(spark, stage3, SF).toPandas()
    assert set(packed.doc_id.dropna()) == set(clean.doc_id.dropna())


def test_equal_ids_with_different_texts(spark):
    a, b = "a text that says one thing and then goes on to say more of it", "quite another line of words, which has nothing to do with the former"
    rows = [(1, b), (3, b), (3, a), (None, a), (None, "a third text, without any id, that resembles none of the others")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        kept = corpus_pipeline.keep_one_of_each_group(spark, docs.repartition(3), SF).collect()
        assert {(r.doc_id, r.text) for r in kept} == {rows[0], rows[2], rows[4]} and len(kept) == 3


def test_stages_with_clashing_names(spark):
    names = ["_label_id", "_label", "_text", "_id", "id", "fp", "class", "component_id", "row", "spans", "ids", "key", "score", "doc", "text_hash", "best"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.lit("clash"))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("a text of no id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.where(" or ".join(f"{n} <> 'clash'" for n in names)).count() == 0
        docs = out
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
