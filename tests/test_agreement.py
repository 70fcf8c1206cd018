"""Queries against their SQL on written rows of a kind that the small tables lack."""

import datetime as dt

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import rows

import __spark_entry__ as entry
from cartulary.operators import blocks, screens


@pytest.fixture
def agree(spark, tmp_path):
    """Write a table, run a query and its SQL over it, and give the rows if they agree."""

    def run(name, table, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = entry.queries()[name](spark, str(tmp_path)).toPandas()
        assert rows(got) == rows(con.execute(entry.oracle_sql()[name]).df())
        return got.to_dict("records")

    return run


def test_chains_of_events_round_their_seconds(agree):
    at = lambda h, m, s, us: dt.datetime(2024, 1, 1, h, m, s, us)
    # .then({}) has 9 characters: 391 minutes keep a chain, 392 break it; 59.7 s count as the next minute, 59.5 s too, 58.5 s do not
    times = {1: (at(0, 0, 59, 700_000), at(6, 32, 0, 0)), 2: (at(0, 0, 59, 500_000), at(6, 32, 0, 0)), 3: (at(0, 0, 58, 500_000), at(6, 32, 0, 0)), 4: (at(0, 1, 0, 0), at(6, 31, 59, 600_000))}
    events = [(10 * u + i, t, u, "click", 1.0, "{}") for u, (a, b) in times.items() for i, t in enumerate((a, b, b + dt.timedelta(seconds=1)))]
    found = agree("async_chains", "events", events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    assert sorted((r["id"], r["line"], r["depth"]) for r in found) == [(1, 1, 3), (2, 1, 3), (4, 1, 3)]


def test_labels_of_shared_blocks_are_measured_as_written(agree):
    block = lambda title, rest: f'<article class="card wide"><h1>{title}</h1><p>{rest}, so long that it is a block</p></article>'
    titles = ["a&amp;&amp;&amp; b&amp;&amp;&amp; c&amp;&amp; d &amp;", "one  &amp;  two\n&copy;", "&amp;" * 8, "&amp;" * 8 + "x", "x", "y" * 41]
    shared = "".join(block(t, f"number {i}") for i, t in enumerate(titles))
    pages = [(i, "http://x/", "".join(f"<body>{b}</article></body>" if j else f"<body>{b}</article>" for j, b in enumerate(shared.split("</article>")[:-1]))) for i in (1, 2)]
    found = agree("r19_shared_blocks", "pages", pages, "page_id long, url string, html string")
    assert sorted(r["label"] for r in found) == ["&&&&&&&&", "card", "card", "card", "card", "one & two ©"]


def test_references_that_are_cut_stay_as_they_are(spark, agree):
    html = '<title>one two &amp;&amp</title><h1>three &quo</h1><p><b>four &a &amp;amp; &copy;<br></p><div class="ad">five &am six</div>'
    found = agree("dsp_i18n_sentences", "pages", [(1, "http://x/", html)], "page_id long, url string, html string")
    assert [r["value"] for r in found] == ["one two &&amp", "three &quo", "four &a &amp; ©", "five &am six"]
    html = '<p title="a &amp;&amp b">﷐ &ltx &#38; &#x26 &nope; &</p>'
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.slot, r.value) for r in blocks.slot_table(page).orderBy("slot").collect()] == [(0, "a &&amp b"), (1, "﷐ &ltx & &#x26 &nope; &")]
    (block,) = blocks.block_table(page, least=1).collect()
    assert block.chars == len(html)
    assert [(r["where"], r.value) for r in blocks.sentences(page).orderBy("place").collect()] == [("@title", "a &&amp b"), ("p", "﷐ &ltx & &#x26 &nope; &")]


@pytest.mark.parametrize("name", ["scrape_markdown", "dsp_dom", "findings_all", "r19_shared_blocks", "dsp_i18n_sentences", "audit_unpaired"])
def test_pages_go_to_python_in_batches_of_bounded_bytes(spark, tmp_path, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.createDataFrame([(1, "http://x/", "<p>two words</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    entry.queries()[name](spark, str(tmp_path)).count()
    texts = spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] <= 10 << 20


def test_stops_that_share_a_place_leave_no_order(spark):
    """Two stops of one place: a tie of the order of reading alone, in either order of the rows."""
    stop = lambda screen, place, selector, tabindex: (screen, place, selector, "button", "name", True, False, tabindex, 8.0, 10.0, 50.0, 50.0)
    for a, b in ((0, 1), (1, 0)):
        pair = [stop("s", 1, "#1", None), stop("s", 1, "#1", 1)], [stop("t", 1, "#a", None), stop("t", 1, "#b", None)]
        df = spark.createDataFrame([p[i] for p in pair for i in (a, b)], screens.ELEMENT).coalesce(1)
        assert [(r.screen, r.kind) for r in screens.focus_findings(df).collect()] == [("s", "focus-explicit")]
