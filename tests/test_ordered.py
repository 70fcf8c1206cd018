"""Running totals, crawls under budgets, answers to requests, sentences and round trips on written input."""

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from cartulary.operators import blocks, graph, markup, ordered
from cartulary.streaming import events


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(-5, 5) if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    got = {r.i: (r.total, r.top) for r in ordered.running(df, ["g"], ["i"], {"total": ("v", "sum"), "top": ("v", "max")}).collect()}
    totals, tops, want = defaultdict(lambda: None), defaultdict(lambda: None), {}
    for g, i, v in rows:
        if v is not None:
            totals[g] = v + (totals[g] or 0)
            tops[g] = v if tops[g] is None else max(v, tops[g])
        want[i] = (totals[g], tops[g])
    assert got == want
    assert ordered.running(df.limit(0), [], ["i"], {"total": ("v", "sum")}).count() == 0


def crawl_by_queue(roots, links, pages, depth, max_pages, max_bytes):
    queue = deque((r, 0) for r in roots)
    seen, out, read, size = set(roots), [], 0, 0
    beyond = []
    while queue:
        node, level = queue.popleft()
        if read >= max_pages:
            out.append((node, level, "over the page limit"))
        elif size >= max_bytes:
            out.append((node, level, "over the byte limit"))
        elif node not in pages:
            out.append((node, level, "missing"))
        else:
            out.append((node, level, "page"))
            read, size = read + 1, size + pages[node]
            for to in links.get(node, []):
                if to not in seen:
                    seen.add(to)
                    if level + 1 > depth:
                        beyond.append((to, level + 1, "beyond depth"))
                    else:
                        queue.append((to, level + 1))
    return out + beyond


def test_crawl_is_that_of_a_queue(spark):
    rng = random.Random(9)
    pages = {f"p{i}": rng.randint(0, 50) for i in range(60)}
    links = {p: [f"p{rng.randrange(80)}" for _ in range(rng.randint(0, 5))] for p in pages}
    roots = ["p3", "p70", "p5"]
    frames = (
        spark.createDataFrame(list(zip(roots, range(3))), "node string, place long"),
        spark.createDataFrame([(a, i, b) for a, bs in links.items() for i, b in enumerate(bs)], "src string, pos long, dst string").repartition(3),
        spark.createDataFrame(list(pages.items()), "node string, bytes long"),
    )
    for depth, most, size in ((2, 1000, 10**6), (3, 12, 10**6), (3, 1000, 300), (0, 10, 10), (2, 0, 10)):
        got = [(r.node, r.depth, r.outcome) for r in graph.budgeted_crawl(*frames, depth, most, size).orderBy("place").collect()]
        assert got == crawl_by_queue(roots, links, pages, depth, most, size), (depth, most, size)


LOG = [
    (1, "a", "response"),
    (2, "a", "request"),
    (3, "a", "request"),
    (4, "a", "response"),
    (5, "a", "response"),
    (6, "a", "response"),
    (7, "a", "request"),
    (8, "b", "request"),
    (9, "a", "response"),
    (10, None, "request"),
    (11, None, "response"),
    (12, "b", "note"),
    (13, "c", "response"),
]


def test_answers_to_requests(spark):
    log = spark.createDataFrame(LOG, "seq long, address string, kind string")
    got = {(r.address, r.request, r.response) for r in ordered.first_answers(log).collect()}
    assert got == {("a", 2, 4), ("a", 3, 5), ("a", 7, 9), ("b", 8, None), (None, 10, 11)}
    rng = random.Random(6)
    rows = [(i, rng.choice("xxxy"), rng.choice(["request", "response"])) for i in range(1500)]
    waiting, want = defaultdict(deque), {}
    for seq, address, kind in rows:
        if kind == "request":
            waiting[address].append(seq)
            want[seq] = None
        elif waiting[address]:
            want[waiting[address].popleft()] = seq
    df = spark.createDataFrame(rows, "seq long, address string, kind string").repartition(6)
    assert {r.request: r.response for r in ordered.first_answers(df).collect()} == want


def test_answers_of_a_stream(spark, tmp_path):
    stamp = "CAST('2024-01-01 00:00:00' AS timestamp) + make_interval(0, 0, 0, 0, 0, 0, {})"
    batches = [
        [(1, 0, "a", "response"), (2, 1, "a", "request"), (3, 2, "a", "request"), (4, 3, "b", "request")],
        [(5, 4, "a", "response"), (6, 4, "a", "request")],  # doubled request
        [(7, 90, "c", "request"), (8, 5, "a", "response")],  # comes late, but within the watermark of the batch before
        [(9, 91, "c", "response")],
        [(10, 300, "d", "request")],
    ]
    source = tmp_path / "log"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "seq long, second int, address string, kind string")
        frame.select("seq", F.expr(stamp.format("second")).alias("ts"), "address", "kind").coalesce(1).write.mode("append").parquet(str(source))
        out = events.answers(spark.readStream.schema("seq long, ts timestamp, address string, kind string").parquet(str(source)), "10 seconds", "30 seconds")
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r.address, r.request, r.response, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", None, 1, "early"), ("a", 2, 5, "answered"), ("a", 3, 8, "answered"), ("a", 6, None, "unanswered"), ("b", 4, None, "unanswered"), ("c", 7, 9, "answered")}


def test_sentences(spark):
    html = """<title>A  title</title><div title="Say {{ it }} now" id="x">Dear <b>old</b> {{ user }}, you have {{ n + 1 }} new<br>
<a href="/m">mails</a>.<p>Inner text</p> tail text<script>var no = "copy";</script></div><p>42</p><p>//x.org/a</p><img alt="A cat"><li>open <i>end"""
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = [(r.where, r.value, r.pattern, r.bound, r.key, r.line) for r in blocks.sentences(df).orderBy("place").collect()]
    assert got == [
        ("title", "A title", "A title", False, "a_title", 1),
        ("@title", "Say now", "Say {{ it }} now", True, "say_now", 1),
        ("div", "Dear old , you have new mails.", "Dear <0>old</0> {user}, you have {value1} new<1/> <2>mails</2>.", True, "dear_old_you_have_new_mails", 1),
        ("p", "Inner text", "Inner text", False, "inner_text", 2),
        ("div", "tail text", "tail text", False, "tail_text", 2),
        ("@alt", "A cat", "A cat", False, "a_cat", 2),
        ("li", "open end", "open <0>end</0>", False, "open_end", 2),
    ]


def test_pages_that_held_and_pages_that_drifted(spark):
    pages = [(1, '<html><body a="&quot;x&amp;" b><p>one<p>two<br>&lt;three&gt;</p><ul><li>x</ul><script>if (a < b) { "</p>" }</script></body>'), (2, "text only"), (3, "<b>x</i>y"), (4, None)]
    nodes = markup.nodes(spark.createDataFrame(pages, "page_id long, html string")).cache()
    got = {r.page_id: (r.elements, r.held, r.drift) for r in markup.round_trip(nodes).collect()}
    assert got == {1: (8, True, ""), 2: (0, True, ""), 3: (1, True, "")}
    # a tag that cannot be written comes back as something else, and is named
    broken = nodes.withColumn("tag", F.when(F.col("tag") == "ul", "u l>").otherwise(F.col("tag")))
    got = {r.page_id: (r.held, r.drift) for r in markup.round_trip(broken).collect()}
    assert not got[1][0] and "u l>: 1 became 0" in got[1][1] and "u: 0 became 1" in got[1][1] and got[2][0] and got[3][0]
    nodes.unpersist()
