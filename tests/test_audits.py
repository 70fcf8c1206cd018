"""Findings, audits, source measures and interface style on hand-written pages with known faults."""

import re

import pytest
from pyspark.sql import functions as F

from cartulary.operators import analyzers, api_style, audits, findings, markup, scripts, source_code

FORM = """<html><head><title>t</title>
<link rel="stylesheet" href="//cdn.example.net/a.css"><script src="/js/a.js"></script><script src="/js/b.js" defer></script>
<style>.used { color: red } .spare, .card:hover { margin: 0.5em }</style></head>
<body><nav></nav>
<label for="mail">Mail</label><input id="mail" type="email">
<input name="age"><label>Name <input name="who"></label><input type="hidden" name="h"><select id="s" aria-label="S"></select>
<p class="used" id="p1" aria-describedby="p1 gone">x</p><p id="p1">y</p><label for="nothing">n</label>
<h1>a</h1><h3>b</h3><h2>c</h2>
<img src="a.png"><img src="data:x"><img src="b.png" alt="" width="1" height="1" loading="lazy" srcset="c">
<iframe src="https://video.example.org/1"></iframe><iframe title="t" sandbox src="/own"></iframe>
<video src="v.mp4" autoplay></video><video controls muted autoplay src="w.mp4"><track src="t.vtt"></video>
<table id="t1"><tr><td><table id="t2"><caption>c</caption><tr><th>h</th></tr></table></td></tr></table><table role="none"></table>
<div onclick="go()">go</div><span onclick="go()" tabindex="0" role="button" onkeydown="go()">ok</span><button onclick="go()">b</button>
<a target="_blank" href="/out">o</a><a target="_blank" rel="noopener" href="/safe">s</a></body></html>"""
SCRIPT = """<html><body><main></main><main></main><script src="https://cdn.example.net/x.js" integrity="sha" crossorigin></script><script>
window.addEventListener("resize", f);
window.addEventListener('scroll', f); window.removeEventListener('scroll', f);
setInterval(tick, 10);
setTimeout(tick, 10); clearTimeout(t);
new ResizeObserver(f);
localStorage.setItem("seen", 1); localStorage.setItem("kept", 1); localStorage.getItem("kept");
</script></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, FORM), (2, SCRIPT), (3, ""), (4, None)], "page_id long, html string")


@pytest.fixture(scope="module")
def nodes(spark, pages):
    return spark.createDataFrame(markup.nodes(pages).collect(), markup.NODES)


def got(df):
    return sorted((r.page_id, r.line, r.kind, r.detail) for r in df.collect())


EXPECTED = {
    audits.unlabelled_controls: [(1, 6, "no-label", "age")],
    audits.dangling_references: [(1, 7, "aria-describedby", "gone"), (1, 7, "label-for", "nothing")],
    audits.duplicate_ids: [(1, 7, "duplicate-id", "p1")],
    audits.heading_skips: [(1, 8, "heading-skip", "h1 to h3")],
    audits.images: [(1, 9, k, "a.png") for k in ("no-alt", "no-size", "no-srcset", "not-lazy")],
    audits.iframes: [(1, 10, k, "https://video.example.org/1") for k in ("no-sandbox", "no-title", "third-party")],
    audits.media: [(1, 11, k, "v.mp4") for k in ("autoplay", "no-captions", "no-controls")],
    audits.data_tables: [(1, 12, "header-without-scope", "t2"), (1, 12, "no-caption", "t1"), (1, 12, "no-header", "t1")],
    audits.landmarks: [(1, 1, "no-main", ""), (2, 1, "no-nav", ""), (2, 1, "several-mains", "")],
    audits.keyboard: [(1, 13, k, "div") for k in ("no-key-handler", "no-role", "no-tabindex")],
    audits.blank_targets: [(1, 14, "blank-without-noopener", "/out")],
    audits.render_blocking: [(1, 2, "head-script", "/js/a.js"), (1, 2, "head-style", "//cdn.example.net/a.css")],
    audits.unused_classes: [(1, 3, "unused-class", "card"), (1, 3, "unused-class", "spare")],
}


@pytest.mark.parametrize("audit", EXPECTED, ids=lambda a: a.__name__)
def test_audit(nodes, audit):
    assert got(audit(nodes)) == EXPECTED[audit]


def test_every_audit_has_its_expectation(nodes):
    assert set(EXPECTED) == set(audits.AUDITS)
    assert audits.all_audits(nodes).count() == sum(map(len, EXPECTED.values()))
    assert audits.all_audits(nodes.limit(0)).count() == 0


def test_supply_chain_groups_by_address(nodes):
    rows = sorted(tuple(r) for r in audits.supply_chain(nodes).collect())
    assert rows == [("//cdn.example.net/a.css", "cdn.example.net", 1, False, False), ("https://cdn.example.net/x.js", "cdn.example.net", 1, True, True)]


def test_unpaired(pages):
    want = [(2, 2, "listener-never-removed", "resize"), (2, 4, "interval-never-cleared", ""), (2, 6, "observer-never-disconnected", ""), (2, 7, "stored-never-read", "seen")]
    assert got(scripts.unpaired(pages)) == sorted(want)


def test_inline_code(nodes):
    rows = {r.page_id: tuple(r)[1:] for r in audits.inline_code(nodes).collect()}
    assert rows == {1: (0, 1, 0, 4), 2: (0, 0, 1, 0)}


def test_findings_are_those_of_plain_regexes(spark, pages):
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    both = pages.unionByName(real.withColumn("page_id", F.col("page_id") + 100))
    want = []
    for page_id, html in both.collect():
        for analyzer, kinds in analyzers.ANALYZERS.items():
            for kind, pattern in kinds:
                want += [(page_id, analyzer, kind, html.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer(pattern, html or "")]
    found = findings.findings(both).collect()
    assert sorted((r.page_id, r.analyzer, r.kind, r.line, r.evidence) for r in found) == sorted(want) and len(want) > 100
    lines = {(r.kind, r.line) for r in found if r.page_id == 2 and r.analyzer == "timers"}
    assert lines == {("interval", 4), ("timeout", 5), ("clear", 5)}


def test_report_and_scorecard(spark, pages):
    found = findings.findings(pages)
    report = {(r.analyzer, r.kind): (r.hits, r["pages"]) for r in findings.report(found).collect()}
    assert len(report) == sum(map(len, analyzers.ANALYZERS.values()))
    assert report["storage", "local"] == (3, 1) and report["timers", "interval"] == (1, 1) and report["console", "log"] == (0, 0)
    cards = {r.analyzer: r for r in findings.scorecard(found, pages).collect()}
    assert cards["security"].worst == "medium" and cards["security"]["pages"] == 1 and cards["security"].share == 0.25 and cards["security"].passes
    assert findings.report(found.limit(0)).agg(F.sum("hits")).first()[0] == 0
    assert set(cards) == set(analyzers.ANALYZERS)
    clean = findings.scorecard(found.limit(0), pages).collect()
    assert len(clean) == len(analyzers.ANALYZERS) and all((r.findings, r.worst, r["pages"], r.share, r.passes) == (0, "none", 0, 0.0, True) for r in clean)


def test_mandatory_texts():
    assert findings.mandatory(r"\.then\(") == ".then(" and findings.mandatory(r"gtag\(|dataLayer") == "" and findings.mandatory(r"a?bc[0-9]+defg") == "defg"
    for kinds in analyzers.ANALYZERS.values():
        for _, pattern in kinds:
            re.compile(pattern)


def test_functions_and_their_measures(spark):
    source = "var a = 1;\nfunction one(x) {\n  if (x && a) { return x ? 1 : 2; }\n}\nconst two = (y) => {\n  for (;;) { while (y) { if (y) { if (a) { y--; } } } }\n};\nfunction ("
    assert source_code.functions_of(source) == [("one", 2, 3, 2, 3), ("two", 5, 3, 5, 4)]
    df = spark.createDataFrame([(1, source), (2, None), (3, "")], "page_id long, html string")
    rows = source_code.complex_functions(source_code.complexity(df)).collect()
    assert [(r.name, r.weight) for r in rows] == [("two", 3 + 50 + 4)]
    odd = """class A { get(x = f(1)) { return "}" + `{`; } // }
  async run() { if (x) { } else { switch (y) { case 1: } } } }
const h = async z => { }; if (a) { b }"""
    assert source_code.functions_of(odd) == [("get", 1, 1, 1, 0), ("run", 2, 1, 3, 2), ("h", 3, 1, 1, 0)]
    nested = "function f() {" * 4000 + "}" * 4000
    assert [f[3] for f in source_code.functions_of(nested)] == list(range(4000, 0, -1))


def test_interface_style(spark):
    paths = ["/api/v2/order-items/7?page=1&per_page=5", "/api/V2/order_items/{id}", "/orderItems/getAll?cursor=x&q=1", "/settings", None, ""]
    rows = {(r.aspect, r.value): r.n for r in api_style.census(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert rows == {
        ("case", "single word"): 3, ("case", "kebab"): 1, ("case", "snake"): 1, ("case", "camel"): 2, ("version", "v2"): 2,
        ("noun", "plural"): 4, ("noun", "singular"): 3, ("verb", "getAll"): 1, ("paging", "page number"): 2, ("paging", "cursor"): 1,
    }
