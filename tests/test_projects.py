"""Dependencies, specifications, screens, archetypes and dead classes on written input."""

import json

from pyspark.sql import functions as F

from cartulary.operators import archetypes, dependencies, screens, specs, styles


def test_references_and_what_they_mean(spark):
    files = spark.createDataFrame(
        [
            ("app/page.html", '<img src="logo.png"><img src=\'/img/a.png?v=2\'><video poster="./b.jpg"></video><a href="x.html">x</a><img src="{{x}}.png"><img src="https://h/c.png"><img src="gone.gif">'),
            ("css/site.css", "a { background: url( '../img/a.png' ) } b { background: url(font.woff2#iefix) } c { background: url(data:image/png;base64,x) }"),
            ("none.html", None),
        ],
        "path string, text string",
    )
    held = spark.createDataFrame([("app/logo.png",), ("./img/a.png",), ("other/b.jpg",), ("img/spare.svg",), ("css/font.woff2",)], "path string")
    refs = dependencies.references(files)
    assert {(r.file, r.target, r.kind) for r in refs.collect()} == {
        ("app/page.html", "logo.png", "markup"), ("app/page.html", "/img/a.png?v=2", "markup"), ("app/page.html", "./b.jpg", "markup"), ("app/page.html", "gone.gif", "markup"),
        ("css/site.css", "../img/a.png", "css"), ("css/site.css", "font.woff2#iefix", "css"),
    }
    hits = {r.target: r.hit for r in dependencies.resolved(refs, held).collect()}
    assert hits == {"logo.png": "app/logo.png", "/img/a.png?v=2": "img/a.png", "./b.jpg": "other/b.jpg", "gone.gif": None, "../img/a.png": "img/a.png", "font.woff2#iefix": "css/font.woff2"}
    report = {(r.path, r.state, r.n) for r in dependencies.asset_report(refs, held).collect()}
    assert ("img/a.png", "referenced", 2) in report and ("img/spare.svg", "unreferenced", 0) in report and ("gone.gif", "dead", 1) in report and len(report) == 6


def test_libraries_and_their_support(spark):
    page = '<script src="/ajax/libs/vue/2.6.14/vue.min.js"></script><script src="https://unpkg.com/@angular/core@21.0.1/x.js"></script><script src="js/jquery-1.8.3.min.js?x"></script><script src="js/own.js"></script><script src="/npm/d3@7.1/d3.js"></script>'
    libraries = dependencies.script_libraries(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html")
    manifest = {"dependencies": {"moment": "^2.29.4", "left-pad": "latest", "bootstrap": "~4"}, "devDependencies": {"vue": "git+ssh://x/v2"}}
    declared = dependencies.manifest_libraries(spark.createDataFrame([(3, json.dumps(manifest)), (4, "{"), (5, None), (6, '{"name": "x"}')], "id long, text string"), "id", "text")
    got = {(r.id, r.name, r.version, r.status, r.since) for r in dependencies.support(libraries.unionByName(declared)).collect()}
    assert got == {
        (1, "vue", "2.6.14", "end of life", "2023-12-31"),
        (1, "@angular/core", "21.0.1", "later than the table", None),
        (1, "jquery", "1.8.3", "unsupported", "2016-05-20"),
        (1, "d3", "7.1", "not assessed", None),
        (3, "moment", "2.29.4", "maintenance mode", "2020-09-15"),
        (3, "left-pad", None, "unpinned", None),
        (3, "bootstrap", "4", "end of life", "2023-01-01"),
        (3, "vue", None, "unpinned", None),
    }


SPEC = {
    "paths": {
        "/a": {
            "parameters": [{"$ref": "#/components/parameters/one"}],
            "get": {"parameters": [{"name": "q", "in": "query", "required": True}, {"name": "h", "in": "header", "required": True}, {"$ref": "#/components/parameters/loop"}, {"$ref": "#/components/parameters/gone"}]},
            "post": {},
        },
        "/b": {"get": {"parameters": [{"name": "free", "in": "query"}]}},
    },
    "components": {
        "parameters": {
            "one": {"$ref": "#/components/parameters/two"},
            "two": {"$ref": "#/components/parameters/three"},
            "three": {"name": "page", "in": "query", "required": True},
            "loop": {"$ref": "#/components/parameters/pool"},
            "pool": {"$ref": "#/components/parameters/loop"},
        }
    },
}


def test_references_of_a_specification(spark):
    df = spark.createDataFrame([(json.dumps(SPEC),)], "t string").select(F.parse_json("t").alias("spec"))
    wanted = specs.parameters(df)
    got = {(r.method, r.path, r.name, r.place, r.required, r.broken) for r in wanted.collect()}
    assert got == {
        ("GET", "/a", "page", "query", True, False),
        ("GET", "/a", "q", "query", True, False),
        ("GET", "/a", "h", "header", True, False),
        ("GET", "/a", None, None, False, True),
        ("POST", "/a", "page", "query", True, False),
        ("GET", "/b", "free", "query", False, False),
    }
    assert {r.pointer.split("/")[-1]: r.cyclic for r in specs.followed(specs.components(df)).collect()} == {"one": False, "two": False, "three": False, "loop": True, "pool": True}
    calls = spark.createDataFrame([("GET", "/a", ["q", "page"]), ("GET", "/a", ["q"]), ("GET", "/a", None), ("POST", "/a", []), ("GET", "/b", []), ("GET", "/z", [])], "method string, path string, query array<string>")
    assert {(r.method, r.name, r.calls, r.missing) for r in specs.missing_parameters(calls, wanted).collect()} == {("GET", "page", 3, 2), ("GET", "q", 3, 1), ("POST", "page", 1, 1)}


def element(screen, place, tag, name="Save it", labelled=True, disabled=False, tabindex=None, x=0.0, y=0.0, w=50.0, h=50.0):
    return (screen, place, f"#{place}", tag, name, labelled, disabled, tabindex, x, y, w, h)


def test_screen_findings(spark):
    rows = [
        element("s", 1, "button", "↻", x=0.0, y=0.0),
        element("s", 2, "input", None, False, x=100.0, y=3.0, h=20.0),
        element("s", 3, "a", None, x=50.0, y=2.0),
        element("s", 4, "p", None, w=1.0, h=1.0),
        element("t", 1, "input", x=0.0, y=100.0),
        element("t", 2, "input", x=0.0, y=0.0, tabindex=3),
        element("u", 1, "input", x=None),
        element("u", 2, "input"),
        element("v", 1, "input", y=50.0, disabled=True),
        element("v", 2, "input"),
    ]
    df = spark.createDataFrame(rows, screens.ELEMENT)
    got = {(r.screen, r.element, r.kind, r.severity) for r in screens.element_findings(df).unionByName(screens.focus_findings(df)).collect()}
    assert got == {
        ("s", "#1", "accessible-name", "high"), ("s", "#3", "accessible-name", "high"), ("s", "#2", "unlabelled-field", "high"), ("s", "#2", "tap-target", "medium"),
        ("s", "#2", "focus-order", "medium"), ("t", "#2", "focus-explicit", "medium"),
    }
    samples = spark.createDataFrame([("s", "p", "777777", "ffffff", 16.0, 400), ("t", "p", "777777", "ffffff", 16.0, 400), ("s", "h1", "949494", "ffffff", 24.0, 400), ("s", "b", "949494", "ffffff", 19.0, 700), ("s", "i", "cccccc", "ffffff", 12.0, None), ("s", "u", None, "ffffff", 12.0, None)], "screen string, tag string, color string, background string, size double, weight int")
    assert {(r.screen, r.element, r.severity) for r in screens.contrast_findings(samples).collect()} == {("s", "p", "medium"), ("s", "i", "high")}
    states = spark.createDataFrame([("s", True, True, True, False, False), ("f", False, False, False, False, False)], "screen string, fetches boolean, shows boolean, loading boolean, error boolean, empty boolean")
    assert {(r.screen, r.element, r.severity) for r in screens.state_findings(states).collect()} == {("s", "error", "high"), ("s", "empty", "medium")}


def test_archetypes(spark):
    rows = [
        (1, dict(loops=2, inputs=1, submits=1, chat_words=1, writes=1)),
        (2, dict(forms=1, inputs=3, submits=1, writes=1, components=2)),
        (3, dict(tables=1, components=1)),
        (4, dict(widgets=6, reads=1)),
    ]
    names = sorted({k for _, d in rows for k in d})
    df = spark.createDataFrame([(i, *[d.get(n) for n in names]) for i, d in rows], "id long, " + ", ".join(f"{n} int" for n in names))
    got = {}
    for r in archetypes.classify(df, ["id"]).collect():
        got.setdefault(r.id, {})[r.archetype] = r.confidence
    assert got[1]["chat"] == 1.0 and got[2]["form-entry"] == 1.0 and got[4]["selector-soup"] == 1.0
    assert 3 not in got and all(c >= 0.5 for shapes in got.values() for c in shapes.values())
    assert len(archetypes.ARCHETYPES) == 11 and all(len(s) == 4 for s in archetypes.ARCHETYPES.values())


def test_dead_classes(spark):
    pages = spark.createDataFrame([(1, '<style>.used, .dead:hover { } .built { } .named { }</style><p class="used">'), (2, "<style>.dead { } .other { }</style><i class=\"other\">")], "page_id long, html string")
    texts = spark.createDataFrame([("el.className = 'named big'; q('.built')",), (None,)], "text string")
    found = styles.dead_classes(styles.selectors(styles.sheets(pages)), styles.used_tokens(pages), texts)
    assert [(r.name, r.sheets) for r in found.collect()] == [("dead", 2)]


def entities_in_turn(shapes):
    found = []
    for endpoint, properties in shapes:
        if not properties:
            continue
        home = next((e for e in found if len(e["p"].keys() & properties.keys()) / len(e["p"].keys() | properties.keys()) >= 0.5), None)
        if home is None:
            home = {"p": {}, "names": [], "conflicts": 0}
            found.append(home)
        for k, t in properties.items():
            home["conflicts"] += k in home["p"] and home["p"][k] != t
            home["p"].setdefault(k, t)
        word = next((w for w in reversed(endpoint.split("?")[0].replace(" ", "/").split("/")) if w and not w.isdigit() and w[0] not in ":{$*" and w.lower() not in ("api", "v1")), "entity")
        home["names"].append(word.removesuffix("s"))
    return [(i, max(dict.fromkeys(e["names"]), key=e["names"].count), len(e["names"]), sorted(f"{k}:{t}" for k, t in e["p"].items()), e["conflicts"]) for i, e in enumerate(found)]


def test_entities_grow_in_order(spark):
    import random

    from cartulary.operators import greedy

    rng = random.Random(8)
    names, kinds = [f"p{i}" for i in range(14)], ["string", "number"]
    groups = {g: [(f"/api/v1/{rng.choice(['users', 'orders', 'items'])}/{rng.choice([':id', '7', ''])}", {n: rng.choice(kinds) for n in rng.sample(names, rng.randint(0, 6))}) for _ in range(120)] for g in ("a", "b", None)}
    rows = [(g, i, e, [f"{k}:{t}" for k, t in p.items()]) for g, shapes in groups.items() for i, (e, p) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "group string, seq long, endpoint string, properties array<string>").repartition(4)
    got = {}
    for r in greedy.entities(df).orderBy("entity").collect():
        got.setdefault(r.group, []).append((r.entity, r.name, r.seen, list(r.properties), r.conflicts))
    assert got == {g: entities_in_turn(shapes) for g, shapes in groups.items()}
    assert greedy.entities(df.limit(0)).count() == 0
