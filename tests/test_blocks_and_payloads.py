"""Shared blocks, their slots, payload lattices and endpoints on written input."""

import json

import pytest

from cartulary.operators import blocks, payloads

CARD = '<div class="card"><h2>{0}</h2><p>a paragraph that is long enough to be a block of its own, {1}</p></div>'


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def test_skeletons_slots_and_extent(spark):
    html = '<body>\n<div id="x" class="a b">one<br>two <b>three</b>   four</div><div class="c">unclosed<p>' + "y" * 80 + "</p>"
    df = pages(spark, html, None, "")
    found = {(r.tag, r.first): r for r in blocks.block_table(df, least=10).collect()}
    div = found["div", 2]
    assert html[7 : 7 + div.chars] == '<div id="x" class="a b">one<br>two <b>three</b>   four</div>' and (div.slots, div.first_slot, div.label) == (6, 0, "a")
    assert set(found) == {("div", 2), ("p", 6)}  # the last div never closes
    slots = [(r.slot, r.kind, r.name, r.value) for r in blocks.slot_table(df).orderBy("slot").collect()]
    assert slots[:6] == [(0, "attr", "class", "a b"), (1, "attr", "id", "x"), (2, "text", None, "one"), (3, "text", None, "two"), (4, "text", None, "three"), (5, "text", None, "four")]


def test_order_of_attributes_and_white_space_do_not_matter_and_names_do(spark):
    rows = [r.skeleton for r in blocks.block_table(pages(spark, '<p a="1" b="2">  x </p>', '<p  b="3" a="4">y z</p>', '<p a="1" c="2">x</p>', '<p a b="2">x</p>'), least=1).orderBy("page_id").collect()]
    assert rows[0] == rows[1] and len(set(rows)) == 3


def test_nested_repeats_give_the_largest_block(spark):
    same = CARD.format("Sums", "word by word the same")
    inner = "<p>a paragraph that is long enough to be a block of its own, word by word the same</p>"
    table = blocks.block_table(pages(spark, same, f"<main>{same}</main>", f"<section>{inner}</section>"))
    found = {r.tag: r for r in blocks.repeated_blocks(table).collect()}
    # the paragraph also stands alone on the third page, so it is a block beside the card
    assert set(found) == {"div", "p"} and (found["div"].pages, found["div"].uses, found["div"].label) == (2, 2, "Sums") and found["p"].pages == 3
    found = blocks.repeated_blocks(blocks.block_table(pages(spark, same, f"<main>{same}</main>"))).collect()
    assert [(r.tag, r.dynamic, r.page_id) for r in found] == [("div", False, 0)]


def test_dynamic_blocks(spark):
    bound = '<div class="row" *ngFor="let x of xs">{{ x }} and some more text to be long enough</div>'
    (found,) = blocks.repeated_blocks(blocks.block_table(pages(spark, bound, bound))).collect()
    assert found.dynamic


def test_varying_slots_of_cards(spark):
    df = pages(spark, CARD.format("Sums", "first"), CARD.format("Tables", "second"), "<main>" + CARD.format("Sums", "third") + CARD.format("Sums", "third") + "</main>", "<p>alone</p>")
    kept = blocks.varying_blocks(blocks.block_table(df))
    assert {r.tag for r in kept.collect()} == {"div"}
    found = blocks.prop_names(blocks.varying_slots(kept, blocks.slot_table(df))).orderBy("slot").collect()
    assert [(r.slot, r.kind, r.seen, r.prop) for r in found] == [(1, "text", 2, "sums"), (2, "text", 3, "paragraph")]
    assert (found[0].pages, found[0].uses, found[0].width, found[0].low, found[0].high) == (3, 4, 3, "Sums", "Tables")


def test_blocks_that_do_not_vary_are_left_to_repeats(spark):
    same = CARD.format("Sums", "first")
    assert blocks.varying_blocks(blocks.block_table(pages(spark, same, same))).count() == 0


def test_very_deep_and_empty_pages(spark):
    deep = "<div>" * 3000 + "x" * 100 + "</div>" * 3000
    table = blocks.block_table(pages(spark, deep, deep))
    assert table.count() == 6000
    (one,) = blocks.repeated_blocks(table).collect()
    assert one.chars == 3000 * 11 + 100
    assert blocks.block_table(pages(spark, "x").limit(0)).count() == 0


# payloads


def lattice_of(spark, *bodies):
    df = spark.createDataFrame([("k", b) for b in bodies], "key string, body string")
    counts = payloads.typed_paths(df, ["key"], "body")
    return {r.path: (r.type, r.nullable, r.optional, r.conflict, r.n) for r in payloads.lattice(counts, ["key"]).collect()}


def test_lattice_of_nested_and_conflicting_payloads(spark):
    found = lattice_of(
        spark,
        '{"a": 1, "b": {"c": [1, 2.5, null]}, "d": "x", "odd key": true}',
        '{"a": 2.5, "b": {"c": []}, "d": {"e": 1}}',
        '{"a": null, "b": null, "d": [[1], ["x"]]}',
        None,
        "not json",
    )
    assert found == {
        "": ("invalid|object", False, False, True, 4),
        ".a": ("number", True, False, False, 3),
        ".b": ("object", True, False, False, 3),
        ".b.c": ("array", False, False, False, 2),
        ".b.c[]": ("number", True, False, False, 3),
        ".d": ("array|object|string", False, False, True, 3),
        ".d.e": ("integer", False, False, False, 1),
        ".d[]": ("array", False, False, False, 2),
        ".d[][]": ("integer|string", False, False, False, 2),
        '."odd key"': ("boolean", False, True, False, 1),
    }


def test_lattice_of_deep_payloads_and_merged_counts(spark):
    deep = "1"
    for i in range(12):
        deep = f'{{"k{i}": {deep}}}' if i % 2 else f"[{deep}]"
    found = lattice_of(spark, deep, deep)
    assert len(found) == 13 and max(found, key=len).count("[]") == 6
    a, b = (spark.createDataFrame([("k", x)], "key string, body string") for x in ('{"v": 1}', '{"v": "s"}'))
    one, two = (payloads.typed_paths(df, ["key"], "body") for df in (a, b))
    merged = payloads.combine(one, two, keys=["key"])
    assert {r.path: r.type for r in payloads.lattice(merged, ["key"]).collect()} == {"": "object", ".v": "integer|string"}
    assert payloads.typed_paths(a.limit(0), ["key"], "body").count() == 0


def test_endpoints(spark):
    rows = [
        (1, "GET", "/api/users/7", ["q"], 200, None),
        (2, "GET", "/api/users/8", [], 404, None),
        (3, "GET", "/api/users/9", ["page", "q"], 200, None),
        (4, "GET", "/api/users/9", None, 200, None),
        (5, "GET", "/api/users/10", [], 200, None),
        (6, "POST", "/api/users", [], 201, '{"name": "x", "age": 3, "tags": []}'),
        (7, "POST", "/api/users", [], 422, "{}"),
        (8, "GET", "/api/me", [], 200, None),
        (9, "GET", "/api/us", [], None, None),
        (10, "PUT", "/login", [], 200, "name=x"),
        (11, "GET", "/", [], 200, None),
        (12, "GET", None, [], 200, None),
    ]
    df = spark.createDataFrame(rows, "seq long, method string, path string, query array<string>, status int, body string")
    found = {(r.method, r.endpoint): r for r in payloads.endpoints(df).collect()}
    users = found["GET", "/api/users/:id"]
    assert (users.params, users.query, users.statuses, users.examples, users.calls) == (["id"], ["page", "q"], [200, 404], ["7", "8", "9"], 5)
    post = found["POST", "/api/users"]
    assert (post.observed_body, post.statuses, post.params, post.examples) == ("age:integer,name:string,tags:array", [201, 422], [], [])
    assert found["PUT", "/login"].observed_body == "not json"
    assert set(found) == {("GET", "/api/users/:id"), ("POST", "/api/users"), ("GET", "/api/me"), ("GET", "/api/us"), ("PUT", "/login"), ("GET", "/")}


@pytest.mark.parametrize("body", ['"text"', "[1]", "3"])
def test_bodies_that_are_no_objects(spark, body):
    df = spark.createDataFrame([(1, "POST", "/x", [], 200, body)], "seq long, method string, path string, query array<string>, status int, body string")
    assert payloads.endpoints(df).first().observed_body == "not json" and json.loads(body)
