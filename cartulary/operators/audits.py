"""Audits of the node table: joins that tell what a pattern cannot.

Every audit takes nodes (``markup.nodes``) or findings of all pages and returns
``(page_id, line, kind, detail)``, one row a finding. Pages are keys of every
join, so all of them run as shuffles on page and id; nothing is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("page_id", "line", "kind", "detail")


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def has(name: str) -> Column:
    return F.coalesce(F.length(F.trim(attr(name))) > 0, F.lit(False))


def present(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", F.lit(name)), F.lit(False))


def issues(rows: DataFrame, detail: Column, **kinds: Column) -> DataFrame:
    """A finding for each condition that holds; underscores of a kind become hyphens."""
    named = F.array_compact(F.array(*[F.when(condition, F.lit(kind.replace("_", "-"))) for kind, condition in kinds.items()]))
    return rows.select("page_id", "line", F.explode(named).alias("kind"), F.coalesce(detail, F.lit("")).alias("detail"))


def unlabelled_controls(nodes: DataFrame) -> DataFrame:
    """Controls without a label for their id, a wrapping label, or a name of their own."""
    named = has("aria-label") | has("aria-labelledby") | has("title")
    silent = F.coalesce(attr("type").isin("hidden", "submit", "button", "reset", "image"), F.lit(False))
    controls = nodes.where(F.col("tag").isin("input", "select", "textarea") & ~named & ~silent).select("page_id", "line", "parent_id", "tag", attr("id").alias("id"), attr("name").alias("name"))
    targets = nodes.where((F.col("tag") == "label") & has("for")).select("page_id", attr("for").alias("id")).distinct()
    wrapping = nodes.where("tag = 'label'").select("page_id", F.col("node_id").alias("parent_id"))
    left = controls.join(targets, ["page_id", "id"], "left_anti").join(wrapping, ["page_id", "parent_id"], "left_anti")
    return left.select("page_id", "line", F.lit("no-label").alias("kind"), F.coalesce("name", "id", "tag").alias("detail"))


def dangling_references(nodes: DataFrame) -> DataFrame:
    """Ids in aria-labelledby, aria-describedby, aria-controls and label-for that no element of the page has."""
    names = ("aria-labelledby", "aria-describedby", "aria-controls")
    pairs = F.array(*[F.struct(F.lit(n).alias("kind"), attr(n).alias("ids")) for n in names], F.struct(F.lit("label-for").alias("kind"), F.when(F.col("tag") == "label", attr("for")).alias("ids")))
    asked = nodes.select("page_id", "line", F.explode(pairs).alias("p")).where("p.ids is not null")
    asked = asked.select("page_id", "line", "p.kind", F.explode(F.filter(F.split("p.ids", r"\s+"), lambda x: x != "")).alias("detail"))
    known = nodes.where(has("id")).select("page_id", attr("id").alias("detail")).distinct()
    return asked.join(known, ["page_id", "detail"], "left_anti").select(*COLUMNS)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that several elements of a page have."""
    ids = nodes.where(has("id")).groupBy("page_id", attr("id").alias("detail")).agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return ids.where("n > 1").select("page_id", "line", F.lit("duplicate-id").alias("kind"), "detail")


def heading_skips(nodes: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    levels = nodes.where(F.col("tag").rlike("^h[1-6]$")).select("page_id", "node_id", "line", F.substring("tag", 2, 1).cast("int").alias("level"))
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("node_id"))
    skipped = levels.withColumn("before", before).where("level > before + 1")
    return skipped.select("page_id", "line", F.lit("heading-skip").alias("kind"), F.concat(F.lit("h"), "before", F.lit(" to h"), "level").alias("detail"))


def images(nodes: DataFrame) -> DataFrame:
    """Images without alternative text, size, lazy loading or alternatives by width."""
    shown = nodes.where((F.col("tag") == "img") & ~F.coalesce(attr("src").startswith("data:"), F.lit(False)))
    return issues(shown, attr("src"), no_alt=~present("alt"), no_size=~(has("width") & has("height")), not_lazy=~F.coalesce(attr("loading") == "lazy", F.lit(False)), no_srcset=~has("srcset"))


def iframes(nodes: DataFrame) -> DataFrame:
    return issues(nodes.where("tag = 'iframe'"), attr("src"), no_title=~has("title"), no_sandbox=~present("sandbox"), third_party=F.coalesce(attr("src").rlike("^(https?:)?//"), F.lit(False)))


def media(nodes: DataFrame) -> DataFrame:
    """Video and audio without controls or captions, or that begin by themselves."""
    tracks = nodes.where("tag = 'track'").select("page_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("track")).distinct()
    players = nodes.where(F.col("tag").isin("video", "audio")).join(tracks, ["page_id", "node_id"], "left")
    return issues(players, F.coalesce(attr("src"), "tag"), no_controls=~present("controls"), autoplay=present("autoplay") & ~present("muted"), no_captions=(F.col("tag") == "video") & F.col("track").isNull())


def data_tables(nodes: DataFrame) -> DataFrame:
    """Tables without caption or header cells, and header cells without scope."""
    inside = nodes.where(F.col("tag").isin("caption", "th")).select(F.col("page_id").alias("page"), "tag", F.col("node_id").alias("at"), has("scope").alias("scoped"))
    tables = nodes.where("tag = 'table'").select("page_id", "line", "node_id", "last_id", "attrs")
    around = tables.select("page_id", "node_id", "last_id").join(inside, (F.col("page") == F.col("page_id")) & F.col("at").between(F.col("node_id"), F.col("last_id")))
    nearest = around.groupBy("page_id", "at").agg(F.max("node_id").alias("node_id"), F.any_value("tag").alias("tag"), F.any_value("scoped").alias("scoped"))
    cells = nearest.groupBy("page_id", "node_id").agg(F.count_if(F.col("tag") == "caption").alias("captions"), F.count_if(F.col("tag") == "th").alias("heads"), F.count_if((F.col("tag") == "th") & ~F.col("scoped")).alias("loose"))
    seen = tables.join(cells, ["page_id", "node_id"], "left").fillna(0, ["captions", "heads", "loose"])
    layout = F.coalesce(attr("role").isin("presentation", "none"), F.lit(False))
    return issues(seen.where(~layout), attr("id"), no_caption=F.col("captions") == 0, no_header=F.col("heads") == 0, header_without_scope=F.col("loose") > 0)


def landmarks(nodes: DataFrame) -> DataFrame:
    """Pages without or with several main regions, or without navigation."""
    role = F.coalesce(attr("role"), F.lit(""))
    seen = nodes.groupBy("page_id").agg(F.count_if((F.col("tag") == "main") | (role == "main")).alias("mains"), F.count_if((F.col("tag") == "nav") | (role == "navigation")).alias("navs"))
    return issues(seen.withColumn("line", F.lit(1)), F.lit(None), no_main=F.col("mains") == 0, several_mains=F.col("mains") > 1, no_nav=F.col("navs") == 0)


def keyboard(nodes: DataFrame) -> DataFrame:
    """Click handlers on elements that the keyboard does not reach."""
    native = F.col("tag").isin("a", "button", "input", "select", "textarea", "summary", "option", "label")
    return issues(nodes.where(present("onclick") & ~native), F.col("tag"), no_tabindex=~present("tabindex"), no_role=~has("role"), no_key_handler=~(present("onkeydown") | present("onkeyup") | present("onkeypress")))


def blank_targets(nodes: DataFrame) -> DataFrame:
    """Links that open a window which can reach back."""
    safe = F.coalesce(attr("rel").rlike("(^|\\s)(noopener|noreferrer)(\\s|$)"), F.lit(False))
    return issues(nodes.where((F.col("tag") == "a") & (attr("target") == "_blank")), attr("href"), blank_without_noopener=~safe)


def render_blocking(nodes: DataFrame) -> DataFrame:
    """Scripts and style sheets in the head that hold up the first paint."""
    heads = nodes.where("tag = 'head'").select(F.col("page_id").alias("page"), F.col("node_id").alias("head"), F.col("last_id").alias("head_end"))
    inside = nodes.where(F.col("tag").isin("script", "link")).join(heads, (F.col("page") == F.col("page_id")) & F.col("node_id").between(F.col("head"), F.col("head_end")))
    script = (F.col("tag") == "script") & has("src") & ~present("async") & ~present("defer") & ~F.coalesce(attr("type") == "module", F.lit(False))
    sheet = (F.col("tag") == "link") & F.coalesce(attr("rel") == "stylesheet", F.lit(False)) & ~F.coalesce(attr("media") == "print", F.lit(False))
    return issues(inside, F.coalesce(attr("src"), attr("href")), head_script=script, head_style=sheet)


def supply_chain(nodes: DataFrame) -> DataFrame:
    """``(url, host, pages, integrity, crossorigin)``: foreign scripts and style sheets by address."""
    url = F.when(F.col("tag") == "script", attr("src")).when((F.col("tag") == "link") & (attr("rel") == "stylesheet"), attr("href"))
    foreign = nodes.select("page_id", url.alias("url"), present("integrity").alias("sri"), present("crossorigin").alias("cross")).where(F.col("url").rlike("^(https?:)?//"))
    grouped = foreign.groupBy("url").agg(F.count_distinct("page_id").alias("pages"), F.bool_or("sri").alias("integrity"), F.bool_or("cross").alias("crossorigin"))
    return grouped.select("url", F.regexp_extract("url", "^(?:https?:)?//([^/?#]*)", 1).alias("host"), "pages", "integrity", "crossorigin")


def unused_classes(nodes: DataFrame) -> DataFrame:
    """Classes that a page's style blocks declare and no element of the page has."""
    blocks = nodes.where("tag = 'style'").select("page_id", F.col("node_id").alias("parent_id"))
    rules = nodes.where("tag = '#text'").join(blocks, ["page_id", "parent_id"]).select("page_id", "line", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"\{[^}]*\}", "{}"), F.lit(r"\.(-?[A-Za-z_][A-Za-z0-9_-]*)"))).alias("detail"))
    declared = rules.groupBy("page_id", "detail").agg(F.min("line").alias("line"))
    used = nodes.where(has("class")).select("page_id", F.explode(F.split(F.trim(attr("class")), r"\s+")).alias("detail")).distinct()
    return declared.join(used, ["page_id", "detail"], "left_anti").select("page_id", "line", F.lit("unused-class").alias("kind"), "detail")


def inline_code(nodes: DataFrame) -> DataFrame:
    """``(page_id, style_attributes, style_blocks, inline_scripts, handlers)`` of each page with nodes."""
    handlers = F.size(F.filter(F.map_keys("attrs"), lambda k: k.rlike("^on[a-z]+$")))
    return nodes.groupBy("page_id").agg(
        F.count_if(present("style")).alias("style_attributes"),
        F.count_if(F.col("tag") == "style").alias("style_blocks"),
        F.count_if((F.col("tag") == "script") & ~has("src")).alias("inline_scripts"),
        F.coalesce(F.sum(F.when(F.col("tag") != "#text", handlers)), F.lit(0)).alias("handlers"),
    )


AUDITS = (unlabelled_controls, dangling_references, duplicate_ids, heading_skips, images, iframes, media, data_tables, landmarks, keyboard, blank_targets, render_blocking, unused_classes)


def all_audits(nodes: DataFrame) -> DataFrame:
    """``(audit, page_id, line, kind, detail)`` of every audit of a stored node table."""
    parts = [a(nodes).select(F.lit(a.__name__).alias("audit"), *COLUMNS) for a in AUDITS]
    return reduce(DataFrame.unionByName, parts)
