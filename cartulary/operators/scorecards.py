"""Four scorecards, each concern with its own measure: how many are wanting, of how many.

A concern that was measured and found nothing has a zero; one whose measure did
not run (``only`` leaves it out) has no number. Node measures are counted in one
pass over the stored node table; those that need a join come from the audits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from . import audits, markup, scripts
from .audits import attr, has, present

#: Sizes of a page's tree from which it is large: fixed values.
MOST_NODES, MOST_DEPTH, MOST_CHILDREN = 1500, 32, 60
CARD = "card string, concern string, present boolean, n long, of long"

#: Texts that tell of a consent mechanism, of cookies that scripts write, and of trackers.
CONSENT = r"(?i)cookieconsent|onetrust|cookiebot|osano|gtag\(\s*['\"]consent['\"]"
COOKIE_WRITE = r"document\.cookie\s*=[^=]|Cookies\.set\(|\$\.cookie\("
TRACKERS = {"tag manager": r"googletagmanager|gtag\(", "analytics": r"google-analytics\.com|_gaq\b", "pixel": r"fbq\(|connect\.facebook\.net", "matomo": r"_paq\b", "hotjar": r"hotjar\.com|\bhj\("}
SHARP = {"inner-html": r"\.innerHTML\s*=[^=]", "eval": r"\beval\s*\(", "document-write": r"document\.write(?:ln)?\s*\(", "script-scheme": r"(?i)[\"']javascript:"}
HABITS = {"sync-request": r"\.open\s*\([^)]*,\s*false\s*\)", "document-write": r"document\.write(?:ln)?\s*\(", "poll": r"setInterval\s*\("}
_FOCUS_CALL = r"\.focus\s*\(\s*\)"

#: The concerns of each card in order.
CARDS = {
    "accessibility": ("landmarks", "control names", "focus", "media captions", "tables", "keyboard", "iframes"),
    "security": ("markup and script", "supply chain", "iframe sandbox", "cookies and consent", "trackers"),
    "performance": ("script habits", "first paint", "inline style and script", "images", "dom size", "fonts"),
    "lifecycle": ("timers", "listeners", "observers"),
}


def _sum(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def node_measures(nodes: DataFrame) -> DataFrame:
    """One row with the measures that a node shows by itself."""
    tag = F.col("tag")
    frame, image, video = tag == "iframe", (tag == "img") & ~F.coalesce(attr("src").startswith("data:"), F.lit(False)), tag == "video"
    foreign = frame & F.coalesce(attr("src").rlike("^(https?:)?//"), F.lit(False))
    wanting = image & ~(present("alt") & has("width") & has("height") & F.coalesce(attr("loading") == "lazy", F.lit(False)) & has("srcset"))
    handlers = F.size(F.filter(F.map_keys("attrs"), lambda k: k.rlike("^on[a-z]+$")))
    return nodes.agg(
        _sum(frame & ~has("title")).alias("untitled"), _sum(frame).alias("frames"), _sum(foreign & ~present("sandbox")).alias("unsandboxed"), _sum(foreign).alias("foreign"),
        _sum(video).alias("videos"), _sum(tag == "table").alias("tables"), _sum(wanting).alias("wanting"), _sum(image).alias("images"),
        _sum((F.coalesce(attr("tabindex").try_cast("int"), F.lit(0)) > 0) | present("autofocus") | present("accesskey")).alias("focus"),
        (_sum(present("style")) + _sum(tag == "style") + _sum((tag == "script") & ~has("src"))).alias("inline"),
        F.coalesce(F.sum(F.when(tag != "#text", handlers)), F.lit(0)).alias("handlers"),
    )


def font_faces(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(face, gap)``: font faces of style blocks; a gap has no woff2, an old format, or no font-display."""
    face = F.explode(F.regexp_extract_all(html_col, F.lit(r"(?is)@font-face\s*\{[^}]*\}"), F.lit(0)))
    old = F.col("face").rlike(r"(?i)\.(eot|svg|ttf)\b|format\(\s*['\"](embedded-opentype|svg|truetype)")
    return pages.select(face.alias("face")).withColumn("gap", ~F.col("face").rlike(r"(?i)woff2") | old | ~F.col("face").rlike(r"(?i)font-display\s*:"))


def scorecards(pages: DataFrame, nodes: DataFrame, only: set[str] | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(card, concern, present, n, of)``; ``nodes``: the stored node table of ``pages``; ``only``: the concerns that are measured."""
    spark = pages.sparkSession
    # one pass over the pages for all patterns: a row for each rule, and one over the nodes
    rules = {f"{concern}/{rule}": pattern for concern, kinds in (("focus", {"call": _FOCUS_CALL}), ("sharp", SHARP), ("cookies", {"write": COOKIE_WRITE, "consent": CONSENT}), ("trackers", TRACKERS), ("habits", HABITS)) for rule, pattern in kinds.items()}
    rules |= {f"opened/{kind}": pattern for pattern, _, kind in scripts.PAIRED}
    hits = materialize(scripts.matches(pages, rules, id_col, html_col).groupBy("rule").agg(F.count("*").alias("hits")))
    left = materialize(scripts.unpaired(pages, id_col, html_col).groupBy(F.concat(F.lit("opened/"), "kind").alias("rule")).agg(F.count("*").alias("hits")))
    by_node = materialize(node_measures(nodes))
    rows: dict[str, DataFrame] = {}

    def of(name: str, concern: str, table: DataFrame = hits) -> DataFrame:
        """One row: how often the rules of a concern match."""
        return table.where(F.col("rule").startswith(f"{concern}/")).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias(name))

    def one(concern: str, df: DataFrame, n: Column, total: Column | None = None) -> None:
        rows[concern] = df.agg(F.coalesce(n, F.lit(0)).alias("n"), (total if total is not None else F.lit(None)).alias("of"))

    def with_nodes(concern: str, n: Column, total: Column | None = None, *others: DataFrame) -> None:
        joined = by_node
        for other in others:
            joined = joined.crossJoin(other)  # one row each
        rows[concern] = joined.select(n.alias("n"), (total if total is not None else F.lit(None)).alias("of"))

    gaps = audits.landmarks(nodes).select("page_id").distinct().withColumn("gap", F.lit(True))
    one("landmarks", nodes.select("page_id").distinct().join(gaps, "page_id", "left"), F.count_if("gap"), F.count("*"))
    one("control names", audits.unlabelled_controls(nodes), F.count("*"))
    with_nodes("focus", F.col("focus") + F.col("calls"), None, of("calls", "focus"))
    with_nodes("media captions", F.col("silent"), F.col("videos"), audits.media(nodes).where("kind = 'no-captions'").agg(F.count("*").alias("silent")))
    with_nodes("tables", F.col("gaps"), F.col("tables"), audits.data_tables(nodes).where("kind in ('no-caption', 'header-without-scope')").agg(F.count("*").alias("gaps")))
    one("keyboard", audits.keyboard(nodes).where("kind = 'no-tabindex'"), F.count("*"))
    with_nodes("iframes", F.col("untitled"), F.col("frames"))

    with_nodes("markup and script", F.col("handlers") + F.col("calls") + F.col("links"), None, of("calls", "sharp"), audits.blank_targets(nodes).agg(F.count("*").alias("links")))
    one("supply chain", audits.supply_chain(nodes), F.count_if(~F.col("integrity")), F.count("*"))
    with_nodes("iframe sandbox", F.col("unsandboxed"), F.col("foreign"))
    one("cookies and consent", hits, F.when(F.sum(F.when(F.col("rule") == "cookies/consent", F.col("hits"))) > 0, 0).otherwise(F.sum(F.when(F.col("rule") == "cookies/write", F.col("hits")))))
    one("trackers", hits, F.count_if(F.col("rule").startswith("trackers/")))

    rows["script habits"] = of("n", "habits").withColumn("of", F.lit(None))
    one("first paint", audits.render_blocking(nodes), F.count("*"))
    with_nodes("inline style and script", F.col("inline"))
    with_nodes("images", F.col("wanting"), F.col("images"))
    large = (F.col("elements") > MOST_NODES) | (F.col("depth") > MOST_DEPTH) | (F.coalesce("widest", F.lit(0)) > MOST_CHILDREN)
    one("dom size", markup.dom_summary(nodes), F.count_if(large), F.count("*"))
    one("fonts", font_faces(pages, html_col), F.count_if("gap"), F.count("*"))

    pairs = {"timers": ("interval-never-cleared", "timeout-never-cleared", "frame-never-cancelled"), "listeners": ("listener-never-removed",), "observers": ("observer-never-disconnected",)}
    for concern, kinds in pairs.items():
        mine = F.col("rule").isin(*[f"opened/{kind}" for kind in kinds])
        total = lambda table, name: table.where(mine).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias(name))  # noqa: E731, B023
        rows[concern] = total(left, "n").crossJoin(total(hits, "of"))  # one row each

    out = None
    for card, concerns in CARDS.items():
        for concern in concerns:
            measured = only is None or concern in only
            row = rows[concern] if measured else spark.range(1).select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("of"))
            row = row.select(F.lit(card).alias("card"), F.lit(concern).alias("concern"), F.lit(measured).alias("present"), F.col("n").cast("long").alias("n"), F.col("of").cast("long").alias("of"))
            out = row if out is None else out.unionByName(row)
    return out


def totals(card: DataFrame) -> DataFrame:
    """``(card, measured, total)``: what is wanting on each card, over the concerns that were measured."""
    return card.groupBy("card").agg(F.count_if("present").alias("measured"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
