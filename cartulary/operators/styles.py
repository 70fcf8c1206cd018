"""Style sheets: what makes them hard to carry, and selectors that nothing on any page has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import bound, running_sums

#: Levels from which a selector is deep, and how often a declaration is repeated before it is told: fixed values.
DEEP, REPEATED = 4, 4
_HEAD = r"(?:^|\})\s*([^{}@]+)\{"
_RULE = r"(?:^|\})\s*[^{}@]+\{[^{}]*"


def sheets(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(sheet, css)``: the style blocks of each page as one sheet; pages without any have none."""
    blocks = F.regexp_extract_all(html_col, F.lit(r"(?is)<style[^>]*>(.*?)</style>"))
    return pages.select(F.col(id_col).alias("sheet"), F.array_join(blocks, "\n").alias("css")).where("css <> ''")


def bare(css: Column) -> Column:
    """A sheet with strings emptied and comments blanked, line ends kept, so that what stands in either is not counted."""
    text = F.regexp_replace(css, r'"(?:\\.|[^"\\])*+"|\'(?:\\.|[^\'\\])*+\'', '""')
    comment = r"(?s)/\*.*?\*/"
    lines = lambda c: F.regexp_replace(c, "[^\n]", "")
    pieces, comments = F.split(text, comment, -1), F.regexp_extract_all(text, F.lit(comment), F.lit(0))
    return F.array_join(F.zip_with(pieces, comments, lambda p, c: F.concat(p, F.coalesce(lines(c), F.lit("")))), "")


def selectors(sheet_table: DataFrame) -> DataFrame:
    """``(sheet, place, line, selector)``: every selector of every rule, in order."""
    text = sheet_table.select("sheet", bare(F.col("css")).alias("css"))
    cut = text.select("sheet", F.regexp_extract_all("css", F.lit(_HEAD)).alias("heads"), F.split("css", _HEAD, -1).alias("between"), F.regexp_extract_all("css", F.lit(_HEAD), F.lit(0)).alias("whole"))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rules = F.zip_with(F.slice("between", F.lit(1), F.size("whole")), "whole", lambda b, w: F.struct((newlines(b) + newlines(w)).cast("long").alias("all"), newlines(F.regexp_replace(w, r"^\}?\s*", "")).alias("own")))
    lines = bound(rules, lambda rs: F.zip_with(running_sums(F.transform(rs, lambda r: r["all"])), rs, lambda n, r: (n - r["own"] + 1).cast("int")))
    placed = cut.select("sheet", F.posexplode(F.zip_with("heads", lines, lambda h, n: F.struct(h.alias("heads"), n.alias("line")))).alias("rule", "r"))
    each = placed.select("sheet", "rule", F.col("r.line"), F.posexplode(F.split("r.heads", ",")).alias("part", "selector"))
    return each.select("sheet", (F.col("rule") * 1000 + F.col("part")).alias("place"), "line", F.trim(F.regexp_replace("selector", r"\s+", " ")).alias("selector")).where("selector <> ''")


def audit(sheet_table: DataFrame) -> DataFrame:
    """``(sheet, selectors, important, ids, deep, floats)``: counts of each sheet; floats: rules that float and size at once."""
    text = sheet_table.select("sheet", bare(F.col("css")).alias("css"))
    heads = F.filter(F.transform(F.flatten(F.transform(F.regexp_extract_all("css", F.lit(_HEAD)), lambda h: F.split(h, ","))), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    levels = lambda s: F.size(F.filter(F.split(s, r"\s+|>"), lambda x: x != ""))
    laid = lambda r: r.rlike(r"float\s*:\s*(left|right)") & r.rlike(r"[;{]\s*width\s*:")
    count = lambda c: c.cast("long")
    return text.select(
        "sheet",
        count(F.size(heads)).alias("selectors"),
        count(F.regexp_count("css", F.lit(r"!\s*important"))).alias("important"),
        count(F.size(F.filter(heads, lambda s: s.rlike(r"#[\w-]")))).alias("ids"),
        count(F.size(F.filter(heads, lambda s: levels(s) >= DEEP))).alias("deep"),
        count(F.size(F.filter(F.regexp_extract_all("css", F.lit(_RULE), F.lit(0)), laid))).alias("floats"),
    )


def repeated_declarations(sheet_table: DataFrame, least: int = REPEATED) -> DataFrame:
    """``(sheet, declaration, n)``: declarations that a sheet repeats ``least`` times or more."""
    found = sheet_table.select("sheet", F.explode(F.regexp_extract_all(bare(F.col("css")), F.lit(r"[\w-]+\s*:\s*[^;{}]+;"), F.lit(0))).alias("d"))
    parts = found.select("sheet", F.regexp_extract("d", r"^([\w-]+)", 1).alias("name"), F.trim(F.regexp_replace(F.regexp_extract("d", r":\s*([^;]*);$", 1), r"\s+", " ")).alias("value"))
    return parts.groupBy("sheet", F.concat("name", F.lit(": "), "value").alias("declaration")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def used_tokens(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(token)``: the inverted index's terms, every ``.class`` and ``#id`` that some page has, conditional classes of bindings with them."""
    values = lambda pattern: F.regexp_extract_all(html_col, F.lit(pattern))
    named = lambda xs, mark: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    split = F.flatten(F.transform(values(r"(?i)[\s\"']class\s*=\s*[\"']([^\"']*)[\"']"), lambda v: F.split(v, r"\s+")))
    plain = F.filter(split, lambda c: (c != "") & ~c.rlike("[{$]"))
    bound = F.flatten(F.transform(values(r"(?i)(?:ng-class|ko-css|:class)\s*=\s*\"\{([^\"]*)\}\""), lambda v: F.regexp_extract_all(v, F.lit(r"['\"]?([\w-]+)['\"]?\s*:"))))
    ids = values(r"(?i)[\s\"']id\s*=\s*[\"']([\w-]+)[\"']")
    return pages.select(F.explode(F.concat(named(F.concat(plain, bound), "."), named(ids, "#"))).alias("token")).distinct()


def unmatched(selector_table: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(sheet, place, line, selector)``: selectors with classes or ids of which no page has any.

    Each selector's tokens meet the index by equality; a selector with a hit is
    matched. Candidates, not verdicts: a class put together by a script looks so too.
    """
    wanted = F.array_distinct(F.regexp_extract_all("selector", F.lit(r"[.#][A-Za-z_][\w-]*"), F.lit(0)))
    asked = selector_table.withColumn("wanted", wanted).where(F.size("wanted") > 0)
    key = ["sheet", "place"]
    hit = asked.select(*key, F.explode("wanted").alias("token")).join(tokens, "token", "left_semi").select(key).distinct()
    return asked.join(hit, key, "left_anti").drop("wanted")


def dead_classes(selector_table: DataFrame, tokens: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(name, sheets)``: classes that sheets declare, no page has, and no script names; in how many sheets.

    A name that a script has after a quote, a blank or a full stop may be put together there, and is left out.
    """
    declared = selector_table.select("sheet", F.explode(F.regexp_extract_all("selector", F.lit(r"\.([A-Za-z_][\w-]*)"))).alias("name"))
    counted = declared.groupBy("name").agg(F.count_distinct("sheet").alias("sheets"))
    used = tokens.where(F.col("token").startswith(".")).select(F.substring("token", 2, 1 << 20).alias("name"))
    named = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?:^|[\"'`\s.])([A-Za-z_][\w-]*)(?=[\"'`\s.]|$)"))).alias("name")).distinct()
    return counted.join(used, "name", "left_anti").join(named, "name", "left_anti")
