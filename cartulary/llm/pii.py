"""Personal data, in DataFrame functions alone: patterns propose, checks confirm, context scores.

For every kind a regular expression proposes spans; its check (value ranges,
digit counts, Luhn, mod 97) drops what cannot be one; words close by raise or
lower the score. Spans of the four base kinds stay whatever their score, those
of the other kinds need ``LEAST_SCORE``. A text is cut at the matches of a kind;
running sums over the lengths of the pieces give the places. Patterns cannot
match a character twice, so time is linear in the text, however long a word or a
number is. Nothing is shuffled, and all of it runs in the JVM.

Defined cases: a null or empty text has no spans; context is the ``WINDOW`` code
points on each side, cut at the neighbouring matches of the same kind; spans of
different kinds may overlap, and all are given; equal starts go by the order of
``KINDS``; repeated rows are scanned each for itself; texts of any length count
whole; an empty table gives an empty result; other columns pass through, but for
one with the name of the spans column, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, cut, running_maxima, running_sums, text_blocks

#: Code points of context on each side of a match.
WINDOW = 40
#: Hundredths that a span of a kind that is not a base kind needs, and that words close by give or take.
LEAST_SCORE, HINT = 50, 25


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_card(match: Column) -> Column:
    """14 to 19 digits that pass Luhn."""
    digits = digits_of(match)
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def is_phone(match: Column) -> Column:
    return F.length(digits_of(match)).between(10, 15)


def is_address(match: Column) -> Column:
    """Four parts of at most 255, leading zeros or not."""
    part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def mod97(code: Column) -> Column:
    """The remainder of an account number by 97: first four signs last, letters as 10 to 35."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda i: F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), value), F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97)


def is_account(match: Column) -> Column:
    code = F.regexp_replace(match, " ", "")
    return F.length(code).between(15, 34) & (mod97(code) == 1)


def is_social(match: Column) -> Column:
    """Numbers of areas, groups and series that are given out."""
    return ~match.rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``needs`` is a cheap pattern without which no match of the kind passes its
    check; ``regex`` finds what ``plain`` finds, without ever going back.
    """

    name: str
    plain: str
    regex: str
    needs: str
    score: int
    check: Callable[[Column], Column] | None = None
    hints: tuple[str, ...] = ()
    doubts: tuple[str, ...] = field(default=("example", "sample", "dummy", "placeholder"))
    base: bool = True


_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"

#: The base kinds first, in the order that spans with equal starts take.
KINDS = (
    Kind("email", rf"{_LOCAL}+@{_LABEL}+(?:\.{_LABEL}+)+", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", 80, hints=("mail", "contact", "write to", "reach")),
    Kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 60, is_address, ("ip", "address", "host", "server", "login"), ("version", "release", "section", "chapter")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])+", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", 65, is_card, ("card", "visa", "mastercard", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 65, is_phone, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 60, is_account, ("iban", "account", "bank", "transfer"), base=False),
    Kind("social", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]{2}-[0-9]{4}", 30, is_social, ("social security", "ssn", "tax id"), base=False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:int>>"


def _words(words: tuple[str, ...]) -> str:
    return f"(?i){'|'.join(words)}"


def score_of(kind: Kind, context: Column) -> Column:
    """Hundredths, 0 to 100: the kind's own score, more for words that speak for it and less for those against it."""
    score = F.lit(kind.score)
    if kind.hints:
        score = score + F.when(context.rlike(_words(kind.hints)), HINT).otherwise(0)
    if kind.doubts:
        score = score - F.when(context.rlike(_words(kind.doubts)), HINT).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def spans_of_kind(text: Column, kind: Kind, order: int) -> Column:
    """The spans of one kind, checked and scored: ``(start, order, kind, end, score)``."""

    def placed(cut: Column) -> Column:
        hits, pieces = cut["hits"], cut["pieces"]
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: (F.length(p) + F.length(h)).cast("long"))

        def span(end: Column, i: Column) -> Column:
            context = F.concat_ws(" ", F.right(pieces[i], F.lit(WINDOW)), F.left(pieces[i + 1], F.lit(WINDOW)))
            return F.struct((end - F.length(hits[i])).cast("int").alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), end.cast("int").alias("end"), score_of(kind, context).alias("score"), hits[i].alias("hit"))

        return F.transform(running_sums(lengths), span)

    spans = bound(F.struct(F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)).alias("hits"), F.split(text, kind.regex, -1).alias("pieces")), placed)
    if kind.check:
        spans = F.filter(spans, lambda s: kind.check(s["hit"]))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score")))
    return F.when(text.rlike(kind.needs), plain).otherwise(F.array().cast("array<struct<start:int,order:int,kind:string,end:int,score:int>>"))


def personal_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All personal data of each text as ``array<struct<kind, start, end, score>>`` (code points, end exclusive), by start, then kind."""
    whole = F.coalesce(text, F.lit(""))
    found = F.array_sort(F.concat(*[spans_of_kind(whole, k, i) for i, k in enumerate(kinds)]))
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


def find_personal(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` in ``spans_col``."""
    return docs.withColumn(spans_col, personal_spans(F.col(text_col), kinds))


def redacted(text: Column, spans: Column, least_score: int = 0) -> Column:
    """The text with a mark in place of each span of ``least_score`` or more; of spans that overlap, the first one's mark stands for all."""

    def marked(x: Column) -> Column:
        found, upto, blocks = x["found"], x["upto"], x["blocks"]
        before = lambda i: F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0).cast("long"))
        parts = F.transform(found, lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), F.concat(cut(blocks, before(i), s["start"].cast("long")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.element_at(upto, -1), F.length(text).cast("long")))

    kept = F.filter(spans, lambda s: s["score"] >= least_score)
    placed = bound(kept, lambda k: F.struct(k.alias("found"), running_maxima(F.transform(k, lambda s: s["end"].cast("long"))).alias("upto"), text_blocks(text).alias("blocks")))
    return F.when(F.size(kept) > 0, bound(placed, marked)).otherwise(text)


def span_list(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined, of ``kinds`` alone where given."""
    of = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
