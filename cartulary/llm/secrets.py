"""Secret scans with a trigram index that is local to each shard of documents.

A shard is a few megabytes of consecutive texts inside a task. For each shard
an inverted index from case-folded byte trigrams to documents is built, limited
to the trigrams that some rule mentions. Every rule's regex is turned into a
Boolean trigram query; postings are intersected and joined as it says, and only
the candidate documents are searched with the regex itself. A rule without a
mandatory trigram scans every document. Nothing is shuffled, memory follows the
shard size, and a lost task is simply run again.

Defined cases: a null or empty text has no spans; spans with equal starts go by
the order of the rules; a text of any length is scanned whole, in a shard of its
own if it is longer than one; repeated rows are scanned each for itself; an empty table gives an empty result; other columns pass
through untouched, but for one with the name of the spans column.
"""

from __future__ import annotations

import re
import re._parser as rx
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that share one local index.
SHARD_BYTES = 4 << 20
#: Most alternative strings that are kept while a literal run is expanded.
MAX_STRINGS = 64

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of ``group`` in a match that counts."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The three base kinds first, in the order that spans with equal starts take.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")


def mandatory_strings(regex: str) -> list[set[str]]:
    """Sets of lower-case strings; every match holds at least one string of each set.

    Literal runs are expanded through small classes, alternatives and optional
    parts while they stay finite; anything else ends the run.
    """
    found: list[set[str]] = []

    def finite(items) -> set[str] | None:
        """All strings of a sub-pattern, or None if there are too many to list."""
        out = {""}
        for op, arg in items:
            part = one(op, arg)
            if part is None or len(out) * len(part) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def one(op, arg) -> set[str] | None:
        if op is rx.LITERAL:
            return {chr(arg).lower()}
        if op is rx.IN:
            if any(kind is not rx.LITERAL for kind, _ in arg):
                return None
            return {chr(c).lower() for _, c in arg}
        if op is rx.SUBPATTERN:
            return finite(arg[-1])
        if op is rx.BRANCH:
            parts = [finite(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (rx.MAX_REPEAT, rx.MIN_REPEAT):
            least, most, sub = arg
            if most is rx.MAXREPEAT or most > 4:
                return None
            part = finite(sub)
            if part is None:
                return None
            out, run = set(), {""}
            for n in range(most + 1):
                if n >= least:
                    out |= run
                run = {a + b for a in run for b in part}
                if len(out) + len(run) > MAX_STRINGS:
                    return None
            return out
        if op is rx.AT:
            return {""}
        return None

    def walk(items) -> None:
        run = {""}

        def flush() -> None:
            nonlocal run
            if all(len(s.encode()) >= 3 for s in run):
                found.append(run)
            run = {""}

        for op, arg in items:
            part = one(op, arg)
            if part is not None and len(run) * len(part) <= MAX_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            flush()
            if part is not None and len(part) <= MAX_STRINGS:
                run = set(part)
            elif op is rx.SUBPATTERN:
                walk(arg[-1])
            elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush()

    walk(rx.parse(regex))
    return found


def trigrams(text: str) -> list[int]:
    raw = text.encode().lower()
    return [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]


def trigram_query(regex: str) -> list[list[list[int]]] | None:
    """AND over ORs over ANDs of trigrams; None if the regex has no mandatory trigram."""
    sets = mandatory_strings(regex)
    return [[sorted(set(trigrams(s))) for s in sorted(alternatives)] for alternatives in sets] or None


class Scanner:
    """Rules with their trigram queries and compiled regexes, built once in each worker."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = [(r, trigram_query(r.regex), re.compile(r.regex, re.ASCII)) for r in rules]
        self.vocabulary = np.array(sorted({t for _, q, _ in self.rules if q for either in q for both in either for t in both}), dtype=np.uint32)
        self.known = np.zeros(1 << 24, dtype=bool)
        self.known[self.vocabulary] = True

    def postings(self, raw: list[bytes]) -> dict[int, np.ndarray]:
        """The shard's inverted index: trigram to sorted document numbers."""
        ends = np.cumsum([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw).lower(), dtype=np.uint8)
        if len(flat) < 3 or not len(self.vocabulary):
            return {}
        codes = flat[:-2].astype(np.uint32)
        codes <<= 8
        codes |= flat[1:-1]
        codes <<= 8
        codes |= flat[2:]
        at = np.flatnonzero(self.known[codes])
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[doc]
        pairs = np.unique(codes[at[inside]].astype(np.uint64) << np.uint64(32) | doc[inside].astype(np.uint64))
        term, doc = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.diff(term, prepend=np.uint64(1 << 40)))
        return {int(term[i]): doc[i:j] for i, j in zip(starts, [*starts[1:], len(term)])}

    @staticmethod
    def candidates(query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
        """Documents that satisfy the Boolean query, by intersecting and joining postings."""
        if query is None:
            return np.arange(n)
        none = np.empty(0, dtype=np.int64)
        result = None
        for either in query:
            joined = none
            for both in either:
                hit = None
                for posting in sorted((index.get(t, none) for t in both), key=len):
                    hit = posting if hit is None else np.intersect1d(hit, posting, assume_unique=True)
                    if not len(hit):
                        break
                joined = np.union1d(joined, hit)
            result = joined if result is None else np.intersect1d(result, joined, assume_unique=True)
        return result

    def shard(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        spans: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        index = self.postings([t.encode("utf-8", "replace") for t in texts])
        for order, (rule, query, regex) in enumerate(self.rules):
            for i in self.candidates(query, index, len(texts)):
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((m.start(), order, rule.kind, m.end()))
        return [[(kind, start, end) for start, _, kind, end in sorted(x)] for x in spans]

    def scan(self, texts: Iterable[str | None]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = []
        block: list[str] = []
        size = 0
        for text in texts:
            text = text if isinstance(text, str) else ""
            if block and size + len(text) > SHARD_BYTES:
                out += self.shard(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        return out + self.shard(block) if block else out


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return _SCANNERS.get(rules) or _SCANNERS.setdefault(rules, Scanner(rules))


def secret_spans(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """All secrets of each text as ``array<struct<kind, start, end>>`` (code points, end exclusive), by start, then rule order."""

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in found] for found in scanner(rules).scan(texts)], dtype=object)

    return spans(text)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of touching or overlapping spans replaced by a mark that names its first kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda x: x[1]):
        if merged and start <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()} REMOVED]"]
        at = end
    return "".join([*out, text[at:]])


def redacted_text(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text without its secrets; null stays null, and a text without secrets stays as it is."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, s) if s else t for t, s in zip(texts, scanner(rules).scan(texts))], dtype=object)

    return clean(text)


def scan_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets of ``text_col`` in ``spans_col``."""
    return docs.withColumn(spans_col, secret_spans(F.col(text_col), rules))


def span_list(spans: Column | str, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined, of ``kinds`` alone where given."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
