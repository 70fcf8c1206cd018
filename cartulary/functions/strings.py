"""Text functions as column expressions: words, case styles, slugs, redaction, pseudo-localisation, entities, match ranges."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches

#: The entities that text is commonly escaped with. Fixed values; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    """Common entities as characters, each once."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def words(name: Column) -> Column:
    """The parts of an identifier or phrase, in lower case: at other characters, and where a capital follows a small letter."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(apart), " "), lambda w: w != "")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(words(name), _capital), "")


def camel(name: Column) -> Column:
    return F.array_join(F.transform(words(name), lambda w, i: F.when(i == 0, w).otherwise(_capital(w))), "")


def snake(name: Column) -> Column:
    return F.array_join(words(name), "_")


def kebab(name: Column) -> Column:
    return F.array_join(words(name), "-")


def constant(name: Column) -> Column:
    return F.upper(snake(name))


def slug(text: Column, most: int = 6) -> Column:
    """The first ``most`` words, joined by hyphens; a slug is short by definition."""
    return F.array_join(F.slice(words(text), 1, most), "-")


def redacted(value: Column, shown: int = 4) -> Column:
    """The first characters, the others as stars."""
    return F.concat(F.substring(value, 1, shown), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(value) - shown)))


def pseudo(text: Column) -> Column:
    """Text with accents on its vowels and in brackets, which shows what is not translated."""
    return F.concat(F.lit("["), F.translate(text, "aeiouAEIOU", "áéíóúÁÉÍÓÚ"), F.lit("]"))


def match_ranges(text: Column, asked: Column) -> Column:
    """``array<struct<start, end>>``: where ``asked`` occurs in ``text`` in either case, without overlap; none for an empty one or a null."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def ranges(texts: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for t, w in zip(texts, words):
            found, t, w = [], (t or "").lower(), (w or "").lower()
            at = t.find(w) if w else -1
            while at >= 0:
                found.append({"start": at, "end": at + len(w)})
                at = t.find(w, at + len(w))
            out.append(found)
        return pd.Series(out)

    small_batches(SparkSession.active())
    return ranges(text, asked)
