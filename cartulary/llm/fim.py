"""Fill-in-the-middle transformation by rotating blocks of a byte array in place.

A text is cut at two token borders into prefix, middle and suffix. The cuts are
found by one scan over its UTF-8 bytes; sentinels are inserted into a byte array
that holds ``<P>prefix<M>middle<S>suffix``, and neighbouring segments change
places by three reversals each: one exchange gives ``psm``, a second one ``spm``.
Each exchange is its own inverse with the lengths changed over, so the restored
text comes from the output and its form alone: find the sentinels, rotate back,
take them out. Nothing is shuffled; a task holds an Arrow batch of texts and the
array of one text; a lost task is run again.

The draws come from the id: ``h1`` to ``h4`` are the first four groups of eight
digits of the hex SHA-256 of ``<seed>:<id>``. Tokens are runs of ASCII letters
and any other single character.

Defined cases: a null or empty text is plain and empty; a text that holds a
sentinel is plain, and so is the share of rows that ``plain_share`` leaves; an
empty prefix, middle or suffix is kept as such; a null id draws like the text
"null"; rows with equal ids and texts get equal outputs; texts of any length
count whole; an empty table gives an empty result; other columns pass through,
but for those with the names of new columns and ``__fim``, which are replaced or
dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Of 100 draws, so many that are transformed, and of those so many with the suffix first.
FORMED, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def token_starts(raw: bytes | bytearray) -> np.ndarray:
    """Byte offsets at which the tokens of a UTF-8 text begin."""
    data = np.frombuffer(raw, dtype=np.uint8)
    letter = _LETTER[data]
    starts = ~letter & ((data & 0xC0) != 0x80)
    starts |= letter & ~np.concatenate(([False], letter[:-1]))
    return np.flatnonzero(starts)


def reverse(view: np.ndarray, begin: int, end: int) -> None:
    """Reverse ``view[begin:end]`` in place, with a buffer of half its length."""
    half = (end - begin) // 2
    if half:
        head = view[begin : begin + half].copy()
        view[begin : begin + half] = view[end - half : end][::-1]
        view[end - half : end] = head[::-1]


def exchange(data: bytearray, begin: int, cut: int, end: int) -> None:
    """Let ``data[begin:cut]`` and ``data[cut:end]`` change places: each is reversed, then both together."""
    view = np.frombuffer(data, dtype=np.uint8)
    reverse(view, begin, cut)
    reverse(view, cut, end)
    reverse(view, begin, end)


def transform(text: str | None, h1: int, h2: int, h3: int, h4: int, formed: int = FORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    text = text if isinstance(text, str) else ""
    raw = text.encode()
    starts = token_starts(raw)
    n = len(starts)
    if not n or h3 % 100 >= formed or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    border = [*starts.tolist(), len(raw)]
    a, b = border[first], border[last]
    data = bytearray(raw)
    data[b:b] = SUFFIX
    data[a:a] = MIDDLE
    data[0:0] = PREFIX
    mid = len(PREFIX) + a
    suf = mid + len(MIDDLE) + b - a
    exchange(data, mid, suf, len(data))
    form = "psm"
    if h4 % 100 < suffix_first:
        exchange(data, 0, mid, mid + len(data) - suf)
        form = "spm"
    chars = lambda part: len(part.decode())
    return n, form, chars(raw[:a]), chars(raw[a:b]), data.decode()


def restore(output: str | None, form: str | None) -> str | None:
    """The text, from an output and its form alone."""
    if not isinstance(output, str) or form == "plain":
        return output
    data = bytearray(output.encode())
    mid = data.find(MIDDLE)
    if form == "spm":
        exchange(data, 0, data.find(PREFIX), mid)
    exchange(data, data.find(SUFFIX), mid, len(data))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = data.find(sentinel)
        del data[at : at + len(sentinel)]
    return data.decode()


RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, formed: int = FORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""

    @F.pandas_udf(RESULT)
    def rotate(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = [transform(t, *h, formed, suffix_first) for t, *h in zip(texts, h1.tolist(), h2.tolist(), h3.tolist(), h4.tolist())]
        found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    return docs.withColumn("__fim", rotate(F.col(text_col), *draws)).withColumns({name: F.col("__fim")[name] for name in ("n", "form", "prefix_chars", "middle_chars", "output")}).drop("__fim")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The restored text of each output."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)
