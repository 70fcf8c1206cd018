"""Colours as columns: hue, saturation and lightness, and the least change of lightness that clears a contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import bound
from .numbers import luminance

#: Steps into which lightness is divided, and the contrast that small text needs: fixed values.
STEPS, TARGET = 100, 4.5


def hsl(colour: Column) -> Column:
    """``struct<h, s, l>`` (each 0 to 1) of ``rrggbb``."""
    r, g, b = (F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255 for at in (1, 3, 5))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    l, d = (top + low) / 2, top - low  # noqa: E741
    s = F.when(l > 0.5, d / (2 - top - low)).otherwise(d / (top + low))
    h = F.when(top == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    grey = d == 0
    return F.struct(F.when(grey, 0.0).otherwise(h).alias("h"), F.when(grey, 0.0).otherwise(s).alias("s"), l.alias("l"))


def hex_of(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    """``rrggbb`` of a colour; channels are rounded half up."""

    def channels(x: Column) -> Column:
        p, q, light = x["p"], x["q"], x["l"]

        def channel(t: Column) -> Column:
            v = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (F.lit(2 / 3) - t) * 6).otherwise(p)
            v = F.when(s == 0, light).otherwise(v)
            return F.lpad(F.lower(F.hex(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * 255 + 0.5))), 2, "0")

        turned = F.array(h + 1 / 3, h + 0.0, h - 1 / 3)
        return F.array_join(F.transform(F.transform(turned, lambda t: F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)), channel), "")

    def ends(light: Column) -> Column:
        q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
        return bound(q, lambda q: F.struct(q.alias("q"), (2 * light - q).alias("p"), light.alias("l")))

    return bound(bound(l, ends), channels)


def fit_contrast(colour: Column, ground: Column, target: float = TARGET) -> Column:
    """``struct<hex, ratio, moved, exhausted>``: ``colour`` moved along its lightness alone, away from the ground's, by
    the fewest hundredths that give ``target`` against ``ground``; black or white where none do.

    Contrast rises with every step (each channel follows lightness), so the
    least step is found by halving, not by trying all. What an expression uses
    more than once is bound, so that it is not written out again and again.
    """

    def search(x: Column) -> Column:
        start, dark, other = x["start"], x["dark"], x["other"]
        light = lambda i: F.when(dark, start["l"] - i / STEPS).otherwise(start["l"] + i / STEPS)
        ratio = lambda hex_: bound(luminance(hex_), lambda y: (F.greatest(y, other) + 0.05) / (F.least(y, other) + 0.05))
        at = lambda l: hex_of(start["h"], start["s"], l)  # noqa: E731, E741
        reached = lambda i: bound(at(light(i)), ratio)
        room = F.floor(F.when(dark, start["l"]).otherwise(1 - start["l"]) * STEPS + 1e-9).cast("int")
        most = bound(room, lambda r: F.when((light(r) < 0) | (light(r) > 1), r - 1).otherwise(r))

        def halve(span: Column, _: Column) -> Column:
            low, high = span["low"], span["high"]
            mid = F.floor((low + high) / 2).cast("int")
            next_ = lambda m: F.when(reached(m) >= target, F.struct(low.alias("low"), m.alias("high"))).otherwise(F.struct(m.alias("low"), high.alias("high")))
            return F.when(high - low > 1, bound(mid, next_)).otherwise(span)

        def result(i: Column) -> Column:
            hex_ = lambda c: F.struct(c.alias("hex"), (F.floor(ratio(c) * 100 + 0.5) / 100).alias("ratio"), F.floor((light(i) - start["l"]) * 100 + 0.5).cast("int").alias("moved"), F.lit(False).alias("exhausted"))
            return bound(at(light(i)), hex_)

        def found(most: Column) -> Column:
            first = F.struct(F.lit(0).alias("low"), most.alias("high"))
            step = F.aggregate(F.sequence(F.lit(1), F.lit(7)), first, halve)["high"]
            end = F.when(dark, 0.0).otherwise(1.0)
            spent = F.struct(at(end).alias("hex"), ((F.greatest(end, other) + 0.05) / (F.least(end, other) + 0.05)).alias("ratio"), F.when(dark, -100).otherwise(100).alias("moved"), F.lit(True).alias("exhausted"))
            return F.when((most > 0) & (reached(most) >= target), bound(step, result)).otherwise(spent)

        kept = lambda now: F.struct(at(start["l"]).alias("hex"), now.alias("ratio"), F.lit(0).alias("moved"), F.lit(False).alias("exhausted"))
        return bound(ratio(x["colour"]), lambda now: F.when(now >= target, kept(now)).otherwise(bound(most, found)))

    given = F.struct(colour.alias("colour"), hsl(colour).alias("start"), (hsl(ground)["l"] > 0.5).alias("dark"), luminance(ground).alias("other"))
    return F.when(colour.isNotNull() & ground.isNotNull(), bound(given, search))
