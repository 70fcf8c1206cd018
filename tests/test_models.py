"""Colours moved by lightness, and models fitted in rounds, against scans, finite differences and plain arrays."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.functions import colours
from cartulary.operators import fitting

SF = "/root/testdata/sf0.001"


def rgb(c):
    return [int(c[i : i + 2], 16) / 255 for i in (0, 2, 4)]


def luminance(c):
    return sum(w * (x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4) for w, x in zip((0.2126, 0.7152, 0.0722), rgb(c)))


def ratio(a, b):
    x, y = sorted((luminance(a), luminance(b)))
    return (y + 0.05) / (x + 0.05)


def by_scan(colour, ground, target):
    """Every step in turn, with the library's conversions."""
    h, l, s = colorsys.rgb_to_hls(*rgb(colour))
    if ratio(colour, ground) >= target:
        return colour, 0, False
    dark = colorsys.rgb_to_hls(*rgb(ground))[1] > 0.5
    for i in range(1, 101):
        to = l - i / 100 if dark else l + i / 100
        if to < 0 or to > 1:
            break
        hex_ = "".join(f"{math.floor(v * 255 + 0.5):02x}" for v in colorsys.hls_to_rgb(h, to, s))
        if ratio(hex_, ground) >= target:
            return hex_, math.floor((to - l) * 100 + 0.5), False
    return ("000000", -100, True) if dark else ("ffffff", 100, True)


@pytest.mark.parametrize("target", [3.0, 4.5, 7.0, 20.0])
def test_the_least_step_is_that_of_a_scan(spark, target):
    rng = np.random.default_rng(7)
    pairs = [tuple("".join(f"{v:02x}" for v in rng.integers(0, 256, 3)) for _ in range(2)) for _ in range(150)]
    pairs += [("777777", "888888"), ("000000", "000000"), ("ffffff", "ffffff"), ("ff0000", "ffffff"), ("808080", "7f7f7f"), (None, "ffffff")]
    df = spark.createDataFrame(pairs, "c string, g string")
    for r in df.select("c", "g", colours.fit_contrast(F.col("c"), F.col("g"), target).alias("f")).collect():
        if r.c is None:
            assert r.f is None
            continue
        hex_, moved, spent = by_scan(r.c, r.g, target)
        # two ways to convert may round a channel differently, by one
        assert (r.f.moved, r.f.exhausted) == (moved, spent) and all(abs(a - b) < 1.5 / 255 for a, b in zip(rgb(r.f.hex), rgb(hex_)))
        if not spent:
            assert ratio(r.f.hex, r.g) >= target


def test_hue_is_kept(spark):
    df = spark.createDataFrame([("c04030", "ffffff"), ("3050c0", "101010")], "c string, g string")
    for r in df.select("c", colours.fit_contrast(F.col("c"), F.col("g"), 7.0).alias("f")).collect():
        assert r.f.moved and abs(colorsys.rgb_to_hls(*rgb(r.c))[0] - colorsys.rgb_to_hls(*rgb(r.f.hex))[0]) < 0.01


# models


def test_the_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(40, 5)), rng.integers(0, 3, 40), rng.normal(size=(3, 6))
    _, gradient = fitting.loss_and_gradient(w, x, y)
    for at in np.ndindex(w.shape):
        step = np.zeros_like(w)
        step[at] = 1e-6
        slope = (fitting.loss_and_gradient(w + step, x, y)[0] - fitting.loss_and_gradient(w - step, x, y)[0]) / 2e-6
        assert abs(slope - gradient[at]) < 1e-4


def test_a_fit_in_rounds_is_that_of_plain_arrays(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) + y[:, None] * [1, -1, 0.5, 0]
    rows = [(int(a) * 10, b.tolist()) for a, b in zip(y, x)]
    odd = [(None, [1.0] * 4), (0, None), (0, [1.0, None, 1.0, 1.0]), (0, [float("nan")] * 4), (10, [1.0] * 5), (10, [])]
    model = fitting.fit(spark.createDataFrame(rows + odd, "label int, v array<double>").repartition(5), "label", "v", rounds=15)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w, pace, losses = np.zeros((3, 5)), np.zeros((3, 5)), []
    for _ in range(15):
        loss, gradient = fitting.loss_and_gradient(w + 0.9 * pace, z, y)
        losses.append(loss / 300)
        gradient /= 300
        gradient[:, 1:] += 1e-3 * (w + 0.9 * pace)[:, 1:]
        pace = 0.9 * pace - 0.5 * gradient
        w = w + pace
    assert model.labels == [0, 10, 20] and np.allclose(model.weights, w) and np.allclose(model.losses, losses)
    assert model.losses[-1] < 0.7 * model.losses[0] and abs(model.losses[0] - np.log(3)) < 1e-9
    scored = spark.createDataFrame([([1.0, 2.0, 3.0], 1), ([1000.0, 0.0], 0)], "s array<double>, y int").select(fitting.cross_entropy(F.col("s"), F.col("y")).alias("c")).collect()
    assert abs(scored[0].c + np.log(np.exp(2) / np.exp([1, 2, 3]).sum())) < 1e-12 and scored[1].c == 0


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("label is not null")
    fold = F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 == 0
    model = fitting.fit(rows.where(~fold), "label", "embedding", rounds=25)
    tried = rows.where(fold).select(F.col("label").cast("string").alias("label"), fitting.predicted(model, F.col("embedding")).alias("p")).collect()
    hits = sum(r.label == r.p for r in tried)
    chance = max(np.bincount([int(r.label) for r in tried])) / len(tried)
    print("held out:", hits, "of", len(tried), "most common label", chance)
    assert model.losses[-1] < model.losses[0]
    with pytest.raises(ValueError):
        fitting.fit(rows.limit(0), "label", "embedding")
