"""Queries over fitted models and colours, with SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colours
from ..operators import fitting
from ..sources.tables import table
from .catalog import query

ROUNDS = 25


def _held_out(vec_id: str):
    """A fifth of the rows by the CRC of their id: the fold on which the model is tried."""
    return F.crc32(F.col(vec_id).cast("string").cast("binary")) % 5 == 0


@query()
def ml_softmax_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of the held-out fold get their own label, by label, from a model fitted in rounds on the others."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null")
    model = fitting.fit(rows.where(~_held_out("vec_id")), "label", "embedding", ROUNDS)
    tried = rows.where(_held_out("vec_id")).select("label", fitting.predicted(model, F.col("embedding")).alias("predicted"))
    return tried.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label").cast("string") == F.col("predicted")).alias("correct"))


_LINEAR = "(CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)".format
_BYTE = "('0x' || substr({0}, {1}, 2))::INT / 255.0::DOUBLE".format
_LUMINANCE = lambda c: f"(0.2126 * {_LINEAR(_BYTE(c, 1))} + 0.7152 * {_LINEAR(_BYTE(c, 3))} + 0.0722 * {_LINEAR(_BYTE(c, 5))})"
_RATIO = lambda a, b: f"((greatest({_LUMINANCE(a)}, {_LUMINANCE(b)}) + 0.05) / (least({_LUMINANCE(a)}, {_LUMINANCE(b)}) + 0.05))"


def _channel(shift: str) -> str:
    t = f"(CASE WHEN h + {shift} < 0 THEN h + {shift} + 1 WHEN h + {shift} > 1 THEN h + {shift} - 1 ELSE h + {shift} END)"
    v = f"CASE WHEN s = 0 THEN l WHEN {t} < 1::DOUBLE / 6 THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5 THEN q WHEN {t} < 2::DOUBLE / 3 THEN p + (q - p) * (2::DOUBLE / 3 - {t}) * 6 ELSE p END"
    return f"lpad(printf('%x', floor(least(1.0, greatest(0.0, {v})) * 255 + 0.5)::INT), 2, '0')"


@query(f"""WITH c AS (SELECT c_custkey, substr(md5(c_name), 1, 6) AS colour, substr(md5(c_name), 7, 6) AS ground FROM customer),
  r AS (SELECT *, {_BYTE("colour", 1)} AS r, {_BYTE("colour", 3)} AS g, {_BYTE("colour", 5)} AS b, (greatest({_BYTE("ground", 1)}, {_BYTE("ground", 3)}, {_BYTE("ground", 5)}) + least({_BYTE("ground", 1)}, {_BYTE("ground", 3)}, {_BYTE("ground", 5)})) / 2 > 0.5 AS dark FROM c),
  m AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low, greatest(r, g, b) - least(r, g, b) AS d FROM r),
  k AS (SELECT *, (top + low) / 2 AS start, CASE WHEN d = 0 THEN 0 WHEN (top + low) / 2 > 0.5 THEN d / (2 - top - low) ELSE d / (top + low) END AS s,
    CASE WHEN d = 0 THEN 0 ELSE (CASE WHEN top = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END) / 6 END AS h FROM m),
  steps AS (SELECT c_custkey, colour, ground, dark, start, h, s, i, CASE WHEN dark THEN start - i / 100::DOUBLE ELSE start + i / 100::DOUBLE END AS l FROM k, (SELECT unnest(range(0, 101)) AS i)),
  lit AS (SELECT *, CASE WHEN l < 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS q, 2 * l - CASE WHEN l < 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS p FROM steps WHERE l >= 0 AND l <= 1),
  tried AS (SELECT *, {_channel("1::DOUBLE / 3")} || {_channel("0")} || {_channel("-1::DOUBLE / 3")} AS hex FROM lit),
  rated AS (SELECT *, {_RATIO("hex", "ground")} AS ratio, {_RATIO("colour", "ground")} AS current FROM tried),
  best AS (SELECT c_custkey, any_value(current) AS current, any_value(colour) AS colour, any_value(dark) AS dark, any_value(ground) AS ground, any_value(start) AS start, min(i) FILTER (i > 0 AND ratio >= 4.5) AS i FROM rated GROUP BY 1)
  SELECT b.c_custkey, CASE WHEN current >= 4.5 THEN b.colour WHEN b.i IS NOT NULL THEN t.hex WHEN b.dark THEN '000000' ELSE 'ffffff' END AS hex,
    round(CASE WHEN current >= 4.5 THEN current WHEN b.i IS NOT NULL THEN floor(t.ratio * 100 + 0.5) / 100 ELSE {_RATIO("CASE WHEN b.dark THEN '000000' ELSE 'ffffff' END", "b.ground")} END, 6) AS ratio,
    CASE WHEN current >= 4.5 THEN 0 WHEN b.i IS NOT NULL THEN floor((t.l - b.start) * 100 + 0.5)::INT WHEN b.dark THEN -100 ELSE 100 END AS moved, current < 4.5 AND b.i IS NULL AS exhausted
  FROM best b LEFT JOIN (SELECT c_custkey, i, hex, l, ratio FROM rated) t ON t.c_custkey = b.c_custkey AND t.i = b.i""")
def dsp_uplift_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of colours made readable by the least change of lightness."""
    digest = F.md5("c_name")
    pairs = table(spark, sf_dir, "customer").select("c_custkey", F.substring(digest, 1, 6).alias("colour"), F.substring(digest, 7, 6).alias("ground"))
    fitted = pairs.select("c_custkey", colours.fit_contrast(F.col("colour"), F.col("ground")).alias("f")).select("c_custkey", "f.*")
    return fitted.withColumn("ratio", F.round("ratio", 6))
