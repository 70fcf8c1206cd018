"""Text operators: retrieval, ranking, entropy, readability, policy scans, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

#: First match wins on a line, by rule order; values are never reported.
POLICY_RULES = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws-key", r"AKIA[A-Z0-9]{12,}"),
    ("assignment", r"(password|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{8,}"),
    ("card-number", r"(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)"),
    ("e-mail", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}"),
    ("phone", r"[+][0-9]{1,3}[ -][0-9]{2,4}[ -][0-9]{3}"),
)


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs of three characters or more."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


def paragraphs(docs: DataFrame, id_col: str, text_col: str, least: int = 20) -> DataFrame:
    """``(id, pos, chunk)``: trimmed parts between blank lines, of ``least`` characters or more."""
    chunks = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), r"\n[ \t]*\n")).alias("pos", "chunk"))
    return chunks.withColumn("chunk", F.regexp_replace("chunk", r"^[ \t\r\n]+|[ \t\r\n]+$", "")).where(F.length("chunk") >= least)


def retrieve(chunks: DataFrame, query: str, k: int = 6) -> DataFrame:
    """The ``k`` chunks with the largest sum of ln(1 + N / (1 + df)) (1 + ln tf) over the query's terms.

    Only the query's terms leave the scan; ties by id and position.
    """
    asked = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(t) >= 3})
    n = chunks.agg(F.count("*").alias("n"))
    found = chunks.select("id", "pos", F.explode(F.filter(tokens(F.col("chunk")), lambda t: t.isin(asked))).alias("term"))
    tf = found.groupBy("id", "pos", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # one row, and as many rows as the query has terms
    idf = df.crossJoin(F.broadcast(n)).select("term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))
    scores = tf.join(F.broadcast(idf), "term").groupBy("id", "pos").agg(F.round(F.sum(F.col("idf") * (1 + F.log("tf"))), 6).alias("score"))
    return scores.where("score > 0").orderBy(F.desc("score"), "id", "pos").limit(k)


def substring_rank(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """``(id, score)``: non-overlapping occurrences of the terms as substrings, where there are any."""
    low = F.lower(F.col(text_col))
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0))
    return docs.select(F.col(id_col).alias("id"), F.round(hits, 0).cast("long").alias("score")).where("score > 0")


def entropy(token: Column) -> Column:
    """Shannon entropy of a text's characters in bits, to two places, halves up."""
    chars = F.array_distinct(F.filter(F.split(token, ""), lambda c: c != ""))
    n = F.length(token)
    share = lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n.cast("double")
    bits = F.aggregate(F.transform(chars, share), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return numbers.half_up(bits, 2)


def high_entropy_tokens(docs: DataFrame, id_col: str, text_col: str, length: int = 24, bits: float = 4.2) -> DataFrame:
    """``(id, token, bits)``: distinct long tokens whose rounded entropy reaches ``bits``."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z0-9+/=_-]{{{length},}}"), F.lit(0)))).alias("token"))
    return found.withColumn("bits", entropy(F.col("token"))).where(F.col("bits") >= bits)


#: What a text or line must hold for any rule to match, told by one pass that never looks back.
POLICY_HINT = r"@|-----BEGIN|AKIA|password|secret|token|api_?key|[0-9]{4}[ -]?[0-9]{4}|[+][0-9]"


def policy_findings(docs: DataFrame, id_col: str, text_col: str, rules: tuple[tuple[str, str], ...] = POLICY_RULES, hint: str = POLICY_HINT) -> DataFrame:
    """``(id, line, kind)``: at most one finding a line, of the first rule that matches; values are not kept.

    ``hint`` is a pattern that every text with a match has."""
    hinted = docs.where(F.col(text_col).rlike(hint))
    lines = hinted.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "text")).where(F.col("text").rlike(hint))
    kind = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        kind = F.when(F.col("text").rlike(rule), name).otherwise(kind)
    return lines.select("id", (F.col("pos") + 1).cast("long").alias("line"), kind.alias("kind")).where("kind is not null")


def readability(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, words, sentences, syllables, grade)``: Flesch-Kincaid grade to one place.

    Syllables of a word are its vowel runs without one final e, one at least:
    counted over the whole text, and one more for each word without any.
    """
    low = F.lower(F.col(text_col))
    runs = F.regexp_count(F.regexp_replace(low, "e(?![a-z])", ""), F.lit("[aeiouy]+"))
    without = F.regexp_count(low, F.lit("(?<![a-z])(?:[bcdfghjklmnpqrstvwxz]+e?|e)(?![a-z])"))
    counts = docs.select(
        F.col(id_col).alias("id"),
        F.regexp_count(low, F.lit("[a-z]+")).cast("long").alias("words"),
        F.greatest(F.lit(1), F.regexp_count(F.col(text_col), F.lit("[A-Za-z][^.!?]*"))).cast("long").alias("sentences"),
        (runs + without).cast("long").alias("syllables"),
    ).where("words > 0")
    return counts.withColumn("grade", numbers.half_up(0.39 * F.col("words") / F.col("sentences") + 11.8 * F.col("syllables") / F.col("words") - 15.59, 1))


def set_similarity(sets: DataFrame, id_col: str, set_col: str, least: float = 0.6) -> DataFrame:
    """``(a, b, similarity)``: pairs of sets whose Jaccard similarity, rounded to two places first, reaches ``least``.

    Prefix filtering keeps the posting join small: members are ordered from rare
    to frequent, and a pair that reaches the threshold shares one of each side's
    first n - ceil(t n) + 1 members. Rows with equal sets should be one row.
    """
    reps = sets.select(F.col(id_col).alias("id"), F.col(set_col).alias("grams"), F.size(set_col).alias("size"))
    posted = reps.select("id", "size", F.explode("grams").alias("gram"))
    counts = posted.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "gram")
    cut = least - 0.005
    prefix = posted.join(counts, "gram").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("size") - F.ceil(cut * F.col("size")) + 1)
    a = prefix.select("gram", F.col("id").alias("a"), F.col("size").alias("size_a"))
    b = prefix.select("gram", F.col("id").alias("b"), F.col("size").alias("size_b"))
    near = a.join(b, "gram").where((F.col("a") < F.col("b")) & (F.least("size_a", "size_b") >= cut * F.greatest("size_a", "size_b"))).select("a", "b").distinct()
    full = lambda s: reps.select(F.col("id").alias(s), F.col("grams").alias(f"grams_{s}"))
    scored = near.join(full("a"), "a").join(full("b"), "b").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
    ratio = F.col("common") / (F.size("grams_a") + F.size("grams_b") - F.col("common"))
    return scored.select("a", "b", numbers.half_up(ratio, 2).alias("similarity")).where(F.col("similarity") >= least)
