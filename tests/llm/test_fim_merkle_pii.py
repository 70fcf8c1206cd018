"""Fill-in-the-middle, Merkle manifests and personal data against brute force and edge cases."""

import hashlib
import itertools
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartulary.llm import fim, merkle, pii, shared

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(d.doc_id.tolist(), d.text.tolist()))


# fill in the middle


def fim_by_slices(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_slices(spark, texts):
    rng = random.Random(3)
    bits = ["a", "Bcd", " ", "é", "😀", "<", "P>", "S>", "M>", "<P", "\n", "\0", "9"]
    rows = [*texts.items(), (None, "a text without an id"), (-1, None), (-2, ""), (-3, "x <M> y"), (-4, "ab é " * 400_000), (7, "twice"), (7, "twice")]
    rows += [(10_000 + i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(1500)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, DOCS)).withColumn("back", fim.restored("output", "form")).collect()
    assert len(out) == len(rows) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_by_slices(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_fill_in_middle_of_clashing_names_and_nothing(spark):
    df = spark.createDataFrame([(1, "one two three", "x", "y", "z")], "doc_id long, text string, n string, output string, lang string")
    (row,) = fim.fill_in_middle(df).collect()
    assert row.n == 5 and row.lang == "z" and row.text == "one two three"
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert fim.restore(None, None) is None


def test_exchange_is_its_own_inverse():
    data = bytearray(b"--abcdefg--")
    fim.exchange(data, 2, 5, 9)
    assert data == b"--defgabc--"
    fim.exchange(data, 2, 6, 9)
    assert data == b"--abcdefg--"


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def brute_manifest(rows):
    """rows: (id, group, leaf, claim)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3] is not None, r[3] or "")):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([r[2] for r in groups[g]]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            folded = r[3] or r[2]
            for left, right in path:
                folded = H(*left, folded, *right)
            out.append((r[0], r[2], trees[g][-1][0], top[-1][0], H(*[x for both in path for side in both for x in side]), folded, folded == top[-1][0]))
    return out


def as_set(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 16, None: 17},
        {"a": 5000, "b": 1, "": 2, "é": 300, None: 257},
        {f"g{i}": 1 + i % 3 for i in range(300)},
    ],
)
def test_manifest_against_brute_force(spark, sizes):
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            i += 1
            leaf = H("leaf", str(i))
            rows.append((i * 7919 % 100_003, g, leaf, H("other", str(i)) if i % 5 == 0 else leaf if i % 5 == 1 else None))
    rows += rows[:3] + [(None, rows[0][1], H("null"), None)]
    df = spark.createDataFrame(rows, "id long, g string, leaf string, claim string").repartition(5)
    tree = merkle.manifest(df, "id", "g", "leaf", "claim")
    found = merkle.prove(tree).collect()
    assert as_set(found) == as_set(brute_manifest(rows))
    assert any(not r.verified for r in found) == any(r[3] not in (None, r[2]) for r in rows)
    assert {r.group: r.rows for r in tree.subroots().collect()} == {("" if g is None else f">{g}"): sum(r[1] == g for r in rows) for g in sizes}


def test_manifest_of_three_layers(spark):
    n = 70_000
    df = spark.range(n).select("id", F.lit("all").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    tree = merkle.manifest(df, "id", "g", "leaf")
    assert len(tree.groups) == 4
    want = {r[0]: r for r in brute_manifest([(i, "all", H(str(i)), None) for i in range(n)])}
    got = merkle.prove(tree).where("id % 997 = 0 or id = 69999").collect()
    assert len(got) == 72 and all(tuple(r) == want[r.id] for r in got)


def test_manifest_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = df.select("doc_id", "source", merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    (one,) = merkle.prove(merkle.manifest(rows, "doc_id", "source", "leaf")).collect()
    assert one.leaf == one.root == one.subroot == one.folded_root == H("-----") and one.id is None and one.proof_sha256 == H("") and one.verified
    none = merkle.manifest(rows.limit(0), "doc_id", "source", "leaf")
    assert none.root is None and merkle.prove(none).count() == 0


def test_leaf_tells_null_from_empty_and_counts_bytes(spark):
    df = spark.createDataFrame([(1, "é"), (2, ""), (3, None)], DOCS)
    got = {r.doc_id: r.leaf for r in df.select("doc_id", merkle.leaf_digest(F.col("doc_id"), F.col("text")).alias("leaf")).collect()}
    assert got == {1: H("1:12:é"), 2: H("1:20:"), 3: H("1:3-")}


# personal data


def luhn(digits):
    double = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in double) % 10 == 0


def plain_spans(text):
    found = []
    for order, kind in enumerate(k for k in pii.KINDS if k.base):
        for m in re.finditer(kind.plain, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind.name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind.name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind.name == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, kind.name, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def without(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def test_personal_data_against_plain_patterns(spark, texts):
    rng = random.Random(5)
    bits = ["a@b.c", "@", "x.", "é", "😀", "1", "255", ".", "-", " ", "+", "4111 1111 1111 1111", "+49 (30) 12345-678", "10.0.0.1", "00.1.2.300", "37828224631000", "5105-1051-0510-5100", "\n", "a.b%c@d-e.f.g", "..", "(", ")"]
    rows = [*texts.items(), (-1, None), (-2, ""), (None, "me@here.org"), (5, "twice me@here.org"), (5, "twice me@here.org")]
    rows += [(20_000 + i, "".join(rng.choices(bits, k=rng.randint(0, 25)))) for i in range(2000)]
    out = pii.find_personal(spark.createDataFrame(rows, DOCS)).withColumn("red", pii.redacted(F.col("text"), F.col("spans"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS] == plain_spans(r.text)
        assert r.red == (None if r.text is None else without(r.text, r.spans))


def test_context_and_checksums_decide_over_other_kinds(spark):
    rows = [
        (1, "my ssn is 123-45-6789"),
        (2, "part 123-45-6789 of the list"),
        (3, "ssn 000-45-6789"),
        (4, "pay to DE89 3704 0044 0532 0130 00 today"),
        (5, "pay to DE88 3704 0044 0532 0130 00 today"),
        (6, "an example: GB29NWBK60161331926819"),
        (7, "card 4111111111111111"),
        (8, "4111111111111111 is a sample"),
        (9, "release 1.2.3.4"),
    ]
    found = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii.find_personal(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1] == [("social", 55)] and found[2] == [] and found[3] == []
    assert found[4] == [("iban", 60)] and found[5] == [] and found[6] == []
    assert found[7] == [("card", 90)] and found[8] == [("card", 40)] and found[9] == [("ip", 35)]


def test_personal_data_is_native_and_takes_odd_tables(spark, capsys):
    df = spark.createDataFrame([(1, "write to a@b.org", "s", "k")], "doc_id long, text string, spans string, kind string")
    out = pii.find_personal(df, spans_col="found")
    out.explain()
    assert "Python" not in capsys.readouterr().out
    (row,) = out.collect()
    assert row.spans == "s" and row.kind == "k" and row.found[0].score == 100
    assert pii.find_personal(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, n", [("a@b.cc " * 30_000, 30_000), ("a" * 2_000_000, 0), ("1." * 500_000, 125_000), ("+1" + "." * 1_000_000, 0), ("7" * 2_000_000, 0)])
def test_long_texts_take_linear_time(spark, text, n):
    assert pii.find_personal(spark.createDataFrame([(1, text)], DOCS)).select(F.size("spans")).first()[0] == n


def test_running_folds_and_cuts(spark):
    lists = [list(range(n)) for n in (0, 1, 5, 127, 128, 129, 300)] + [[3, 1, 5, 2, 9, 1] * 50]
    df = spark.createDataFrame([(x,) for x in lists], "a array<bigint>")
    for r in df.select("a", shared.running_sums(F.col("a")).alias("s"), shared.running_maxima(F.col("a")).alias("m")).collect():
        assert r.s == list(itertools.accumulate(r.a)) and r.m == list(itertools.accumulate(r.a, max))
    text = "aé😀\n" * 900
    spans = [(0, 0), (0, 3600), (1000, 1024), (1024, 1030), (1023, 3000), (5, 2048), (2048, 3600)]
    cut = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a long, b long").select("a", "b", shared.cut(shared.text_blocks(F.col("t")), F.col("a"), F.col("b")).alias("c"))
    assert all(r.c == text[r.a : r.b] for r in cut.collect())
