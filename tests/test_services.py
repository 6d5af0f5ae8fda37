"""Decoding, source passages, evidence, manifests and packed vectors on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import facets as A
from tidemark.operators import history as H
from tidemark.operators import passages as P
from tidemark.operators import vectors as V
from tidemark.sources import decoding as D

KANA = "これはテストのぶんしょうです。ひらがなとカタカナがたくさんあります。"


@pytest.mark.parametrize("encoding, said", [("shift_jis", "shift_jis"), ("euc_jp", "euc_jp"), ("utf-8", "utf-8"), ("utf-8-sig", "utf-8-sig"), ("utf-16", "utf-16"), ("utf-32", "utf-32"), ("iso2022_jp", "iso2022_jp")])
def test_japanese_sources(encoding, said):
    text, found, _, damaged = D.read_bytes(KANA.encode(encoding))
    assert (text, found, damaged) == (KANA, said, 0)


def test_western_mixed_and_damaged_sources():
    assert D.read_bytes("naïve “café”".encode("cp1252")) == ("naïve “café”", "cp1252", "fallback", 0)
    assert D.read_bytes(b"\x81\x8d\x8f") == ("\x81\x8d\x8f", "iso8859-1", "fallback", 0)
    assert D.read_bytes(b'<meta charset="iso-8859-2">\xe6\xb1')[1] == "iso8859-2"
    assert D.read_bytes("é\n".encode() + "ü\n".encode("cp1252") + b"a") == ("é\nü\na", "mixed", "lines", 0)
    text, encoding, _, damaged = D.read_bytes(KANA.encode("shift_jis") + b"\x81")
    assert text.startswith(KANA) and encoding == "shift_jis" and damaged == 1
    assert D.read_bytes(b"") == ("", "utf-8", "valid", 0)


def test_decoded_rows_and_titles(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\xe9")), (1, bytearray(b"\xe9")), (None, None), (2, bytearray())], "k long, c binary")
    got = sorted(map(tuple, D.decoded(rows, "k", "c").collect()), key=repr)
    assert got == sorted([(1, "é", "cp1252", "fallback", 0)] * 2 + [(None,) * 5, (2, "", "utf-8", "valid", 0)], key=repr)
    titles = spark.createDataFrame([("Ã©", "é"), ("x", "é"), (None, "é"), ("y", None)], "a string, b string")
    assert [r[0] for r in titles.select(D.repaired(F.col("a"), F.col("b"))).collect()] == ["é", "x", None, "y"]


def covered(text, budget, overlap):
    """Checks what every plan must keep, and returns the passages."""
    out, reach = P.spans(text, budget, overlap), 0
    for start, end, tokens in out:
        assert start <= reach < end and tokens <= budget and tokens == len([k for k in P.token_starts(text) if start <= k < end])
        reach = end
    assert reach == len(text) and [s for s, _, _ in out] == sorted({s for s, _, _ in out})
    return out


def test_passages_prefer_paragraphs_then_sentences_then_words():
    first = lambda t: t[: covered(t, 10, 2)[0][1]]
    assert first("a b c d e f\n\ng. h i j k l m n") == "a b c d e f\n\n"
    assert first("a b c d e f. g h i j k l m n") == "a b c d e f. "
    assert first("a b c d e f g h i j k l m n") == "a b c d e f g h i j "
    assert first("a.\n\nb c d e f g h i j k l m") == "a.\n\nb c d e f g h i "


def test_passages_of_any_text():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300):
        for _ in range(40):
            covered("".join(rng.choice(list("ab.é \n𝄞"), n)), 12, 3)
    covered("é" * 1000, 30, 4)
    assert len(P.token_starts("é" * 101)) == 202 and len(P.token_starts("é" * 100)) == 1


def test_passage_rows(spark):
    df = spark.createDataFrame([(1, "one two. " * 40, "x"), (2, None, "y"), (3, "", "z"), (4, "\n", "w")], "id long, t string, body string")
    got = P.source_passages(df, "id", "t", "title: x", 20, 2)
    assert {r.id: r.text for r in P.stitched(got, "id").collect()} == {1: "one two. " * 40, 4: "\n"}
    assert P.source_passages(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError):
        P.source_passages(df, "id", "t", "", 8, 4)


def test_evidence_falls_back(spark):
    df = spark.createDataFrame([(1, 0, 2.0, None), (1, 1, 2.0, 3.0), (2, 4, None, 0.0), (2, 5, 0.0, None)], "d long, p long, s double, l double")
    assert sorted(map(tuple, P.evidence(df, "d", "p", "s", "l").collect())) == [(1, 0, 1, None), (2, None, None, 4)]


def test_manifest_and_batches(spark):
    entries = spark.createDataFrame([(1, "a/x", None, 3, "h"), (2, "a/x", 1, 4, "g"), (3, "b/y", 9, 1, "k")], "id long, path string, parent long, size long, sha256 string")
    files = spark.createDataFrame([(1, 3, "h"), (2, 3, "h")], "id long, size long, sha256 string")
    got = sorted(map(tuple, H.manifest_problems(entries, files, ["a/"]).collect()))
    assert got == [(1, "path used twice"), (2, "digest"), (2, "path used twice"), (2, "size"), (3, "missing"), (3, "no parent"), (3, "outside scope")]
    asked = spark.createDataFrame([(1, 1, "h"), (2, 1, "h"), (2, 1, "h"), (3, 2, "old"), (4, 7, "h"), (5, 1, "h"), (5, 2, "h")], "batch long, id long, sha256 string")
    got = sorted(map(tuple, H.whole_batches(asked, files, 1).collect()))
    assert got == [(1, True, 0), (2, False, 0), (3, False, 1), (4, False, 1), (5, False, 0)]


def test_packed_vectors_and_defaults(spark):
    df = spark.createDataFrame([(1, [0.1, -2.5]), (2, []), (3, None)], "k long, v array<float>").withColumn("p", V.packed("v"))
    assert df.where("not v <=> array(0f)").count() == 3
    back = {r.k: r.same for r in df.select("k", F.col("v").eqNullSafe(V.unpacked("p")).alias("same")).collect()}
    assert back == {1: True, 2: True, 3: True}
    assert spark.createDataFrame([("!!",), ("AAA=",)], "p string").select(V.unpacked("p").alias("v")).where("v is null").count() == 2
    rows = spark.createDataFrame([(1, None)], "a long, b string")
    assert A.with_defaults(rows, {"a": None, "b": "none"}).collect()[0] == (1, "none")
    with pytest.raises(ValueError):
        A.with_defaults(rows, {"a": None})
