"""Citations, references, splices and regions by value."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.masking import redact
from foliant.operators import licences, linking


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def test_citations(spark):
    d = texts(spark, "See [1,3] and [99].", "[1-79] x", "[3; 1] [2-1] [1, 2 - 4]", "[1-3, 5] [1234] [ 7]", None)
    bib = spark.createDataFrame([(n, f"bib-{n}") for n in range(1, 80)], "number int, bib_id string")
    got = linking.cite_links(linking.cite_numbers(d), bib).orderBy("id", "start").collect()
    assert [(r["id"], r["start"], r["end"], r["bib_ids"]) for r in got] == [
        (0, 4, 9, ["bib-1", "bib-3"]), (1, 0, 6, [f"bib-{n}" for n in range(1, 51)]), (2, 0, 6, ["bib-3", "bib-1"]), (2, 13, 23, ["bib-1", "bib-2", "bib-3", "bib-4"]),
    ]


def test_structural_refs(spark):
    d = texts(spark, "Eq 3 and fig. 2a, Fig 4; SECTION 1.2, § 3", "Eq. (3) links, Fig. 2 does not", "Freq 3")
    known = [("eq", "3", "e3"), ("fig", "2a", "f2a"), ("fig", "4", "f4"), ("sec", "1.2", "s12"), ("sec", "3", "s3")]
    got = linking.structural_refs(d, spark.createDataFrame(known, "kind string, number string, target string")).orderBy("id", "start").collect()
    assert [(r["id"], r["target"], r["start"], r["end"]) for r in got] == [(0, "e3", 0, 4), (0, "f2a", 9, 16), (0, "f4", 18, 23), (0, "s12", 25, 36), (0, "s3", 38, 41), (1, "e3", 0, 7)]


def test_splices_equal_a_loop(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("abé ") for _ in range(60)), [(a, a + r.randint(0, 9)) for a in (r.randint(0, 50) for _ in range(12))]) for _ in range(30)]
    spans = spark.createDataFrame([(i, a, b) for i, (_, xs) in enumerate(rows) for a, b in xs], "id long, start int, end int")
    kept = linking.non_overlapping(spans)
    got = {}
    for x in linking.apply_splices(texts(spark, *[t for t, _ in rows]), kept).orderBy("id", "seq").collect():
        got.setdefault(x["id"], []).append((x["piece"], x["spliced"]))
    for i, (t, xs) in enumerate(rows):
        at, want = 0, []
        for a, b in sorted((x for x in xs if x[1] > x[0]), key=lambda x: (x[0], -x[1])):
            if a >= at:
                want += [(t[at:a], False), (t[a:b], True)]
                at = b
        assert got[i] == [x for x in [*want, (t[at:], False)] if x[0]]


def test_spans_beyond_the_text_are_refused(spark):
    spans = spark.createDataFrame([(0, 1, 9)], "id long, start int, end int")
    with pytest.raises(Exception, match="spans overlap or leave the text"):
        linking.apply_splices(texts(spark, "abc"), spans).collect()


def test_regions(spark):
    box = "doc int, page int, block int, l double, b double, r double, t double"
    blocks = spark.createDataFrame([(1, 1, 1, 40.0, 100.0, 250.0, 300.0), (1, 1, 2, 400.0, 500.0, 460.0, 560.0), (1, 2, 3, 0.0, 0.0, 30.0, 500.0), (1, 3, 4, 500.0, 400.0, 590.0, 450.0)], box)
    captions = [(1, 1, 11, None, 260.0, 150.0, 400.0, 170.0), (1, 2, 12, None, 40.0, 100.0, 400.0, 120.0), (1, 3, 13, None, 0.0, 300.0, 90.0, 310.0), (1, 1, 14, 2, 260.0, 150.0, 400.0, 170.0), (1, 4, 15, None, 0.0, 0.0, 1.0, 1.0)]
    got = linking.pair_regions(spark.createDataFrame(captions, "doc int, page int, id int, linked int, l double, b double, r double, t double"), blocks).orderBy("id").collect()
    assert [(r["id"], r["block"], r["rank"], r["missing"]) for r in got] == [(11, 1, 1, False), (12, 3, 1, True), (13, 4, 2, False), (14, 2, 0, False), (15, None, None, True)]


def test_masks_and_licences(spark):
    d = texts(spark, "key sk-abcdefgh Authorization : Bearer x.y sk-short hunter2secret")
    assert d.select(redact(F.col("text"), ("hunter2secret",)).alias("t")).first()["t"] == "key *** Authorization : Bearer *** sk-short ***"
    rows = [("MIT", True), ("MIT OR GPL-3.0", True), ("GPL-3.0 OR Zlib", False), ("Apache-2.0 AND MIT", True), ("BSD License; GPL", False), ("GPL, MIT OR ISC", True), ("MIT/Zlib", False), ("MIT OR (GPL AND MIT)", False), ("BSD (3 clause)", True), ("psf license", True)]
    d = spark.createDataFrame(rows, "x string, want boolean")
    assert [r["x"] for r in d.where(licences.permitted(F.col("x")) != F.col("want")).collect()] == []
    d = spark.createDataFrame([("Certifi", "1", "MPL-2.0"), ("other", "1", "MPL-2.0"), ("pypdfium2", "5.13.0", "BSD-3-Clause, Apache-2.0, dependency licenses")], "p string, v string, x string")
    assert [r["ok"] for r in d.select(licences.passes(F.col("p"), F.col("v"), F.col("x")).alias("ok")).collect()] == [True, False, True]
