"""Inputs, reasons and gates by value."""

from pyspark.sql import functions as F

from foliant.operators import conversion as op


def test_inputs(spark):
    want = {
        "2401.12345": ("arxiv", "2401.12345", None), "arXiv:hep-th/9901001v2": ("arxiv", "hep-th/9901001", 2), "2401.12345v0": ("arxiv", "2401.12345", 0), "HTTPS://ArXiv.org/abs/2401.12345": ("arxiv", "2401.12345", None),
        "https://arxiv.org/pdf/2401.12345v3.pdf": ("arxiv", "2401.12345", 3), "https://arxiv.org/abs/2401.12345/": (None, None, None), "https://arxiv.org/abs/hep-th%2F9901001": ("arxiv", "hep-th/9901001", None),
        "https://arxiv.org/html/2401.12345.pdf": (None, None, None), "https://example.org/x.pdf": (None, None, None), "p.PDF": ("pdf-local", None, None), "a/b.tar.gz": ("latex-local", None, None), "math.GT/0309136": ("arxiv", "math.GT/0309136", None), "2401.123": (None, None, None),
    }
    d = spark.createDataFrame([(k,) for k in want], "raw string").select("raw", op.resolve(F.col("raw")).alias("x"))
    assert {r["raw"]: tuple(r["x"]) for r in d.collect()} == want


def test_slugs(spark):
    rows = [("latex-local", None, None, "d/a b  c.tar.gz"), ("pdf-local", None, None, "x/é.pdf"), ("arxiv", "hep-th/9901001", 2, ""), ("latex-local", None, None, "main.v2.tex"), (None, None, None, "z")]
    d = spark.createDataFrame(rows, "kind string, paper string, version int, raw string")
    assert [r["s"] for r in d.select(op.slug(F.col("kind"), F.col("paper"), F.col("version"), F.col("raw")).alias("s")).collect()] == ["a-b--c", "-", "arxiv-hep-th-9901001v2", "main.v2", None]


def test_gate(spark):
    body = "<title>T</title><div class='ltx_para'>x</div>"
    marks = "<i class='a ltx_ERROR b'></i>"
    pages = [
        (body, None, 0), ("<h1>T</h1><p class=ltx_section>", "html-missing-title", 0), ("<title>T</title><p class='ltx_paragraph'>", "html-no-content", 0), (body + "<p>Conversion Pending", "html-stub", 0),
        (body + "w" * 40 * 1024 + marks * 60, "html-low-quality", 60), (body + "w" * 200 * 1024 + marks * 5, None, 5), (body + marks * 20, None, 20), (body + marks * 21, "html-low-quality", 21), ("<title> </title><title>b</title><p class='x ltx_para'>", None, 0),
    ]
    d = op.quality_gate(spark.createDataFrame([(i, p[0]) for i, p in enumerate(pages)], "id int, html string")).orderBy("id").collect()
    assert [(r["reason"], r["markers"]) for r in d] == [p[1:] for p in pages] and all(r["ok"] == (r["reason"] is None) for r in d)


def test_codes():
    assert (op.EXIT["input"], op.EXIT["fetch"], op.EXIT["conversion"], op.EXIT["security"]) == (3, 4, 5, 9) and len(op.REASONS) == 11
