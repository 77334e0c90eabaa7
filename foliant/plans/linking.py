"""Queries on citations, references and splices. The tables hold none, so texts are made of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking as op
from ..sources import adapters as a
from .base import Entry


def _cited(spark, sf_dir):
    """Whole texts, then markers: with semicolon, comma and a closing range; those with an inner range or four digits are none."""
    return a.read(spark, sf_dir, "documents").selectExpr("doc_id as id", "concat(text, ' [', doc_id % 40 + 20, case doc_id % 2 when 0 then '; ' else ', ' end, doc_id % 7 + 1, '-', doc_id % 7 + 1 + doc_id % 5, '] [1-3, 5] [1234] and [', doc_id % 60, '].') as text")


TEXT = """t AS (SELECT doc_id AS id, length(text) AS ofs, doc_id % 40 + 20 AS x, doc_id % 7 + 1 AS lo, doc_id % 7 + 1 + doc_id % 5 AS hi, doc_id % 60 AS y FROM documents),
n AS (SELECT id, 0 AS marker, 0 AS k, ofs + 1 AS "start", x AS number FROM t UNION ALL SELECT id, 0, unnest(range(lo, hi + 1)), ofs + 1, unnest(range(lo, hi + 1)) FROM t
UNION ALL SELECT id, 1, 0, ofs + 1 + length('[' || x || ', ' || lo || '-' || hi || '] [1-3, 5] [1234] and '), y FROM t)"""


def cite_numeric(spark, sf_dir):
    d = op.cite_numbers(_cited(spark, sf_dir)).groupBy("id", "marker", "start")
    return d.agg(F.count("*").alias("n"), F.sum("number").cast("long").alias("total")).withColumn("start", F.col("start").cast("long"))


def cite_link(spark, sf_dir):
    bib = a.read(spark, sf_dir, "part").where("p_partkey % 8 > 0").selectExpr("cast(p_partkey as int) as number", "concat('bib-', p_partkey) as bib_id")
    return op.cite_links(op.cite_numbers(_cited(spark, sf_dir)), bib).selectExpr("id", "marker", "array_join(bib_ids, ' ') as bib_ids")


def _pointing(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").selectExpr("doc_id as id", "concat(replace(replace(text, '§', ' '), '  ', ' '), ' ~See EQ (', doc_id % 30, '), Fig ', doc_id % 20, 'a, Table ', doc_id % 10, ' and section ', doc_id % 5, '.', doc_id % 3, '.') as text")


def struct_refs(spark, sf_dir):
    p = a.read(spark, sf_dir, "part").where("p_size <= 25")
    targets = p.selectExpr("'eq' as kind", "cast(p_partkey as string) as number", "concat('eq-', p_partkey) as target").union(p.selectExpr("'fig'", "concat(p_partkey, 'a')", "concat('fig-', p_partkey)"))
    d = op.structural_refs(_pointing(spark, sf_dir), targets)
    return d.selectExpr("id", "kind", "number", "target", "cast(start as bigint) as start", "cast(end as bigint) as end")


STRUCT = """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_size <= 25), d AS (SELECT doc_id AS id, length(replace(replace(text, '§', ' '), '  ', ' ')) + 6 AS ofs, doc_id % 30 AS e, doc_id % 20 AS f FROM documents)
SELECT id, 'eq' AS kind, CAST(k AS VARCHAR) AS number, 'eq-' || k AS target, ofs AS start, ofs + 5 + length(CAST(k AS VARCHAR)) AS "end" FROM d JOIN p ON k = e
UNION ALL SELECT id, 'fig', k || 'a', 'fig-' || k, ofs + 5 + length(CAST(e AS VARCHAR)) + 2, ofs + 5 + length(CAST(e AS VARCHAR)) + 2 + 5 + length(CAST(k AS VARCHAR)) FROM d JOIN p ON k = f"""


def _spans(spark, sf_dir):
    return a.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", "cast(l_partkey % 60 as int) as start", "cast(l_partkey % 60 + 1 + l_suppkey % 9 as int) as end")


SPANS = "s AS (SELECT l_orderkey AS id, l_partkey % 60 AS a, l_partkey % 60 + 1 + l_suppkey % 9 AS b FROM lineitem), o AS (SELECT id, a, b, row_number() OVER (PARTITION BY id ORDER BY a, b DESC) AS k FROM s), g AS (SELECT id, k, a, b, true AS kept, b AS upto FROM o WHERE k = 1 UNION ALL SELECT o.id, o.k, o.a, o.b, o.a >= g.upto, CASE WHEN o.a >= g.upto THEN o.b ELSE g.upto END FROM g JOIN o ON o.id = g.id AND o.k = g.k + 1)"


def splice_nonoverlap(spark, sf_dir):
    return op.non_overlapping(_spans(spark, sf_dir))


def splice_apply(spark, sf_dir):
    """Spans laid into whole texts; those that leave a text go first."""
    texts = a.read(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")
    spans = _spans(spark, sf_dir).join(texts.selectExpr("id", "length(text) as n"), "id").where("end <= n").drop("n")
    return op.apply_splices(texts, op.non_overlapping(spans)).selectExpr("id", "seq", "md5(piece) as piece_md5", "spliced")


def ref_display(spark, sf_dir):
    targets = a.read(spark, sf_dir, "part").where("p_size <= 25").selectExpr("p_partkey as label", "case p_partkey % 4 when 0 then 'eq' when 1 then 'fig' when 2 then 'tab' else 'sec' end as kind", "cast(p_size as string) as number")
    refs = a.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", "struct(l_linenumber, l_partkey, l_suppkey) as seq", "l_partkey as label", "case l_orderkey % 3 when 0 then 'ref' when 1 then 'eqref' else 'cref' end as form")
    return op.reference_text(refs, targets)


DISPLAY = """WITH j AS (SELECT l_orderkey AS id, CASE l_orderkey % 3 WHEN 0 THEN 'ref' WHEN 1 THEN 'eqref' ELSE 'cref' END AS form, l_linenumber AS a, l_partkey AS b, l_suppkey AS c,
  CASE WHEN p_partkey IS NULL THEN 'Section' ELSE CASE p_partkey % 4 WHEN 0 THEN 'Eq.' WHEN 1 THEN 'Fig.' WHEN 2 THEN 'Table' ELSE 'Section' END END AS w, CAST(p_size AS VARCHAR) AS num
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey),
g AS (SELECT id, form, string_agg(CASE WHEN num IS NULL THEN '??' WHEN form = 'eqref' THEN '(' || num || ')' ELSE num END, ', ' ORDER BY a, b, c) AS s, count(*) AS n, arg_min(w, row(a, b, c)) AS w FROM j GROUP BY id, form)
SELECT id, form, CASE WHEN form = 'cref' THEN CASE WHEN n > 1 THEN rtrim(w, '.') || 's.' ELSE w END || ' ' || s ELSE s END AS shown FROM g"""


def _boxes(spark, sf_dir):
    d = a.read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as doc", "l_orderkey % 50 as page", "l_orderkey * 10 + l_linenumber as block", "cast(l_partkey % 400 as double) as l", "cast(l_partkey % 700 as double) as b",
        "cast(l_partkey % 400 + 20 + l_quantity as double) as r", "cast(l_partkey % 700 + 10 + l_quantity * 3 as double) as t", "l_quantity",
    )
    # boxes can repeat: one of them, by value
    return d.groupBy("doc", "page", "block").agg(F.min(F.struct("l_quantity", *"lbrt")).alias("x")).select("doc", "page", "block", "x.*")


def region_pair(spark, sf_dir):
    d = _boxes(spark, sf_dir)
    captions = d.where("l_quantity < 3").selectExpr("doc", "page", "block as id", "case when block % 4 = 0 then block + 1 end as linked", "l", "b", "r", "t")
    return op.pair_regions(captions, d.where("l_quantity >= 3")).withColumn("rank", F.col("rank").cast("int"))


REGION = """WITH x AS (SELECT l_suppkey AS doc, l_orderkey % 50 AS page, l_orderkey * 10 + l_linenumber AS block, CAST(l_partkey % 400 AS DOUBLE) AS l, CAST(l_partkey % 700 AS DOUBLE) AS b, CAST(l_partkey % 400 + 20 + l_quantity AS DOUBLE) AS r, CAST(l_partkey % 700 + 10 + l_quantity * 3 AS DOUBLE) AS t, l_quantity AS q FROM lineitem),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, block ORDER BY q, l, b, r, t) AS i FROM x) WHERE i = 1),
c AS (SELECT * FROM d WHERE q < 3),
j AS (SELECT c.doc, c.page, c.block AS id, o.block, o.l, o.b, o.r, o.t, CASE WHEN c.block % 4 = 0 AND o.block = c.block + 1 THEN 0 WHEN least(o.t, c.t) > greatest(o.b, c.b) AND (o.r <= c.l OR o.l >= c.r) THEN 1 WHEN o.b >= c.t THEN 2 END AS rank
  FROM c JOIN d o ON c.doc = o.doc AND c.page = o.page WHERE o.q >= 3),
w AS (SELECT *, row_number() OVER (PARTITION BY doc, page, id ORDER BY rank, (r - l) * (t - b) DESC, block) AS i FROM j WHERE rank IS NOT NULL)
SELECT c.doc, c.page, c.block AS id, w.block, CAST(w.rank AS INT) AS rank, w.l, w.b, w.r, w.t, coalesce(least(w.r - w.l, w.t - w.b) < 40, true) AS missing
FROM c LEFT JOIN w ON w.doc = c.doc AND w.page = c.page AND w.id = c.block AND w.i = 1"""

ENTRIES = {
    "cite_numeric": Entry(cite_numeric, f'WITH {TEXT} SELECT id, CAST(marker AS INT) AS marker, CAST("start" AS BIGINT) AS start, count(*) AS n, CAST(sum(number) AS BIGINT) AS total FROM n GROUP BY id, marker, "start"'),
    "cite_link": Entry(cite_link, f"WITH {TEXT}, b AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 8 > 0) SELECT id, CAST(marker AS INT) AS marker, string_agg('bib-' || p, ' ' ORDER BY k) AS bib_ids FROM n LEFT JOIN b ON p = number GROUP BY id, marker HAVING count(*) = count(p)"),
    "struct_refs": Entry(struct_refs, STRUCT),
    "splice_nonoverlap": Entry(splice_nonoverlap, f'WITH RECURSIVE {SPANS} SELECT id, CAST(a AS INT) AS start, CAST(b AS INT) AS "end" FROM g WHERE kept'),
    # the greedy pass over whole texts has no cheap SQL form; a test holds it against a loop
    "splice_apply": Entry(splice_apply),
    "ref_display": Entry(ref_display, DISPLAY),
    "region_pair": Entry(region_pair, REGION),
}
