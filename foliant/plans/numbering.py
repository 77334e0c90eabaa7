"""Queries on anchors and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbering as op
from ..sources import adapters as a
from .base import Entry


def anchor_ids(spark, sf_dir):
    return op.anchors(a.headings(spark, sf_dir)).selectExpr("doc", "cast(n as bigint) n", "anchor")


def _heads(spark, sf_dir):
    return a.headings(spark, sf_dir).selectExpr("doc", "cast(n as bigint) n", "level", "captioned as numbered", "n > 5 as appendix")


def section_number(spark, sf_dir):
    return op.section_numbers(_heads(spark, sf_dir)).select("doc", "n", "number")


SECTION = """,
h AS (SELECT doc, n, level, captioned AS num, n > 5 AS app,
  (SELECT max(p.n) FROM headings p WHERE p.doc = h.doc AND p.n <= h.n AND p.level <= 1) AS p1, (SELECT max(p.n) FROM headings p WHERE p.doc = h.doc AND p.n <= h.n AND p.level <= 2) AS p2 FROM headings h),
c AS (SELECT h.*, (SELECT count(*) FROM h x WHERE x.doc = h.doc AND x.app = h.app AND x.n <= h.n AND x.num AND x.level = 1) AS c1,
  (SELECT count(*) FROM h x WHERE x.doc = h.doc AND x.app = h.app AND x.n <= h.n AND x.num AND x.level = 2 AND x.n > coalesce(h.p1, 0)) AS c2,
  (SELECT count(*) FROM h x WHERE x.doc = h.doc AND x.app = h.app AND x.n <= h.n AND x.num AND x.level = 3 AND x.n > coalesce(h.p2, 0)) AS c3 FROM h)
SELECT doc, n, CASE WHEN num THEN concat_ws('.', CASE WHEN c1 > 0 THEN CASE WHEN level = 1 AND app THEN chr(64 + CAST(c1 AS INT)) ELSE CAST(c1 AS VARCHAR) END END,
  CASE WHEN level >= 2 AND c2 > 0 THEN CAST(c2 AS VARCHAR) END, CASE WHEN level >= 3 AND c3 > 0 THEN CAST(c3 AS VARCHAR) END) END AS number FROM c
"""


def section_parent(spark, sf_dir):
    return op.section_parents(a.headings(spark, sf_dir))


PARENT = """ SELECT h.doc, h.n, coalesce((SELECT max(p.n) FROM headings p WHERE p.doc = h.doc AND p.n < h.n AND p.level < h.level), 0) AS parent FROM headings h"""


def figure_number(spark, sf_dir):
    return op.captioned_numbers(a.headings(spark, sf_dir).where("kind = 'fig'")).selectExpr("doc", "cast(n as bigint) n", "number")


def _rows(spark, sf_dir):
    d = a.headings(spark, sf_dir)
    d = d.selectExpr("*", "cast(count_if(level = 1) over (partition by doc order by n) as bigint) as section").where("kind = 'eq'")
    return d.select("doc", F.col("n").cast("long").alias("n"), "section", F.explode(F.expr("sequence(1, level)")).alias("row"), "level").selectExpr("doc", "n", "section", "cast(row as bigint) as row", "(n + row) % 3 > 0 as numbered")


def equation_number(spark, sf_dir):
    return op.equation_numbers(_rows(spark, sf_dir)).select("doc", "n", "row", "number")


def equation_number_within(spark, sf_dir):
    return op.equation_numbers(_rows(spark, sf_dir), True).select("doc", "n", "row", "number")


ROWS = """,
s AS (SELECT *, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc ORDER BY n) AS section FROM headings),
r AS (SELECT doc, n, section, unnest(range(1, level + 1)) AS row FROM s WHERE kind = 'eq'),
q AS (SELECT *, (n + row) % 3 > 0 AS num FROM r)
"""


def label_asof(spark, sf_dir):
    d = a.headings(spark, sf_dir).selectExpr("doc", "cast(n as bigint) n", "case when kind = 'para' then 'label' else kind end as kind", "captioned as numberable")
    return op.label_targets(d)


def toc(spark, sf_dir):
    """Sections in order, with their indent."""
    d = a.headings(spark, sf_dir).where("kind = 'sec'")
    return d.selectExpr("doc", "cast(row_number() over (partition by doc order by n) as bigint) as place", "concat(repeat('  ', level - 1), 'sec ', n) as entry")


def bib_labels(spark, sf_dir):
    """The label of an entry, else its number, else a question mark."""
    return a.read(spark, sf_dir, "part").selectExpr("p_partkey", "coalesce(case when p_size % 3 = 0 then p_brand end, case when p_size % 3 = 1 then cast(p_size as string) end, '?') as label")


def backlink_seq(spark, sf_dir):
    """Ids of repeated references to one target: the second is -2, the third -3."""
    t = a.read(spark, sf_dir, "lineitem")
    d = a.spread(t.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), t, "l_partkey")
    d = d.selectExpr("l_partkey", "row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity) as k")
    # target and number stand for the id, and are counted where they are; all references without a target have the same id, null
    d = d.selectExpr("l_partkey", "case when l_partkey is not null then k end as k").groupBy("l_partkey", "k").agg(F.count("*").alias("n"))
    return d.selectExpr("concat('ref-', l_partkey, case when k > 1 then concat('-', k) else '' end) as id", "n")


ENTRIES = {
    "anchor_ids": Entry(anchor_ids, a.with_sql("headings", " SELECT doc, n, kind || '-' || row_number() OVER (PARTITION BY doc, kind ORDER BY n) AS anchor FROM headings")),
    "section_number": Entry(section_number, a.with_sql("headings", SECTION)),
    "section_parent": Entry(section_parent, a.with_sql("headings", PARENT)),
    "figure_number": Entry(figure_number, a.with_sql("headings", " SELECT doc, n, CASE WHEN captioned THEN count(*) FILTER (WHERE captioned) OVER (PARTITION BY doc, kind ORDER BY n) END AS number FROM headings WHERE kind = 'fig'")),
    "equation_number": Entry(equation_number, a.with_sql("headings", ROWS + "SELECT doc, n, row, CASE WHEN num THEN '(' || count(*) FILTER (WHERE num) OVER (PARTITION BY doc ORDER BY n, row) || ')' END AS number FROM q")),
    "equation_number_within": Entry(equation_number_within, a.with_sql("headings", ROWS + "SELECT doc, n, row, CASE WHEN num THEN '(' || section || '.' || count(*) FILTER (WHERE num) OVER (PARTITION BY doc, section ORDER BY n, row) || ')' END AS number FROM q")),
    "label_asof": Entry(label_asof, a.with_sql("headings", " SELECT doc, n, (SELECT max(p.n) FROM headings p WHERE p.doc = h.doc AND p.n < h.n AND p.kind <> 'para' AND p.captioned) AS target FROM headings h WHERE kind = 'para'")),
    "toc": Entry(toc, a.with_sql("headings", " SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) AS place, repeat('  ', level - 1) || 'sec ' || n AS entry FROM headings WHERE kind = 'sec'")),
    "bib_labels": Entry(bib_labels, "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) END, '?') AS label FROM part"),
    "backlink_seq": Entry(backlink_seq, "SELECT id, count(*) AS n FROM (SELECT 'ref-' || l_partkey || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k FROM lineitem)) GROUP BY id"),
}
