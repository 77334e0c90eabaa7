"""Queries on referential integrity and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as op
from ..sources import adapters as a
from .base import Entry


def _refs(spark, sf_dir):
    return a.read(spark, sf_dir, "lineitem").selectExpr("1 as doc", "l_orderkey as owner", "l_linenumber as n", "case when l_quantity < 3 then '' else cast(l_partkey as string) end as target")


def _parts(spark, sf_dir):
    return a.read(spark, sf_dir, "part").where("p_size <= 25").selectExpr("1 as doc", "cast(p_partkey as string) as id")


def dangling_refs(spark, sf_dir):
    return op.dangling(_refs(spark, sf_dir), _parts(spark, sf_dir)).select("owner", "n", "target")


def unresolved_refs(spark, sf_dir):
    return _refs(spark, sf_dir).where("target = ''").groupBy("owner").agg(F.count("*").alias("unresolved"))


def orphan_assets(spark, sf_dir):
    refs = a.read(spark, sf_dir, "labels").selectExpr("1 as doc", "doc_id as target")
    return op.orphans(a.read(spark, sf_dir, "documents").selectExpr("1 as doc", "doc_id as id"), refs).select("id")


def duplicate_anchors(spark, sf_dir):
    return op.duplicates(a.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_partkey % 5 as id"))


def label_targets(spark, sf_dir):
    """Labels kept as a map for each document: entries that point to no anchor."""
    d = a.read(spark, sf_dir, "documents")
    maps = d.groupBy(F.col("source").alias("doc")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("l"), "doc_id").alias("k"), F.col("doc_id").alias("v"))))).alias("labels"))
    flat = maps.select("doc", F.explode("labels").alias("label", "target"))
    known = a.read(spark, sf_dir, "labels").selectExpr("doc_id as target").distinct()
    return flat.join(known, "target", "left_anti").select("doc", "label", "target")


def empty_sections(spark, sf_dir):
    o = a.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id")
    return o.join(a.read(spark, sf_dir, "lineitem").where("l_quantity > 45").selectExpr("l_orderkey as id"), "id", "left_anti")


def unnumbered_targets(spark, sf_dir):
    """References to equations without a number."""
    h = a.headings(spark, sf_dir).where("kind = 'eq' and not captioned").selectExpr("doc", "n as target")
    refs = a.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as ref", "cast(l_quantity % 7 as int) as target")
    return refs.join(h, ["doc", "target"]).selectExpr("doc", "ref", "cast(target as bigint) as target")


def url_schemes(spark, sf_dir):
    d = a.read(spark, sf_dir, "pages").selectExpr("page_id", "case page_id % 4 when 0 then replace(url, 'http', 'ftp') when 1 then concat('mailto:', url) else url end as url")
    return d.select("page_id", op.scheme(F.col("url")).alias("scheme"), op.allowed_scheme(F.col("url")).alias("allowed"))


def equation_invariants(spark, sf_dir):
    d = a.read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "case l_suppkey % 2 when 0 then 'latex' else 'image' end as content_kind", "case when l_partkey % 3 > 0 then 'x' end as latex",
        "l_partkey % 4 <> 0 as verified", "case when l_suppkey % 3 = 0 then 'a' end as asset_id", "l_discount * 15 as confidence",
    )
    return op.equation_rule(d).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))


EQUATIONS = """WITH d AS (SELECT CASE l_suppkey % 2 WHEN 0 THEN 'latex' ELSE 'image' END AS k, CASE WHEN l_partkey % 3 > 0 THEN 'x' END AS latex, l_partkey % 4 <> 0 AS v, CASE WHEN l_suppkey % 3 = 0 THEN 'a' END AS asset, l_discount * 15 AS c FROM lineitem),
r AS (SELECT CASE WHEN c IS NOT NULL AND (c < 0 OR c > 1) THEN 'confidence-range' WHEN k = 'latex' AND (latex IS NULL OR NOT v OR asset IS NOT NULL) THEN 'latex-content' WHEN k = 'image' AND (asset IS NULL OR v) THEN 'image-content' END AS rule FROM d)
SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY rule"""


def table_invariants(spark, sf_dir):
    d = a.read(spark, sf_dir, "part").selectExpr("p_partkey", "case p_size % 2 when 0 then 'grid' else 'image' end as content_kind", "case when p_size > 9 then 'r' end as rows", "case when p_size > 30 then 'a' end as asset_id")
    return op.table_rule(d).where("rule is not null").select("p_partkey", "rule")


def asset_base64(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("doc_id", "case doc_id % 3 when 0 then base64(encode(lang, 'UTF-8')) when 1 then concat(source, '=') else '' end as data")
    return d.select("doc_id", op.valid_base64(F.col("data")).alias("ok"))


def assets_over_budget(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars") * 0.75).alias("bytes"))
    return d.where("bytes > 80000").select("source", "bytes")


def iterate_blocks(spark, sf_dir):
    """Body in order, then footnotes: positions of a two-level tree by path."""
    d = a.headings(spark, sf_dir).selectExpr("doc", "n", "case when kind = 'para' then 1 else 0 end as part")
    return d.selectExpr("doc", "n", "cast(row_number() over (partition by doc order by part, n) as bigint) as place")


def plain_text(spark, sf_dir):
    """Ordered concatenation of a document's pieces."""
    d = a.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return d.select("conv_id", F.md5(F.concat_ws("", F.col("x.text"))).alias("md5"))


def doc_identity(spark, sf_dir):
    """The first 16 hex digits of a digest over a canonical JSON form."""
    d = a.read(spark, sf_dir, "nation")
    return d.selectExpr("n_nationkey", "substring(sha2(to_json(named_struct('key', n_nationkey, 'name', n_name)), 256), 1, 16) as doc_id")


def sentinel_leaks(spark, sf_dir):
    """Texts that still hold a private-use placeholder."""
    d = a.read(spark, sf_dir, "documents").selectExpr("doc_id", "case when doc_id % 11 = 0 then concat(text, '\\uE000') else text end as text")
    return d.where(F.col("text").rlike("[\ue000\ue001]")).select("doc_id")


REFS = "refs AS (SELECT l_orderkey AS owner, l_linenumber AS n, CASE WHEN l_quantity < 3 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS target FROM lineitem)"
ENTRIES = {
    "dangling_refs": Entry(dangling_refs, f"WITH {REFS} SELECT owner, n, target FROM refs WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM part WHERE p_size <= 25 AND CAST(p_partkey AS VARCHAR) = target)"),
    "unresolved_refs": Entry(unresolved_refs, f"WITH {REFS} SELECT owner, count(*) AS unresolved FROM refs WHERE target = '' GROUP BY owner"),
    "orphan_assets": Entry(orphan_assets, "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "duplicate_anchors": Entry(duplicate_anchors, "SELECT l_orderkey AS doc, l_partkey % 5 AS id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "label_targets": Entry(label_targets, "SELECT source AS doc, 'l' || doc_id AS label, doc_id AS target FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "empty_sections": Entry(empty_sections, "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"),
    "unnumbered_targets": Entry(unnumbered_targets, a.with_sql("headings", " SELECT h.doc, l_linenumber AS ref, h.n AS target FROM lineitem l JOIN headings h ON h.doc = l_orderkey AND h.n = CAST(l_quantity % 7 AS INT) WHERE kind = 'eq' AND NOT captioned")),
    "url_schemes": Entry(url_schemes, "SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('https', 'http', 'mailto') AS allowed FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN 'mailto:' || url ELSE url END AS u FROM pages)"),
    "equation_invariants": Entry(equation_invariants, EQUATIONS),
    "table_invariants": Entry(table_invariants, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'grid-content' ELSE 'image-content' END AS rule FROM part WHERE (p_size % 2 = 0 AND p_size <= 9) OR (p_size % 2 <> 0 AND p_size <= 30)"),
    "asset_base64": Entry(asset_base64, "SELECT doc_id, coalesce(length(x) > 0 AND length(x) % 4 = 0 AND regexp_full_match(x, '[A-Za-z0-9+/]+={0,2}'), false) AS ok FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN base64(encode(lang)) WHEN 1 THEN source || '=' ELSE '' END AS x FROM documents)"),
    "assets_over_budget": Entry(assets_over_budget, "SELECT source, sum(n_chars) * 0.75::DOUBLE AS bytes FROM documents GROUP BY source HAVING sum(n_chars) * 0.75 > 80000"),
    "iterate_blocks": Entry(iterate_blocks, a.with_sql("headings", " SELECT doc, n, row_number() OVER (PARTITION BY doc ORDER BY kind = 'para', n) AS place FROM headings")),
    "plain_text": Entry(plain_text, "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id"),
    "doc_identity": Entry(doc_identity, """SELECT n_nationkey, substr(sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}'), 1, 16) AS doc_id FROM nation"""),
    "sentinel_leaks": Entry(sentinel_leaks, "SELECT doc_id FROM documents WHERE doc_id % 11 = 0"),
}
