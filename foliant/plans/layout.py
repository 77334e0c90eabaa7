"""Queries on lines, blocks and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as op
from ..sources.adapters import doc_lines, read, with_sql
from .base import Entry

def running_lines(spark, sf_dir):
    """The texts' lines with their place, and on every page a head with its number and a foot that moves on every second page."""
    d = doc_lines(spark, sf_dir).selectExpr("doc", "page", "line", "700.0D - 14 * pos as bottom")
    pages = read(spark, sf_dir, "documents").selectExpr("source as doc", "doc_id as page")
    head = pages.selectExpr("doc", "page", "concat('  Journal of ', upper(doc), '\t', page) as line", "760.0D + page % 3 as bottom")
    foot = pages.selectExpr("doc", "page", "'draft' as line", "30.0D + page % 2 * 9 as bottom")
    return d.union(head).union(foot)


KEY_SQL = "trim(regexp_replace(regexp_replace(replace(lower(line), 'ß', 'ss'), '\\d+', '#', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"
RUNNERS = f""",
l AS (SELECT doc, page, line, 700.0 - 14 * pos AS y FROM doc_lines UNION ALL SELECT source, doc_id, '  Journal of ' || upper(source) || chr(9) || doc_id, 760.0 + doc_id % 3 FROM documents UNION ALL SELECT source, doc_id, 'draft', 30.0 + doc_id % 2 * 9 FROM documents),
k AS (SELECT doc, page, {KEY_SQL} AS key, CAST(round_even(y / 6, 0) AS BIGINT) AS band FROM l),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc HAVING count(DISTINCT page) >= 4),
r AS (SELECT k.doc, k.key, k.band, count(DISTINCT k.page) AS n_pages FROM k JOIN p ON k.doc = p.doc GROUP BY k.doc, k.key, k.band, p.pages
      HAVING count(DISTINCT k.page) >= 0.6 * p.pages)
"""


def runner_keys(spark, sf_dir):
    return op.repeated_keys(running_lines(spark, sf_dir))


def runner_strip(spark, sf_dir):
    lines = running_lines(spark, sf_dir)
    kept = op.strip_repeated(lines).groupBy("doc").agg(F.count("*").alias("kept"))
    return lines.groupBy("doc").agg(F.count("*").alias("lines")).join(kept, "doc", "left").select("doc", "lines", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def _boxes(spark, sf_dir):
    """Lines as boxes: the font follows the length, blank lines widen the gap."""
    d = doc_lines(spark, sf_dir).where("length(line) > 0")
    return d.selectExpr(
        "doc", "page", "0 as col", "pos as seq", "cast(0 - 14.0D * pos - (length(line) % 3) * 9 as double) as top",
        "cast(-14.0D * pos - (length(line) % 3) * 9 - 10 as double) as bottom", "10.0D as height", "cast(8 + length(line) % 5 as double) as font",
    )


def line_blocks(spark, sf_dir):
    d = op.blocks(_boxes(spark, sf_dir))
    return d.groupBy("doc", "page", "block").agg(F.count("*").alias("n_lines"), F.median("font").alias("font_median"), F.min("bottom").alias("b"), F.max("top").alias("t"))


LINE_BLOCKS = """,
x AS (SELECT doc, page, pos, 0 - 14.0 * pos - (length(line) % 3) * 9 AS top, -14.0 * pos - (length(line) % 3) * 9 - 10 AS bottom, 8 + length(line) % 5 AS font
      FROM doc_lines WHERE length(line) > 0),
g AS (SELECT *, lag(bottom) OVER w AS pb, lag(font) OVER w AS pf FROM x WINDOW w AS (PARTITION BY doc, page ORDER BY pos)),
b AS (SELECT *, sum(CASE WHEN pb IS NULL THEN 0 WHEN pb - top > 18.0 OR abs(font - pf) > 0.25 * greatest(font, pf) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY pos) AS block FROM g)
SELECT doc, page, CAST(block AS BIGINT) AS block, count(*) AS n_lines, CAST(median(font) AS DOUBLE) AS font_median, CAST(min(bottom) AS DOUBLE) AS b, CAST(max(top) AS DOUBLE) AS t
FROM b GROUP BY doc, page, block
"""


def space_gap_join(spark, sf_dir):
    """Words set apart by gaps wider than 0.35 of the font are joined with blanks."""
    d = doc_lines(spark, sf_dir).select("doc", "page", "pos", F.posexplode(F.split("line", " ")).alias("i", "w")).where("length(w) > 0")
    d = d.selectExpr("*", "coalesce(case when (length(w) + i) % 4 = 0 then 3.49D else 3.51D end, 0D) > 3.5D and lag(i) over (partition by page, pos order by i) is not null as spaced")
    made = d.groupBy("page", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "spaced", "w"))).alias("xs"))
    return made.selectExpr("page", "pos", "concat_ws('', transform(xs, x -> concat(case when x.spaced then ' ' else '' end, x.w))) as text")


SPACES = """,
x AS (SELECT page, pos, unnest(string_split(line, ' ')) AS w, unnest(range(len(string_split(line, ' ')))) AS i FROM doc_lines),
y AS (SELECT *, (length(w) + i) % 4 <> 0 AND lag(i) OVER (PARTITION BY page, pos ORDER BY i) IS NOT NULL AS spaced FROM x WHERE length(w) > 0)
SELECT page, CAST(pos AS INT) AS pos, string_agg(CASE WHEN spaced THEN ' ' ELSE '' END || w, '' ORDER BY i) AS text FROM y GROUP BY page, pos
"""


def _spans(spark, sf_dir):
    return doc_lines(spark, sf_dir).selectExpr("doc", "page", "cast(length(line) % 2 * 330 as int) as lo", "cast(length(line) % 2 * 330 + 20 + length(line) % 250 as int) as hi")


def column_histogram(spark, sf_dir):
    return op.valleys(op.occupancy(_spans(spark, sf_dir), 0, 612), 24)


COLUMNS = """,
x AS (SELECT doc, page, length(line) % 2 * 330 AS lo, length(line) % 2 * 330 + 20 + length(line) % 250 AS hi FROM doc_lines),
h AS (SELECT doc, page, bin, count(*) AS n FROM (SELECT doc, page, unnest(range(lo, hi)) AS bin FROM x) GROUP BY ALL),
t AS (SELECT doc, page, count(*) AS total FROM x GROUP BY ALL),
g AS (SELECT doc, page, total, unnest(range(0, 612)) AS bin FROM t),
z AS (SELECT g.doc, g.page, g.bin, g.bin - row_number() OVER (PARTITION BY g.doc, g.page ORDER BY g.bin) AS k
      FROM g LEFT JOIN h ON g.doc = h.doc AND g.page = h.page AND g.bin = h.bin WHERE coalesce(h.n, 0) <= greatest(1.0, 0.02 * total))
SELECT doc, page, CAST(min(bin) AS INT) AS first, CAST(max(bin) AS INT) AS last FROM z GROUP BY doc, page, k HAVING max(bin) - min(bin) + 1 >= 24
"""


def segment_batches(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("source as doc", "doc_id as page")
    return op.page_batches(d)


def segment_context(spark, sf_dir):
    """The last page before each batch but the first goes along as context."""
    d = segment_batches(spark, sf_dir)
    last = d.groupBy("doc", "batch").agg(F.max("page").alias("page"))
    return last.selectExpr("doc", "batch + 1 as batch", "concat('ctx-', page) as context").join(d.select("doc", "batch").distinct(), ["doc", "batch"], "left_semi")


BATCHES = "b AS (SELECT source AS doc, doc_id AS page, CAST((dense_rank() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS BIGINT) AS batch FROM documents)"


def segment_coverage(spark, sf_dir):
    """Documents against labels as a set of answers: missing, unknown and repeated ids."""
    want = read(spark, sf_dir, "documents").selectExpr("doc_id as id")
    got = read(spark, sf_dir, "labels").selectExpr("doc_id + 3 as id").union(read(spark, sf_dir, "labels").where("quality = 0").selectExpr("doc_id + 3 as id"))
    n = got.groupBy("id").agg(F.count("*").alias("n"))
    both = want.withColumn("known", F.lit(True)).join(n, "id", "full_outer")
    return both.selectExpr("id", "case when n is null then 'missing' when known is null then 'unknown' when n > 1 then 'duplicate' end as problem").where("problem is not null")


COVERAGE = """WITH g AS (SELECT doc_id + 3 AS id FROM labels UNION ALL SELECT doc_id + 3 FROM labels WHERE quality = 0),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id)
SELECT * FROM (SELECT coalesce(d.doc_id, n.id) AS id, CASE WHEN n.n IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'unknown' WHEN n.n > 1 THEN 'duplicate' END AS problem
FROM documents d FULL JOIN n ON d.doc_id = n.id) WHERE problem IS NOT NULL"""


def order_reconcile(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("source as doc", "doc_id as id", "doc_id as geometric")
    m = read(spark, sf_dir, "labels").selectExpr("doc_id as id", "-doc_id as proposed")
    return op.reconcile_order(d.join(m, "id", "left")).selectExpr("doc", "id", "cast(place as bigint) as place")


ORDER = """SELECT source AS doc, d.doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY l.doc_id IS NULL, -l.doc_id, d.doc_id) AS place
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def role_rules(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr(
        "source as doc", "doc_id as n", "doc_id % 7 as page", "case doc_id % 5 when 0 then 'title' when 1 then 'abstract' else 'paragraph' end as role"
    )
    return op.role_rules(d)


ROLES = """WITH d AS (SELECT source AS doc, doc_id AS n, doc_id % 7 AS page, CASE doc_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'abstract' ELSE 'paragraph' END AS role FROM documents)
SELECT *, CASE WHEN role = 'title' AND page > 2 THEN 'heading' WHEN role = 'abstract' AND row_number() OVER (PARTITION BY doc, role ORDER BY n) > 1 THEN 'paragraph' ELSE role END AS final_role FROM d"""


def paragraph_merge(spark, sf_dir):
    d = doc_lines(spark, sf_dir).where("length(line) > 0").selectExpr(
        "page as doc", "cast(pos as bigint) as n", "cast(pos div 6 as bigint) as page", "cast(-12.0D * pos - (length(line) % 4) * 7 as double) as top",
        "cast(-12.0D * pos - (length(line) % 4) * 7 - 10 as double) as bottom", "10.0D as height", "line as text",
    )
    out = op.merge_paragraphs(d).select("doc", F.inline("merged"))
    return out.selectExpr("doc", "first", "members", "sha2(text, 256) as text_sha256")


def chunk_text(spark, sf_dir):
    """Texts in chunks of 3,000 characters, in order."""
    d = read(spark, sf_dir, "documents")
    d = d.select("doc_id", "text", F.explode(F.expr("sequence(0, greatest(0, (length(text) - 1) div 3000))")).alias("chunk"))
    return d.selectExpr("doc_id", "cast(chunk as bigint) as chunk", "substring(text, cast(chunk * 3000 + 1 as int), 3000) as part").selectExpr("doc_id", "chunk", "cast(length(part) as bigint) as n", "md5(part) as md5")


CHUNKS = """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text) - 1) // 3000) + 1)) AS chunk FROM documents)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(length(substr(text, chunk * 3000 + 1, 3000)) AS BIGINT) AS n, md5(substr(text, chunk * 3000 + 1, 3000)) AS md5 FROM c"""


def serialize_blocks(spark, sf_dir):
    """Blocks as JSON lines, texts cut at 600 characters (a display limit of the format)."""
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", "case when length(text) > 600 then concat(substring(text, 1, 600), '…') else text end as t")
    return d.selectExpr("doc_id", "md5(to_json(named_struct('id', concat('b0-', doc_id), 'n', length(t)))) as json_md5", "md5(t) as text_md5")


SERIAL = """SELECT doc_id, md5('{"id":"b0-' || doc_id || '","n":' || length(t) || '}') AS json_md5, md5(t) AS text_md5
FROM (SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS t FROM documents)"""

ENTRIES = {
    "runner_keys": Entry(runner_keys, with_sql("doc_lines", RUNNERS + "SELECT doc, key, band, n_pages FROM r")),
    "runner_strip": Entry(runner_strip, with_sql("doc_lines", RUNNERS + "SELECT k.doc, count(*) AS lines, count(*) FILTER (WHERE r.key IS NULL) AS kept FROM k LEFT JOIN r ON k.doc = r.doc AND k.key = r.key AND k.band = r.band GROUP BY k.doc")),
    "line_blocks": Entry(line_blocks, with_sql("doc_lines", LINE_BLOCKS)),
    "space_gap_join": Entry(space_gap_join, with_sql("doc_lines", SPACES)),
    "column_valleys": Entry(column_histogram, with_sql("doc_lines", COLUMNS)),
    "segment_batches": Entry(segment_batches, f"WITH {BATCHES} SELECT * FROM b"),
    "segment_context": Entry(segment_context, f"WITH {BATCHES} SELECT x.doc, x.batch + 1 AS batch, 'ctx-' || x.page AS context FROM (SELECT doc, batch, max(page) AS page FROM b GROUP BY ALL) x WHERE EXISTS (SELECT 1 FROM b WHERE b.doc = x.doc AND b.batch = x.batch + 1)"),
    "segment_coverage": Entry(segment_coverage, COVERAGE),
    "order_reconcile": Entry(order_reconcile, ORDER),
    "role_rules": Entry(role_rules, ROLES),
    "paragraph_merge": Entry(paragraph_merge),
    "chunk_text": Entry(chunk_text, CHUNKS),
    "serialize_blocks": Entry(serialize_blocks, SERIAL),
}
