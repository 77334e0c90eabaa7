"""Queries on metadata, sources, availability, retries, prompts and page columns, over made inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acquisition as op
from ..operators import conversion, layout
from ..sources import adapters as a
from .base import Entry


def page_columns(spark, sf_dir):
    """Pages of 612 points: two columns, a gutter crossed by some lines, three columns, or one, by document."""
    d = a.doc_lines(spark, sf_dir).where("length(line) > 0").selectExpr("page as doc", "pos", "cast(length(line) as double) as n", "page % 4 as form")
    d = d.selectExpr(
        "doc", "0L as page", "612.0D as width", "cast(pos as bigint) as seq",
        "case when form = 0 then 50 + pos % 2 * 270 when form = 1 then 50 + pos % 2 * 270 when form = 2 then 40 + pos % 3 * 190 else 50 end + 0.0D as l",
        "case when form = 0 then 50 + pos % 2 * 270 + least(n, 230) when form = 1 then case when pos % 40 = 7 then 500 else 50 + pos % 2 * 270 + least(n, 230) end when form = 2 then 40 + pos % 3 * 190 + least(n, 150) else 50 + least(n * 4, 500) end + 0.0D as r",
    )
    return layout.columns(d).groupBy("doc", "col", "warning").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


COLUMNS = """, x AS (SELECT page AS doc, pos, page % 4 AS form, length(line) AS n FROM doc_lines WHERE length(line) > 0),
d AS (SELECT doc, pos AS seq, CASE WHEN form < 2 THEN 50 + pos % 2 * 270 WHEN form = 2 THEN 40 + pos % 3 * 190 ELSE 50 END AS l,
  CASE WHEN form = 1 AND pos % 40 = 7 THEN 500 WHEN form < 2 THEN 50 + pos % 2 * 270 + least(n, 230) WHEN form = 2 THEN 40 + pos % 3 * 190 + least(n, 150) ELSE 50 + least(n * 4, 500) END AS r FROM x),
t AS (SELECT doc, count(*) AS n FROM d GROUP BY doc),
b AS (SELECT t.doc, t.n, i, (SELECT count(*) FROM d WHERE d.doc = t.doc AND l // 8 <= i AND least(r // 8, 76) >= i) <= greatest(1, CAST(floor(t.n * 0.02) AS INT)) AS thin FROM t, range(0, 77) g(i) WHERE t.n >= 20),
g AS (SELECT doc, i, i - row_number() OVER (PARTITION BY doc ORDER BY i) AS k FROM b WHERE thin),
v AS (SELECT doc, min(i) AS f, max(i) AS z FROM g GROUP BY doc, k HAVING max(i) - min(i) >= 2 AND (min(i) + max(i) + 1) * 4 BETWEEN 612 * 0.3 AND 612 * 0.7),
m AS (SELECT doc, count(*) AS gaps, min((f + z + 1) * 4) AS valley FROM v GROUP BY doc),
s AS (SELECT d.doc, seq, gaps, CASE WHEN gaps = 1 AND r <= valley THEN 0 WHEN gaps = 1 AND l >= valley THEN 1 END AS side FROM d LEFT JOIN m ON d.doc = m.doc),
q AS (SELECT *, gaps = 1 AND count(side) OVER (PARTITION BY doc) >= 0.6 * count(*) OVER (PARTITION BY doc) AS two FROM s)
SELECT doc, CAST(CASE WHEN two THEN side ELSE 0 END AS INT) AS col, CASE WHEN gaps > 1 THEN 'layout-columns-unhandled' END AS warning, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs
FROM q WHERE two IS NOT TRUE OR side IS NOT NULL GROUP BY ALL"""


def atom_metadata(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr(
        "doc_id as id", "'2401.00001' as paper", "cast(case doc_id % 4 when 3 then doc_id % 5 + 1 end as int) as requested",
        """concat(case doc_id % 11 when 5 then '<!DOCTYPE x>' else '' end, '<feed xmlns="http://www.w3.org/2005/Atom">', case doc_id % 13 when 6 then '' else concat('<entry><id>http://arxiv.org/abs/2401.', doc_id, case doc_id % 3 when 0 then '' else concat('v', doc_id % 3) end,
        '</id><title> A  ', source, '\n paper </title><author><name>Ann ', lang, '</name></author><author><name> B  C </name></author><link href="http://x/', doc_id, '" rel="', case doc_id % 2 when 0 then 'alternate' else 'related' end, '"/><arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.1/', doc_id, '</arxiv:doi><category term="cs.', lang, '"/><summary>s</summary></entry>') end,
        '<entry><id>second</id></entry></feed>') as xml""",
    )
    d = d.withColumn("xml", F.expr("case when id % 13 = 6 then replace(xml, '<entry><id>second</id></entry>', '') else xml end"))
    return op.atom_metadata(d).selectExpr("id", "code", "paper", "latest", "resolved", "title", "array_join(authors, '; ') as authors", "url", "doi", "array_join(categories, ' ') as categories")


ATOM = """WITH d AS (SELECT doc_id AS id, source, lang, CASE WHEN doc_id % 4 = 3 THEN doc_id % 5 + 1 END AS requested, CASE doc_id % 3 WHEN 0 THEN 1 ELSE doc_id % 3 END AS latest FROM documents),
c AS (SELECT *, CASE WHEN id % 11 = 5 THEN 'xml-dtd' WHEN id % 13 = 6 THEN 'arxiv-id-not-found' WHEN requested > latest THEN 'arxiv-version-not-found' END AS code FROM d)
SELECT id, code, CASE WHEN code IS NULL THEN '2401.' || id END AS paper, CASE WHEN code IS NULL THEN CAST(latest AS INT) END AS latest, CASE WHEN code IS NULL THEN CAST(coalesce(requested, latest) AS INT) END AS resolved,
  CASE WHEN code IS NULL THEN 'A ' || source || ' paper' END AS title, CASE WHEN code IS NULL THEN 'Ann ' || lang || '; B C' END AS authors,
  CASE WHEN code IS NULL THEN CASE WHEN id % 2 = 0 THEN 'http://x/' || id ELSE 'https://arxiv.org/abs/2401.' || id || 'v' || latest END END AS url, CASE WHEN code IS NULL THEN '10.1/' || id END AS doi, CASE WHEN code IS NULL THEN 'cs.' || lang END AS categories FROM c"""


def eprint_source(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("source as id", "cast(doc_id % 50 as int) as version", "case doc_id % 7 when 0 then 'source.tar.gz' when 1 then 'source.tex' when 2 then 'source.pdf' else 'meta.xml' end as kind")
    return op.best_source(d)


EPRINT = """SELECT id, version, CASE min(r) WHEN 0 THEN 'source.tar.gz' WHEN 1 THEN 'source.tex' ELSE 'source.pdf' END AS kind FROM (SELECT source AS id, CAST(doc_id % 50 AS INT) AS version, doc_id % 7 AS r FROM documents) WHERE r < 3 GROUP BY id, version"""


def page_images(spark, sf_dir):
    """A page's html, then images: relative, of another host, without a source, and many."""
    d = a.read(spark, sf_dir, "pages").selectExpr("page_id as id", """concat(regexp_replace(html, '(?i)<img', '<i'), '<img src="a/', page_id, '.png"><IMG alt="x" src=', "'//h/y.png'", '><img alt="none"><img src="https://h/z.png">', repeat('<img src="b.png">', cast(page_id % 250 as int))) as html""")
    return op.page_images(d).groupBy("id", "skipped").agg(F.count("*").alias("n"), F.min("src").alias("least"), F.min("name").alias("name"))


IMAGES = """WITH p AS (SELECT page_id AS id, page_id % 250 AS k FROM pages),
i AS (SELECT id, 'a/' || id || '.png' AS src, false AS skipped FROM p UNION ALL SELECT id, unnest(['//h/y.png', '', 'https://h/z.png']), true FROM p UNION ALL SELECT id, 'b.png', n >= 196 FROM (SELECT id, unnest(range(k)) AS n FROM p))
SELECT id, skipped, count(*) AS n, min(src) AS least, min(CASE WHEN NOT skipped THEN sha1(src) END) AS name FROM i GROUP BY id, skipped"""


def decoded_texts(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("doc_id", "case when doc_id % 3 = 0 then concat(encode(text, 'UTF-8'), unhex('E9')) else encode(text, 'UTF-8') end as data")
    return d.select("doc_id", op.decoded(F.col("data")).alias("x")).selectExpr("doc_id", "x.fallback", "cast(length(x.text) as bigint) as chars", "right(x.text, 1) as last")


DECODED = "SELECT doc_id, doc_id % 3 = 0 AS fallback, CASE WHEN doc_id % 3 = 0 THEN octet_length(encode(text)) + 1 ELSE length(text) END AS chars, CASE WHEN doc_id % 3 = 0 THEN 'é' ELSE right(text, 1) END AS last FROM documents"


def main_file(spark, sf_dir):
    """Projects of nine files: one with a document class, one known by name, or a chain of includes."""
    d = a.read(spark, sf_dir, "part").selectExpr("p_partkey div 9 as project", "p_partkey % 9 as k", "p_size as bytes")
    files = d.selectExpr(
        "project", "case when project % 3 = 1 and k = 4 then 'sub/Paper.tex' when project % 3 = 1 and k = 7 then 'arxiv.tex' else concat('f', k, '.tex') end as path",
        r"case when project % 3 = 0 and k = 5 then '\\documentclass [a]{b}' else concat('\\input{f', k, '}') end as text", "bytes",
    )
    includes = d.where("project % 3 = 2 and k > 0 and k < 6").selectExpr("project", "concat('f', k, '.tex') as path", "concat('f', k + 1, '.tex') as target")
    return op.main_files(files, includes)


MAIN = """WITH d AS (SELECT p_partkey // 9 AS project, p_partkey % 9 AS k, p_size AS bytes FROM part),
w AS (SELECT *, CASE WHEN project % 3 = 2 AND k BETWEEN 1 AND 5 THEN (SELECT count(*) FROM d x WHERE x.project = d.project AND x.k BETWEEN d.k AND 6) ELSE 1 END AS reached,
  CASE WHEN project % 3 = 1 AND k = 4 THEN 'sub/Paper.tex' WHEN project % 3 = 1 AND k = 7 THEN 'arxiv.tex' ELSE 'f' || k || '.tex' END AS path FROM d),
h AS (SELECT *, CASE WHEN project % 3 = 0 AND count(*) FILTER (WHERE k = 5) OVER p = 1 THEN 'class' WHEN project % 3 = 1 AND count(*) FILTER (WHERE k IN (4, 7)) OVER p > 0 THEN 'name' ELSE 'reach' END AS how FROM w WINDOW p AS (PARTITION BY project)),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE how WHEN 'class' THEN CASE WHEN k = 5 THEN 0 ELSE 1 END WHEN 'name' THEN CASE k WHEN 4 THEN 0 WHEN 7 THEN 1 ELSE 2 END ELSE 0 END, CASE WHEN how = 'reach' THEN -reached END, CASE WHEN how = 'reach' THEN -bytes END, path) AS i,
  count(*) OVER (PARTITION BY project, reached, bytes) AS same FROM h)
SELECT project, path, how, how = 'reach' AND same > 1 AS ambiguous FROM r WHERE i = 1"""


def display_envs(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("doc_id as id", r"concat(replace(text, '$', ' '), '\\begin{align*}x\\end{align*} \\[ y \\] ', repeat('$$z$$ ', cast(doc_id % 3 as int)), '\\begin{equation}\\begin{array}\\begin{gather}') as text")
    return op.display_environments(d)


ENVS = """WITH e AS (SELECT doc_id AS id, ['align*', 'display'] || list_transform(range(2 * (doc_id % 3)), lambda i: 'display') || ['equation', 'gather'] AS v FROM documents)
SELECT id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS place, unnest(v) AS environment FROM e"""


def bib_source(spark, sf_dir):
    d = a.read(spark, sf_dir, "lineitem").selectExpr("l_suppkey as project", "case l_linenumber % 7 when 1 then 'bib' when 2 then 'thebibliography' else 'bbl' end as source", "l_orderkey * 10 + l_linenumber as place", "concat('k', l_partkey) as key")
    d = d.where("source <> 'bbl' or project % 3 = 0").where("source <> 'thebibliography' or project % 3 <> 2").groupBy("project", "source", "place").agg(F.min("key").alias("key"))
    return op.bibliography_source(d)


BIB = """WITH d AS (SELECT l_suppkey AS project, CASE l_linenumber % 7 WHEN 1 THEN 'bib' WHEN 2 THEN 'thebibliography' ELSE 'bbl' END AS source, l_orderkey * 10 + l_linenumber AS place, min('k' || l_partkey) AS key FROM lineitem GROUP BY ALL),
e AS (SELECT *, CASE source WHEN 'bbl' THEN 1 WHEN 'thebibliography' THEN 2 ELSE 3 END AS r FROM d WHERE (source <> 'bbl' OR project % 3 = 0) AND (source <> 'thebibliography' OR project % 3 <> 2)),
f AS (SELECT * FROM e QUALIFY r = min(r) OVER (PARTITION BY project))
SELECT project, source, place, key, count(*) OVER (PARTITION BY project) > 2000 AS capped FROM f QUALIFY row_number() OVER (PARTITION BY project ORDER BY place) <= 2000"""


def engine_available(spark, sf_dir):
    d = a.read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as request", "element_at(array('arxiv', 'latex-local', 'pdf-local'), cast(o_orderkey % 3 + 1 as int)) as kind", "case when o_orderkey % 3 = 0 and o_custkey % 5 > 0 then concat('p', o_custkey % 20) end as paper",
        "cast(case when o_custkey % 2 = 0 then o_custkey % 4 end as int) as version", "o_custkey % 3 = 0 as offline", "cast(case o_custkey % 4 when 0 then null when 1 then 2 else 3 end as int) as converter", "o_custkey % 7 > 0 as has_path", "o_custkey % 6 > 0 as keyed", "case when o_custkey % 12 = 0 then 'LocalHost' else 'api.example.org' end as host",
    )
    pages = a.read(spark, sf_dir, "nation").selectExpr("concat('p', n_nationkey) as paper", "cast(n_nationkey % 4 as int) as version").where("version < 3")
    return op.availability(d, pages)


AVAILABLE = """WITH d AS (SELECT o_orderkey AS request, o_orderkey % 3 AS k, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 5 > 0 THEN o_custkey % 20 END AS paper, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 4 END AS version, o_custkey AS c FROM orders),
h AS (SELECT *, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = paper AND n_nationkey % 4 < 3 AND (version IS NULL OR version = n_nationkey % 4)) AS here FROM d),
r AS (SELECT request, 'arxiv-html' AS engine, CASE WHEN k > 0 OR paper IS NULL THEN 'html-unavailable' WHEN c % 3 = 0 AND NOT here THEN 'offline-uncached' END AS reason FROM h
UNION ALL SELECT request, 'latex', CASE WHEN c % 4 < 2 THEN 'pandoc-missing' WHEN k = 2 OR k = 1 AND c % 7 = 0 THEN 'eprint-is-pdf-only' END FROM h
UNION ALL SELECT request, 'pdf', CASE WHEN k = 2 AND c % 7 = 0 THEN 'pdf-artifact-missing' WHEN k = 0 AND paper IS NULL THEN 'arxiv-id-missing' WHEN k = 1 THEN 'pdf-input-kind' WHEN c % 3 = 0 THEN 'offline-uncached' WHEN c % 6 = 0 AND c % 12 > 0 THEN 'llm-not-configured' END FROM h)
SELECT request, engine, reason IS NULL AS available, reason FROM r"""


def retry_schedule(spark, sf_dir):
    d = a.read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as request", "cast(l_linenumber % 3 as int) as attempt", "cast(element_at(array(200, 429, 503, null, 400, 404), cast(l_partkey % 6 + 1 as int)) as int) as status", "cast(case when l_suppkey % 4 = 0 then l_suppkey % 12 end as double) as retry_after", "l_discount as jitter"
    )
    return op.retries(d).groupBy("attempt", "status", "outcome").agg(F.count("*").alias("n"), F.round(F.sum("wait"), 6).alias("waited"))


RETRY = """WITH d AS (SELECT l_linenumber % 3 AS t, CASE l_partkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 4 THEN 400 WHEN 5 THEN 404 END AS s, CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey % 12 ELSE 0 END AS ra, l_discount AS j FROM lineitem),
e AS (SELECT *, s IS NULL OR s IN (429, 503) AS again FROM d)
SELECT CAST(t AS INT) AS attempt, CAST(s AS INT) AS status, CASE WHEN again AND t < 2 THEN 'retry' WHEN again OR s = 404 THEN 'llm-transport' ELSE 'answer' END AS outcome, count(*) AS n,
  round(sum(CASE WHEN again AND t < 2 THEN greatest(CASE WHEN s IS NULL THEN 0 ELSE ra END, (t + 1) * (t + 1) + j) END), 6) AS waited FROM e GROUP BY ALL"""


def call_price(spark, sf_dir):
    d = a.read(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_size % 5 > 0 then p_size / 10.0D end as i", "case when p_size % 5 > 0 then p_size / 2.0D end as o", "case when p_partkey % 2 = 0 then 'equation' else 'segment' end as purpose")
    return d.select("p_partkey", F.round(op.call_price(F.col("i"), F.col("o"), F.col("purpose")), 9).alias("usd"))


PRICE = "SELECT p_partkey, round((1300 * CASE WHEN p_size % 5 > 0 THEN p_size / 10 ELSE 10.0 END + CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 4096 END * CASE WHEN p_size % 5 > 0 THEN p_size / 2 ELSE 30.0 END) / 1e6, 9) AS usd FROM part"


def prompt_slots(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("doc_id", "'Read {text} and {map}. Then {text}.' as template", "case doc_id % 3 when 0 then map('text', text, 'map', '{text}') when 1 then map('text', text) else map('text', text, 'map', 'm', 'zed', 'z') end as slots")
    return op.prompt_slots(d).selectExpr("doc_id", "problem", "md5(prompt) as prompt_md5")


SLOTS = "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'missing prompt slot: map' WHEN 2 THEN 'unknown prompt slot: zed' END AS problem, CASE WHEN doc_id % 3 = 0 THEN md5('Read ' || text || ' and {text}. Then ' || text || '.') END AS prompt_md5 FROM documents"


def html_first_ids(spark, sf_dir):
    d = a.headings(spark, sf_dir).selectExpr("doc", "n", "case when level < 3 then concat('S', n % 3) else '' end as html_id", "concat('sec-', n) as anchor")
    return op.first_ids(d)


FIRST = """ SELECT doc, n, 'S' || n % 3 AS html_id, 'sec-' || n AS anchor, EXISTS (SELECT 1 FROM headings p WHERE p.doc = h.doc AND p.n < h.n AND p.n % 3 = h.n % 3 AND p.level < 3) AS duplicate FROM headings h WHERE level < 3"""


def target_kinds(spark, sf_dir):
    names = "array('ltx_equationgroup', 'ltx_figure', 'ltx_tabular', 'ltx_note', 'ltx_bibitem', 'ltx_subsection', 'ltx_table', 'x')"
    d = a.read(spark, sf_dir, "part").selectExpr("p_partkey", f"array('a', element_at({names}, cast(p_partkey % 8 + 1 as int)), element_at({names}, cast(p_partkey div 8 % 8 + 1 as int))) as classes")
    return d.select("p_partkey", op.target_kind(F.col("classes")).alias("kind"), op.section_level(F.col("classes")).alias("level"))


KINDS = """WITH d AS (SELECT p_partkey, [p_partkey % 8, p_partkey // 8 % 8] AS c FROM part)
SELECT p_partkey, CASE WHEN list_contains(c, 0) THEN 'eq' WHEN list_contains(c, 1) THEN 'fig' WHEN list_contains(c, 2) OR list_contains(c, 6) THEN 'tab' WHEN list_contains(c, 3) THEN 'fn' WHEN list_contains(c, 4) THEN 'bib' ELSE 'sec' END AS kind, CASE WHEN list_contains(c, 5) THEN 2 ELSE 1 END AS level FROM d"""


def author_year(spark, sf_dir):
    """Markers that several texts share: each is linked where it comes first."""
    d = a.read(spark, sf_dir, "documents").selectExpr("doc_id as id", "concat(translate(text, '()', '  '), ' (Smith, ', 1900 + doc_id % 90, 'a; Jones) and (see 2001)') as text")
    mappings = a.read(spark, sf_dir, "part").where("p_partkey < 100").selectExpr("p_partkey as n", "concat('(Smith, ', 1900 + p_partkey, 'a; Jones)') as marker", "array(cast(p_partkey % 7 as int), 900, 2) as entries")
    bib = a.read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as int) as place", "concat('bib-', n_nationkey + 1) as bib_id")
    return op.author_year_links(d, mappings, bib).selectExpr("n", "id", "end - start as chars", "array_join(bib_ids, ' ') as bib_ids")


AUTHOR = """WITH f AS (SELECT doc_id % 90 AS k, min(doc_id) AS id FROM documents GROUP BY 1)
SELECT p_partkey AS n, id, CAST(21 AS INT) AS chars, 'bib-' || (p_partkey % 7 + 1) || ' bib-3' AS bib_ids FROM part JOIN f ON k = p_partkey WHERE p_partkey < 100"""


def preflight_features(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("source as doc", r"concat(text, case doc_id % 5 when 0 then ' ∑' when 1 then ' \\frac' when 2 then ' \\fra' else '' end) as text")
    return op.preflight(d)


PREFLIGHT = """SELECT source AS doc, CAST(sum(length(text) + CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 0 END) AS BIGINT) AS chars, count(*) FILTER (WHERE doc_id % 5 < 2 OR regexp_matches(text, '[=∫∑]|\\\\(frac|begin|sum)')) AS equations FROM documents GROUP BY 1"""


def forced_plan(spark, sf_dir):
    d = a.read(spark, sf_dir, "orders").selectExpr("o_orderkey as request", "element_at(array('arxiv', 'latex-local', 'pdf-local'), cast(o_orderkey % 3 + 1 as int)) as kind", "element_at(array('auto', 'latex', 'pdf', 'word'), cast(o_custkey % 4 + 1 as int)) as engine")
    return d.select("request", F.array_join(conversion.plan(F.col("kind"), F.col("engine")), ' ').alias("engines"))


FORCED = """SELECT o_orderkey AS request, CASE o_custkey % 4 WHEN 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'arxiv-html latex pdf' WHEN 1 THEN 'latex' ELSE 'pdf' END WHEN 1 THEN CASE WHEN o_orderkey % 3 < 2 THEN 'latex' END WHEN 2 THEN CASE WHEN o_orderkey % 3 <> 1 THEN 'pdf' END END AS engines FROM orders"""

ENTRIES = {
    "page_columns": Entry(page_columns, a.with_sql("doc_lines", COLUMNS)),
    "atom_metadata": Entry(atom_metadata, ATOM),
    "eprint_source": Entry(eprint_source, EPRINT),
    "page_images": Entry(page_images, IMAGES),
    "decoded_texts": Entry(decoded_texts, DECODED),
    "main_file": Entry(main_file, MAIN),
    "display_envs": Entry(display_envs, ENVS),
    "bib_source": Entry(bib_source, BIB),
    "engine_available": Entry(engine_available, AVAILABLE),
    "retry_schedule": Entry(retry_schedule, RETRY),
    "call_price": Entry(call_price, PRICE),
    "prompt_slots": Entry(prompt_slots, SLOTS),
    "html_first_ids": Entry(html_first_ids, a.with_sql("headings", FIRST)),
    "target_kinds": Entry(target_kinds, KINDS),
    "author_year": Entry(author_year, AUTHOR),
    "preflight_features": Entry(preflight_features, PREFLIGHT),
    "forced_plan": Entry(forced_plan, FORCED),
}
