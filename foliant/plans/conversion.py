"""Queries on inputs, plans, gates and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversion as op
from ..sources import adapters as a
from .base import Entry


def _raw(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "case doc_id % 16 when 0 then concat('2401.', lpad(doc_id, 5, '0')) when 1 then concat('arXiv:2401.', lpad(doc_id, 5, '0'), 'v', doc_id % 3) "
        "when 2 then concat('HTTPS://arxiv.org/abs/2401.', lpad(doc_id, 5, '0')) when 3 then concat('https://www.arxiv.org:443/pdf/2401.', lpad(doc_id, 5, '0'), 'v2.PDF?x=1') "
        "when 4 then concat('hep-th/', lpad(doc_id, 7, '0')) when 5 then concat('dir/my  paper ', doc_id, '.tar.gz') when 6 then concat('p', doc_id, '.PDF') when 7 then concat('https://example.org/', doc_id, '.pdf') "
        "when 8 then concat('https://arxiv.org/abs/2401.', lpad(doc_id, 5, '0'), '/') when 9 then concat('https://arxiv.org/abs/hep-th%2F', lpad(doc_id, 7, '0')) when 10 then concat('a.b', doc_id, '.tex') "
        "when 11 then concat('https://arxiv.org/html/2401.', lpad(doc_id, 5, '0'), '.pdf') when 12 then concat('-th/', lpad(doc_id, 7, '0')) when 13 then concat('x_', doc_id, 'é.TGZ') when 14 then concat('note', doc_id, '.txt') else concat('ftp://arxiv.org/abs/2401.', lpad(doc_id, 5, '0')) end as raw",
    )


RAW = """r AS (SELECT doc_id, doc_id % 16 AS k, lpad(CAST(doc_id AS VARCHAR), 5, '0') AS n5, lpad(CAST(doc_id AS VARCHAR), 7, '0') AS n7 FROM documents),
s AS (SELECT doc_id, CASE WHEN k IN (0, 1, 2, 3, 4, 9) THEN 'arxiv' WHEN k IN (5, 10, 13) THEN 'latex-local' WHEN k = 6 THEN 'pdf-local' END AS kind, CASE WHEN k < 4 THEN '2401.' || n5 WHEN k IN (4, 9) THEN 'hep-th/' || n7 END AS paper,
CAST(CASE k WHEN 1 THEN doc_id % 3 WHEN 3 THEN 2 END AS INT) AS version, k FROM r)"""


def resolve_input(spark, sf_dir):
    return _raw(spark, sf_dir).select("doc_id", op.resolve(F.col("raw")).alias("x")).select("doc_id", "x.kind", "x.paper", "x.version")


def output_slug(spark, sf_dir):
    d = _raw(spark, sf_dir).select("doc_id", "raw", op.resolve(F.col("raw")).alias("x"))
    return d.select("doc_id", op.slug(F.col("x.kind"), F.col("x.paper"), F.col("x.version"), F.col("raw")).alias("slug"))


def engine_plan(spark, sf_dir):
    d = _raw(spark, sf_dir).select("doc_id", op.resolve(F.col("raw")).alias("x"))
    return d.select("doc_id", F.posexplode(op.plan(F.col("x.kind"))).alias("ord", "engine"))


def engine_select(spark, sf_dir):
    return op.first_success(a.attempts(spark, sf_dir)).selectExpr("doc", "winner", "stopped", "cast(size(notes) as bigint) as notes")


def fallback_notes(spark, sf_dir):
    d = op.first_success(a.attempts(spark, sf_dir)).where("winner is not null").select("doc", F.posexplode("notes").alias("seq", "note"))
    # every third page's errors are fetch errors, the next ones are the model's
    error = F.expr("element_at(array('conversion', 'fetch', 'llm'), cast(doc % 3 + 1 as int))")
    return d.select("doc", "seq", F.col("note.engine").alias("engine"), op.reason(F.col("note.reason"), F.col("note.engine"), error).alias("reason"))


AT = "f AS (SELECT *, min(CASE WHEN ok OR code IN ('security', 'cost-limit') THEN ord END) OVER (PARTITION BY doc) AS hit FROM attempts)"


def exit_codes(spark, sf_dir):
    codes = spark.createDataFrame(list(op.EXIT.items()), "kind string, code int")
    d = a.attempts(spark, sf_dir).where("not ok").selectExpr("doc", "ord", "case code when 'security' then 'security' when 'odd-code' then 'other' else 'conversion' end as kind")
    return d.join(codes, "kind", "left").selectExpr("doc", "ord", "coalesce(code, 1) as exit_code")


def quality_gate(spark, sf_dir):
    p = a.read(spark, sf_dir, "pages").selectExpr("page_id", "html")
    return op.quality_gate(p, content="ad", errors="missing").selectExpr("page_id", "ok", "reason", "markers", "text_kb")


GATE = r"""WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gsi'), '<[^>]*>', ' ', 'gs'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS shown,
len(regexp_extract_all(html, '<title\b[^>]*>[^<]*[^<\s][^<]*</title', 0, 'i')) AS titles, len(regexp_extract_all(html, 'class="[^"]*missing')) AS marked FROM pages),
q AS (SELECT *, CAST(length(shown) // 1024 AS BIGINT) AS text_kb, CASE WHEN lower(shown) LIKE '%html is not available for this paper%' OR lower(shown) LIKE '%conversion is pending%' OR lower(shown) LIKE '%conversion pending%' THEN 'html-stub'
WHEN NOT regexp_matches(html, 'class="([^"]*\s)?ad(\s[^"]*)?"') THEN 'html-no-content' WHEN titles = 0 THEN 'html-missing-title' END AS early FROM p),
m AS (SELECT *, CAST(CASE WHEN early IS NULL THEN marked ELSE 0 END AS BIGINT) AS markers FROM q)
SELECT page_id, reason IS NULL AS ok, reason, markers, text_kb FROM (SELECT *, coalesce(early, CASE WHEN markers > greatest(20, text_kb / 2) THEN 'html-low-quality' END) AS reason FROM m)"""


def _files(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").selectExpr("source as id", "cast(doc_id % 4 as int) as version", "case doc_id % 5 when 0 then 'source.tar.gz' when 1 then 'paper.pdf' when 2 then 'page.html' when 3 then 'x.tmp' else 'meta.xml' end as kind", "n_chars as bytes")


FILES = "x AS (SELECT source AS id, CAST(doc_id % 4 AS INT) AS version, CASE doc_id % 5 WHEN 0 THEN 'source.tar.gz' WHEN 1 THEN 'paper.pdf' WHEN 2 THEN 'page.html' WHEN 3 THEN 'x.tmp' ELSE 'meta.xml' END AS kind, n_chars AS bytes FROM documents)"


def cache_inventory(spark, sf_dir):
    return op.inventory(_files(spark, sf_dir)).selectExpr("id", "version", "array_join(kinds, ' ') as kinds", "bytes")


def cache_latest(spark, sf_dir):
    """Newest cached version that has a page, and its best source by priority."""
    d = _files(spark, sf_dir)
    page = d.where("kind = 'page.html'").groupBy("id").agg(F.max("version").alias("page_version"))
    best = d.where("kind in ('source.tar.gz', 'paper.pdf')").groupBy("id").agg(F.min(F.expr("struct(case kind when 'source.tar.gz' then 0 else 1 end as p, -version as v, kind)")).alias("b"))
    return page.join(best, "id", "full_outer").selectExpr("id", "page_version", "b.kind as source_kind", "-b.v as source_version")


def cache_listing(spark, sf_dir):
    """Fixed-width listing: MiB from 1048576 bytes on, else KiB."""
    d = op.inventory(_files(spark, sf_dir))
    shown = F.when(F.col("bytes") >= 1048576, F.format_string("%.1f MiB", F.col("bytes") / 1048576)).otherwise(F.format_string("%.1f KiB", F.col("bytes") / 1024))
    return d.select(F.concat(F.rpad("id", 16, " "), F.format_string("v%d", "version"), F.lit(" "), F.lpad(shown, 12, " ")).alias("line"))


def cache_promote(spark, sf_dir):
    d = _files(spark, sf_dir).dropDuplicates(["id", "version", "kind"])
    new = d.where("version = 0").selectExpr("id", "kind").distinct()
    old = d.where("version = 3").selectExpr("id", "kind").distinct()
    return op.promote(old.withColumn("origin", F.lit("kept")), new.withColumn("origin", F.lit("moved")), ["id", "kind"])


def cache_clear(spark, sf_dir):
    return _files(spark, sf_dir).where("id <> 'src3'").groupBy("id").agg(F.count("*").alias("left"))


def config_layers(spark, sf_dir):
    """Settings by key: defaults, file, environment, command line; the last that says something wins."""
    d = a.read(spark, sf_dir, "nation")
    layers = [d.selectExpr("n_name as key", f"{k} as layer", f"case when n_nationkey % {m} = 0 then concat('{n}', n_regionkey) end as value") for k, (n, m) in enumerate((("default", 1), ("file", 2), ("env", 3), ("cli", 5)))]
    return op.layered(layers[0].union(layers[1]).union(layers[2]).union(layers[3]))


def image_kinds(spark, sf_dir):
    """Types by magic bytes, and PNG sizes, of made payloads."""
    d = a.read(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "case p_partkey % 4 when 0 then unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(p_size), 8, '0'), lpad(hex(p_size * 2), 8, '0'))) "
        "when 1 then unhex('FFD8FFE000') when 2 then encode(concat(case p_size % 3 when 0 then '<?xml version=\"1.0\"?> ' when 1 then '<!-- c -->' else '' end, '<svg a=\"1\"/>'), 'UTF-8') else encode(concat('GIF8', p_size % 10, 'a'), 'UTF-8') end as data",
    )
    d = d.select("p_partkey", op.image_type(F.col("data")).alias("kind"), op.png_size(F.col("data")).alias("s"))
    return d.select("p_partkey", "kind", "s.width", "s.height")


def tag_numbers(spark, sf_dir):
    """Numbers of captions without brackets, words and colons."""
    d = a.read(spark, sf_dir, "part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then concat('(', p_size, ')') when 1 then concat('Figure ', p_size, ':') else concat('[', p_size, ']') end as tag")
    return d.selectExpr("p_partkey", "regexp_replace(trim(both '()[]' from tag), '^(Figure|Table) |:$', '') as number")


def svg_scripts(spark, sf_dir):
    """Pages without script elements; the id of the stored form is its digest, so equal forms are one asset."""
    d = a.read(spark, sf_dir, "pages").select(F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>", "").alias("kept"), "html")
    return d.select(F.sha1("kept").alias("id"), (F.col("kept") != F.col("html")).alias("cut")).groupBy("id").agg(F.bool_or("cut").alias("cut"))


ENTRIES = {
    "resolve_input": Entry(resolve_input, f"WITH {RAW} SELECT doc_id, kind, paper, version FROM s"),
    "output_slug": Entry(output_slug, f"WITH {RAW} SELECT doc_id, CASE WHEN kind = 'arxiv' THEN 'arxiv-' || replace(paper, '/', '-') || coalesce('v' || version, '') WHEN k = 5 THEN 'my--paper-' || doc_id WHEN k = 6 THEN 'p' || doc_id WHEN k = 10 THEN 'a.b' || doc_id WHEN k = 13 THEN 'x_' || doc_id || '-' END AS slug FROM s"),
    "engine_plan": Entry(engine_plan, f"WITH {RAW} SELECT doc_id, CAST(o AS INT) AS ord, e AS engine FROM s JOIN (VALUES ('arxiv', 0, 'arxiv-html'), ('arxiv', 1, 'latex'), ('arxiv', 2, 'pdf'), ('latex-local', 0, 'latex'), ('pdf-local', 0, 'pdf')) p(kind2, o, e) ON kind = kind2"),
    "engine_select": Entry(engine_select, a.with_sql("attempts", f", {AT} SELECT doc, max(CASE WHEN ord = hit AND ok THEN engine END) AS winner, bool_or(ord = hit AND NOT ok) IS TRUE AS stopped, count(*) FILTER (WHERE NOT ok AND (hit IS NULL OR ord < hit)) AS notes FROM f GROUP BY doc")),
    "fallback_notes": Entry(fallback_notes, a.with_sql("attempts", f", {AT}, w AS (SELECT doc FROM f WHERE ord = hit AND ok) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS INT) AS seq, engine, CASE WHEN doc % 3 = 1 AND engine = 'arxiv-html' THEN 'html-unavailable' WHEN doc % 3 = 2 AND engine = 'pdf' THEN 'llm-not-configured' WHEN doc % 3 = 0 AND code = 'html-stub' THEN code ELSE 'convert-failed:' || code END AS reason FROM f WHERE doc IN (SELECT doc FROM w) AND NOT ok AND ord < hit")),
    "exit_codes": Entry(exit_codes, a.with_sql("attempts", " SELECT doc, ord, CASE code WHEN 'security' THEN 9 WHEN 'odd-code' THEN 1 ELSE 5 END AS exit_code FROM attempts WHERE NOT ok")),
    "quality_gate": Entry(quality_gate, GATE),
    "cache_inventory": Entry(cache_inventory, f"WITH {FILES} SELECT id, version, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds, CAST(sum(bytes) AS BIGINT) AS bytes FROM x WHERE kind NOT LIKE '%.tmp' GROUP BY id, version"),
    "cache_latest": Entry(cache_latest, f"WITH {FILES}, b AS (SELECT id, kind, version, row_number() OVER (PARTITION BY id ORDER BY kind DESC, version DESC) AS k FROM x WHERE kind IN ('source.tar.gz', 'paper.pdf')), p AS (SELECT id, max(version) AS v FROM x WHERE kind = 'page.html' GROUP BY id) SELECT coalesce(p.id, b.id) AS id, v AS page_version, kind AS source_kind, version AS source_version FROM p FULL JOIN (SELECT * FROM b WHERE k = 1) b ON p.id = b.id"),
    "cache_listing": Entry(cache_listing, f"WITH {FILES}, g AS (SELECT id, version, sum(bytes) AS s FROM x WHERE kind NOT LIKE '%.tmp' GROUP BY id, version) SELECT rpad(id, 16, ' ') || 'v' || version || ' ' || lpad(CASE WHEN s >= 1048576 THEN printf('%.1f MiB', s / 1048576) ELSE printf('%.1f KiB', s / 1024) END, 12, ' ') AS line FROM g"),
    "cache_promote": Entry(cache_promote, f"WITH {FILES}, o AS (SELECT DISTINCT id, kind FROM x WHERE version = 3) SELECT id, kind, 'kept' AS origin FROM o UNION ALL (SELECT id, kind, 'moved' FROM (SELECT DISTINCT id, kind FROM x WHERE version = 0 EXCEPT SELECT id, kind FROM o))"),
    "cache_clear": Entry(cache_clear, "SELECT source AS id, count(*) AS left FROM documents WHERE source <> 'src3' GROUP BY source"),
    "config_layers": Entry(config_layers, "SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'cli' WHEN n_nationkey % 3 = 0 THEN 'env' WHEN n_nationkey % 2 = 0 THEN 'file' ELSE 'default' END || n_regionkey AS value FROM nation"),
    "image_kinds": Entry(image_kinds, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN CASE WHEN p_size % 3 <> 1 THEN 'svg' END ELSE CASE WHEN p_size % 10 IN (7, 9) THEN 'gif' END END AS kind, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) END AS width, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size * 2 AS BIGINT) END AS height FROM part"),
    "tag_numbers": Entry(tag_numbers, "SELECT p_partkey, CAST(p_size AS VARCHAR) AS number FROM part"),
    "svg_scripts": Entry(svg_scripts, r"SELECT sha1(k) AS id, bool_or(k <> html) AS cut FROM (SELECT html, regexp_replace(html, '<script\b.*?</script\s*>', '', 'gsi') AS k FROM pages) GROUP BY 1"),
}
