"""Queries on reports, masking, licences and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.masking import redact as mask
from ..operators import licences, parsing
from ..sources import adapters as a
from .base import Entry

#: Two licences of a made expression, and what joins them.
NAMES = ("MIT", "GPL-3.0", "Apache 2.0", "BSD License", "MPL-2.0", "isc")
JOINTS = (" OR ", " and ", ", ", "; ", "/", " | ")


def csp_hash(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("'sha256-"), F.base64(F.unhex(F.sha2("text", 256))), F.lit("'")).alias("source"))


def redact(spark, sf_dir):
    d = a.read(spark, sf_dir, "documents").selectExpr("doc_id", "concat(text, ' sk-abcDEF12345', doc_id, ' Authorization : Bearer t.', doc_id, ' secret-value-1 end') as text")
    return d.select("doc_id", F.md5(mask(F.col("text"), ("secret-value-1", "short"))).alias("md5"))


REDACT = r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '***', 'g'), '(authorization\s*:\s*bearer\s+)\S+', '\1***', 'gi') || ' *** Authorization : Bearer *** *** end') AS md5 FROM documents"""


def licence_gate(spark, sf_dir):
    """Which packages' licences pass; expressions are made of two names, three in every fifth."""
    pick = lambda xs, by: f"element_at(array({', '.join(repr(x) for x in xs)}), cast({by} % {len(xs)} + 1 as int))"
    d = a.read(spark, sf_dir, "part").selectExpr(
        "p_partkey as package", f"concat({pick(NAMES, 'p_partkey')}, {pick(JOINTS, 'p_partkey div 6')}, {pick(NAMES, 'p_partkey div 36')}, case p_partkey % 5 when 0 then ' OR ISC' when 1 then ' AND (MIT)' else '' end) as licence"
    )
    return d.select("package", licences.passes(F.col("package").cast("string"), F.lit(None), F.col("licence")).alias("ok"))


LICENCE = """WITH p AS (SELECT p_partkey AS package, p_partkey % 6 AS x, p_partkey // 6 % 6 AS j, p_partkey // 36 % 6 AS y, p_partkey % 5 AS f FROM part),
q AS (SELECT *, x IN (0, 2, 3, 5) AS a, y IN (0, 2, 3, 5) AS b, j = 0 AS alternative FROM p)
SELECT package, CASE WHEN f = 1 THEN false WHEN f = 0 THEN true WHEN alternative THEN a OR b ELSE a AND b END AS ok FROM q"""


def run_report(spark, sf_dir):
    """A nested report for each document as JSON."""
    d = a.attempts(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "engine", "ok"))).alias("x"))
    return d.selectExpr("doc", "to_json(named_struct('input', named_struct('doc', doc), 'attempts', transform(x, e -> named_struct('engine', e.engine, 'ok', e.ok)))) as report")


def gate_hosts(spark, sf_dir):
    """Requests by host, those to hosts off the list refused, plain ones upgraded."""
    d = a.read(spark, sf_dir, "pages").selectExpr("page_id", "url", "lower(parse_url(url, 'HOST')) as host")
    return d.selectExpr("page_id", "host", "host like '%.example.com' as allowed", "regexp_replace(url, '^http:', 'https:') as url")


def vendored_files(spark, sf_dir):
    """Files whose digest differs from the manifest's, or that it lacks."""
    files = a.read(spark, sf_dir, "documents").selectExpr("doc_id as path", "sha2(text, 256) as digest")
    manifest = a.read(spark, sf_dir, "documents").where("doc_id % 7 > 0").selectExpr("doc_id as path", "case when doc_id % 10 = 3 then 'x' else sha2(text, 256) end as wanted")
    return files.join(manifest, "path", "left").selectExpr("path", "case when wanted is null then 'unlisted' when wanted <> digest then 'changed' end as problem").where("problem is not null")


def html_nodes(spark, sf_dir):
    d = parsing.html_rows(a.read(spark, sf_dir, "pages").selectExpr("page_id as id", "html as text"))
    return d.groupBy("id", "tag").agg(F.count("*").alias("n"))


def html_tables(spark, sf_dir):
    """Elements by depth of their path."""
    d = parsing.html_rows(a.read(spark, sf_dir, "pages").selectExpr("page_id as id", "html as text"))
    return d.groupBy(F.size("path").alias("depth")).agg(F.count("*").alias("n"), F.count("link").alias("links"))


def html_rules(spark, sf_dir):
    d = parsing.html_rule_rows(a.read(spark, sf_dir, "pages").selectExpr("page_id as id", "html as text"))
    return d.groupBy("id", "code").agg(F.count("*").alias("n"))


def _tex(spark, sf_dir):
    return a.read(spark, sf_dir, "documents").selectExpr(
        "doc_id as id",
        r"concat('A \\label{eq:', doc_id, '} see \\eqref{eq:', doc_id % 7, '} and \\citep[see][p. 3]{k', doc_id % 5, ', k2} % note', chr(10), 'x \\footnote{n {', doc_id, '} m} 5\\% \\foo{y}') as text",
    )


def rawtex_tokens(spark, sf_dir):
    return parsing.tex_tokens(_tex(spark, sf_dir))


def comment_strip(spark, sf_dir):
    return parsing.stripped(_tex(spark, sf_dir)).select("id", "stripped")


def _parts(spark, sf_dir, *columns):
    """Columns of parts, dealt to all cores: the file is far smaller than what is parsed, so few tasks would read it."""
    t = a.read(spark, sf_dir, "part")
    n = max(spark.sparkContext.defaultParallelism, a.shares(t))
    return t.select("p_partkey", *columns).repartition(n, "p_partkey", *columns)


def bibtex_fields(spark, sf_dir):
    d = _parts(spark, sf_dir, "p_name", "p_size").selectExpr("p_partkey as id", "concat('@article{k', p_partkey, ', title = {', p_name, '}, year = 20', lpad(p_size, 2, '0'), ', doi = \"10.1/', p_partkey, '\"}') as text")
    return parsing.bibtex_rows(d).selectExpr("id", "place", "type", "key", "fields['title'] as title", "fields['year'] as year", "fields['doi'] as doi")


def macro_table(spark, sf_dir):
    d = _parts(spark, sf_dir, "p_size").selectExpr("p_partkey as id", r"concat('\\newcommand{\\R}{\\mathbb{R}}\\providecommand{\\R}{no}\\renewcommand{\\S2}[1]{', p_size, '#1}\\DeclareMathOperator*{\\tr}{tr}\\newcommand{\\in}{\\input{x}}\\newcommand{\\bad}{\\expandafter x}\\newcommand{\\out}{\\newcommand{\\gone}{1}}\\def\\gone{2}\\newcommand{\\o}[1][x]{y}') as text")
    return parsing.macro_rows(d).select("id", "name", "body")


def char_lines(spark, sf_dir):
    """Lines of characters laid out from texts: 40 to a line, every ninth gap wide."""
    d = a.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.posexplode(F.split(F.regexp_replace("text", r"\s+", "_"), "")).alias("i", "text")).where("text <> ''")
    d = d.selectExpr("doc", "0L as page", "text", "cast(i % 40 * 10 + (case when i % 9 = 8 then 0 else 4 end) as double) as l", "cast(700 - i div 40 * 14 as double) as b", "cast(i % 40 * 10 + 10 as double) as r", "cast(710 - i div 40 * 14 as double) as t", "10.0D as font")
    return parsing.char_lines(d)


ENTRIES = {
    "csp_hash": Entry(csp_hash, "SELECT doc_id, '''sha256-' || base64(unhex(sha256(text))) || '''' AS source FROM documents"),
    "redact": Entry(redact, REDACT),
    "licence_gate": Entry(licence_gate, LICENCE),
    "run_report": Entry(run_report, a.with_sql("attempts", """ SELECT doc, '{"input":{"doc":' || doc || '},"attempts":[' || string_agg('{"engine":"' || engine || '","ok":' || ok || '}', ',' ORDER BY ord) || ']}' AS report FROM attempts GROUP BY doc""")),
    "gate_hosts": Entry(gate_hosts, "SELECT page_id, host, host LIKE '%.example.com' AS allowed, regexp_replace(url, '^http:', 'https:') AS url FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)"),
    "vendored_files": Entry(vendored_files, "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'unlisted' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 10 = 3"),
    "html_nodes": Entry(html_nodes),
    "html_depths": Entry(html_tables),
    "html_rules": Entry(html_rules),
    "rawtex_tokens": Entry(rawtex_tokens),
    "comment_strip": Entry(comment_strip),
    "bibtex_fields": Entry(bibtex_fields, "SELECT p_partkey AS id, 1 AS place, 'article' AS type, 'k' || p_partkey AS key, regexp_replace(p_name, ' +', ' ', 'g') AS title, '20' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS year, '10.1/' || p_partkey AS doi FROM part"),
    "macro_table": Entry(macro_table, r"SELECT p_partkey AS id, unnest(['\R', '\S2', '\tr', '\in']) AS name, unnest(['\mathbb{R}', p_size || '#1', '\operatorname*{tr}', '\input{x}']) AS body FROM part"),
    "char_lines": Entry(char_lines),
}
