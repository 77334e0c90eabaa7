"""Document-shaped views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that a task gets of it by key.
SHARE = 4 << 20


def shares(table: DataFrame) -> int:
    """How many shares the files of a table as read make; no job runs."""
    return -(-int(str(table._jdf.queryExecution().analyzed().stats().sizeInBytes())) // SHARE)


def spread(d: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``d``, made of ``table``, by its keys in as many partitions as there are shares.

    A task's rows then do not grow with the table. What needs no more than the session's partitions is left to them.
    """
    n = shares(table)
    return d.repartition(n, *keys) if n > int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) else d


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, pos, line): each source is a document, each text a page."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, n, level, kind, captioned): an ordered list of numberable blocks for each order."""
    t = read(spark, sf_dir, "lineitem")
    # named before it is numbered, as windows by another name would shuffle again
    d = spread(t.selectExpr("l_orderkey as doc", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), t, "doc")
    return d.selectExpr(
        "doc",
        "row_number() over (partition by doc order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n",
        "cast(1 + l_partkey % 3 as int) as level",
        "case l_suppkey % 4 when 0 then 'sec' when 1 then 'eq' when 2 then 'fig' else 'para' end as kind",
        "l_quantity > 10 as captioned",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, seq, model, prompt_tokens, completion_tokens, cache_hit): a ledger of model calls."""
    d = read(spark, sf_dir, "conversations")
    return d.selectExpr(
        "conv_id as run", "turn as seq", "role as model",
        "cast(length(text) div 4 as bigint) as prompt_tokens", "cast(length(text) div 8 as bigint) as completion_tokens", "turn % 5 = 3 as cache_hit",
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, asset_id, kind, bytes)."""
    d = read(spark, sf_dir, "documents")
    return d.selectExpr("source as doc", "doc_id as asset_id", "case doc_id % 3 when 0 then 'figure' when 1 then 'table' else 'equation' end as kind", "n_chars as bytes")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, ord, engine, ok, code): conversion attempts in plan order."""
    d = read(spark, sf_dir, "pages").selectExpr("page_id as doc", "length(html) as n")
    d = d.select("doc", "n", F.posexplode(F.array(F.lit("arxiv-html"), F.lit("latex"), F.lit("pdf"))).alias("ord", "engine"))
    return d.selectExpr(
        "doc", "cast(ord as int) as ord", "engine", "(n + 7 * ord) % 3 = 0 as ok",
        "case (n + ord) % 4 when 0 then 'html-stub' when 1 then 'pandoc-timeout' when 2 then 'security' else 'odd-code' end as code",
    )


#: The same views in DuckDB's SQL, as common table expressions.
SQL = {
    "doc_lines": "doc_lines AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)",
    "headings": """headings AS (SELECT l_orderkey AS doc,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n,
  CAST(1 + l_partkey % 3 AS INT) AS level,
  CASE l_suppkey % 4 WHEN 0 THEN 'sec' WHEN 1 THEN 'eq' WHEN 2 THEN 'fig' ELSE 'para' END AS kind, l_quantity > 10 AS captioned FROM lineitem)""",
    "calls": """calls AS (SELECT conv_id AS run, turn AS seq, role AS model, CAST(length(text) // 4 AS BIGINT) AS prompt_tokens,
  CAST(length(text) // 8 AS BIGINT) AS completion_tokens, turn % 5 = 3 AS cache_hit FROM conversations)""",
    "assets": "assets AS (SELECT source AS doc, doc_id AS asset_id, CASE doc_id % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'equation' END AS kind, n_chars AS bytes FROM documents)",
    "attempts": """attempts AS (SELECT doc, ord, engine, (n + 7 * ord) % 3 = 0 AS ok,
  CASE (n + ord) % 4 WHEN 0 THEN 'html-stub' WHEN 1 THEN 'pandoc-timeout' WHEN 2 THEN 'security' ELSE 'odd-code' END AS code
  FROM (SELECT page_id AS doc, length(html) AS n FROM pages), (VALUES (0, 'arxiv-html'), (1, 'latex'), (2, 'pdf')) e(ord, engine))""",
}


def with_sql(names: str, query: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names.split()) + query
