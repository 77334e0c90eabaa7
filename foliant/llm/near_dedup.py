"""Operator 8: near-duplicate documents by a MinHash signature-coordinate inverted join.

Each document's set of distinct 2-word shingles (hashed to 64 bits) gives a
signature of ``COORDS`` MinHash coordinates. Documents with equal sets form a
class at once; the classes are posted under every (coordinate, value) pair.
Pairs must agree on ``MATCHES`` coordinates (the threshold below which a pair at
the similarity limit falls with a chance of about 5e-5), so it suffices to meet
in one of the ``COORDS - MATCHES + 1`` rarest postings of both (prefix), values
that nobody else has being rarest of all: a class whose unique values fill the
prefix is skipped altogether. Pairs of a list are counted, those of unlike size
or with too few agreeing coordinates are skipped, and the rest are confirmed on
full sets. ``components.link`` centres long lists, so that none is paired with itself.

Defined cases: null, empty or blank text has the empty set and links with
nothing; its component is its own id. A text of one word has that word as its
only shingle. Repeated rows and rows with one id are kept apart; equal texts
always share a component. A null id never is a component's smallest unless all
its ids are null, and such a row is kept; it links as any other. Other columns are not read by the
query; the stage passes them on under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .common import Scratch, bounded, python_batches, table
from .components import link

COORDS, MATCHES = 64, 38
#: Words of a shingle in the pipeline's stage.
STAGE_WORDS = 5
#: Stands for a null id, which orders last.
LAST = (1 << 63) - 1
U = np.uint64
_rng = np.random.default_rng(20240817)
MULT = _rng.integers(0, 1 << 63, COORDS, dtype=np.int64).astype(U) * U(2) + U(1)
ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.int64).astype(U)


def shingle_sets(words, first, size):
    """Sorted distinct shingle hashes of each row; shorter rows have one for the whole."""
    n = len(first) - 1
    count = np.diff(first)
    run = ts.mix(words.copy()) if len(words) else words
    for k in range(1, size):
        nxt = np.zeros_like(words)
        nxt[: len(words) - k] = words[k:]
        run = ts.mix(run * U(0x9E3779B97F4A7C15) + nxt)
    for i in range(n):
        lo, c = int(first[i]), int(count[i])
        if c >= size:
            yield np.unique(run[lo : lo + c - size + 1])
        elif c:
            whole = U(0x51ED270B9F652295)
            for w in words[lo : lo + c]:
                whole = ts.mix((np.array([whole]) + w) * U(0x9E3779B97F4A7C15))[0]
            yield np.array([whole], U)
        else:
            yield np.zeros(0, U)


def signature(values):
    """The smallest of the values under each of COORDS multiply-shift functions."""
    best = None
    for at in range(0, len(values), 2048):
        low = ((values[at : at + 2048, None] * MULT + ADD) >> U(32)).min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best.astype(np.uint32).view(np.int32)


def set_key(values):
    """Two 64-bit sums that stand for the whole set."""
    with np.errstate(over="ignore"):
        a = ts.mix(values + U(0xA0761D6478BD642F)).sum(dtype=U) + U(len(values))
        b = np.bitwise_xor.reduce(ts.mix(values * U(0xE7037ED1A0B428DB) + U(1)))
    return int(ts.mix(np.array([a]))[0].astype(np.int64)), int(b.astype(np.int64))


ROWS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("check", T.LongType()),
        T.StructField("sig", T.ArrayType(T.IntegerType())),
        T.StructField("id", T.LongType()),
        T.StructField("h", T.LongType()),
    ]
)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, data, offsets in ts.slices(batch.column(1)):
                words, first = ts.scan(data, offsets)
                n, keys, checks, sigs = [], [], [], []
                for values in shingle_sets(words, first, size):
                    n.append(len(values))
                    if len(values):
                        k, c = set_key(values)
                        keys.append(k)
                        checks.append(c)
                        sigs.append(signature(values) if len(values) >= 4 else None)
                    else:
                        keys.append(None)
                        checks.append(None)
                        sigs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sigs, pa.list_(pa.int32())), batch.column(2).slice(at, len(n)), batch.column(3).slice(at, len(n))],
                    names=[f.name for f in ROWS],
                )

    return run


def _sets(size: int):
    """Rows (node, s) of texts with the set's values, cut to 48 bits; texts whose set is another one than that asked for give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in ts.slices(batch.column(0)):
                words, first = ts.scan(data, offsets)
                asked = batch.column(1).slice(at, len(first) - 1).to_pylist()
                sets = [(k, np.unique(v >> U(16)).astype(np.int64)) for k, v in zip(asked, shingle_sets(words, first, size), strict=True) if len(v) and set_key(v)[0] == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), pa.array([v for _, v in sets], pa.list_(pa.int64()))], names=["node", "s"])

    return run


def identity(docs: DataFrame) -> list:
    """Columns that name a row by id and text; rows that agree in both can't be told apart and needn't be."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h")]


def classes_of(spark: SparkSession, docs: DataFrame, size: int = 2, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles, node, id, h) of every row; (node, root) of the sets with a link)."""
    python_batches(spark)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(texts.select("doc_id", "text", *identity(texts)).mapInArrow(_signatures(size), ROWS), "signatures")
    classes = scratch.keep(
        rows.where("node is not null").groupBy("node", "check").agg(F.min(F.struct("id", "h")).alias("of"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig")).select("node", "n", "sig", "of.*"),
        "classes",
    )
    # postings: classes under (coordinate, value), without values of one class alone
    posted = classes.where("sig is not null").select("node", F.posexplode("sig").alias("coord", "value"))
    posted = posted.select(
        "node", F.shiftleft(F.col("coord").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key")
    )
    common = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # prefix: the rarest COORDS - MATCHES + 1, of which unshared ones come first
    prefix = COORDS - MATCHES + 1
    ranked = posted.join(common, "key").selectExpr(
        "key", "node",
        f"row_number() over (partition by node order by c, key) + {COORDS} - count(*) over (partition by node) as place",
    )
    postings = scratch.keep(ranked.where(f"place <= {prefix}").select("key", "node"), "prefixes")

    def near(pairs: DataFrame) -> DataFrame:
        side = lambda k: classes.select(F.col("node").alias(k), F.col("sig").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return both.where(f"size(filter(zip_with(sa, sb, (x, y) -> x = y), x -> x)) >= {MATCHES}")

    def sets(asked: DataFrame) -> DataFrame:
        # few enough ids go to all tasks; beyond that the texts are shuffled
        ids = bounded(scratch.keep(asked.join(classes.select("node", "id", "h"), "node"), "asked"))
        found = texts.select("text", *identity(texts)).join(ids, ["id", "h"]).select("text", "node")
        return found.mapInArrow(_sets(size), "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))

    return rows, link(postings, near, sets, percent, scratch)


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    rows, roots = classes_of(spark, docs, size, percent)
    named = rows.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (
        named.join(least, "root", "left")
        .select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the one with the smallest id, null ids last, then by text hash.

    Near means 0.8 of the shingles of five words; two words, as the query has them,
    would link texts that differ far more. Rows are judged by id and text, so rows that
    repeat an id with another text, or have none, stand for themselves. Of rows that agree in both one
    stays. Documents without words link with nothing and all stay.
    """
    rows, roots = classes_of(spark, docs, size=STAGE_WORDS)
    named = rows.where("node is not null").join(roots, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root"))
    keeper = named.groupBy("root").agg(F.min(F.struct("id", "h")).alias("k")).select("root", "k.*")
    gone = named.join(keeper.withColumnsRenamed({"id": "kid", "h": "kh"}), "root").where("id <> kid or h <> kh").select("id", "h").distinct()
    scratch = Scratch(spark, "near-stage")
    gone = bounded(scratch.keep(gone, "gone"))
    repeated = bounded(scratch.keep(named.groupBy("id", "h").agg(F.count("*").alias("c")).where("c > 1").select("id", "h"), "repeated"))
    # the row itself goes along as one struct, so that no column's name can clash
    kept = docs.select(F.struct("*").alias("row"), *identity(docs)).join(gone, ["id", "h"], "left_anti")
    once = kept.join(repeated, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return kept.join(repeated, ["id", "h"], "left_anti").union(once).select("row.*")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
      ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
  WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, hop) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.hop = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id,
       d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT doc_id, min(hop) AS component_id FROM r GROUP BY 1) c ON d.doc_id = c.doc_id
"""
