"""Operator 4: fuzzy line deduplication by MinHash, in DataFrame operations only.

Equal lines collapse first (64-bit hash of the line). The signature of a
distinct line comes from all its distinct 8-character shingles: the line as UTF-32 makes any
shingle a constant-time slice, and the exploded shingles meet in one
whole-stage-generated aggregate of MinHash minima (classes of shingles by hash, and
the hash xor-ed with a constant for each coordinate of a class) without leaving
their task, as they are dealt by line already. Bands of ``ROWS`` coordinates post the line,
``components.link`` compares lines that share a band by
exact Jaccard on full shingle sets, and one line of each component is kept: the first by document id,
text hash and place.

A pair at the limit of 0.8 shares a band with a chance of 99.5 %, at 0.9 of
99.998 %. Lines shorter than a shingle have none and are near equal lines only.

Defined cases: null text has no lines; lines without a word are never dropped
and never compared; a null document id orders last; rows are judged by id and
text, so rows that repeat an id with another text, or have none, are documents of
their own; of rows that agree in both, the first keeps what the text keeps and
the others lose every line with a word; extra columns are passed on under any name.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, bounded, table
from .components import link

SHINGLE, BANDS, ROWS, PERCENT, MATCHES = 8, 10, 4, 80, 20
LAST = (1 << 63) - 1
#: All that WORD leaves out.
SPACES = " \t\n\v\f\r"
_random = random.Random(20240817)
CLASSES, FUNCTIONS = 8, BANDS * ROWS // 8
MASKS = [_random.getrandbits(64) - (1 << 63) for _ in range(FUNCTIONS)]
_deals = [_random.sample(range(CLASSES), CLASSES) for _ in range(FUNCTIONS)]
#: The coordinates of each band, one of each of ROWS classes.
BAND = [[CLASSES * j + c for c in deal[at : at + ROWS]] for j, deal in enumerate(_deals) for at in range(0, CLASSES, ROWS)]
SHINGLE_HASH = f"xxhash64(substring(bin, 4 * i + 1, {4 * SHINGLE}))"


def named(docs: DataFrame, *more) -> DataFrame:
    """(ord, th, ...): what a row is known by, its id and its text's hash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(F.col("text").cast("string")).alias("th"), *more)


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, ord, th, pos, line) of every line that holds a word."""
    lines = named(docs, F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    # a word is whatever is left without leading white space; a regular expression would decode each line
    return lines.where(F.octet_length(F.ltrim("line", F.lit(SPACES))) > 0).select(F.xxhash64("line").alias("h"), "ord", "th", "pos", "line")


def signatures(lines: DataFrame) -> DataFrame:
    """(h, sig) from distinct (h, line); lines dealt by h are not dealt anew.

    One permutation in ``CLASSES``: a shingle counts in the class that its hash names, under FUNCTIONS
    minima each. A class without shingles borrows from the next that has one.
    """
    d = lines.selectExpr("h", "encode(line, 'UTF-32') as bin").selectExpr("h", "bin", f"octet_length(bin) div 4 - {SHINGLE - 1} as n").where("n >= 1")
    d = d.selectExpr("h", "bin", "explode(sequence(0, cast(n - 1 as int))) as i").selectExpr("h", f"{SHINGLE_HASH} as x")
    d = d.groupBy("h", F.expr(f"x & {CLASSES - 1}").alias("class")).agg(*[F.expr(f"min(x ^ {m}L)").alias(f"m{j}") for j, m in enumerate(MASKS)])
    own = [F.max(F.when(F.col("class") == c, F.col(f"m{j}"))).alias(f"m{c}_{j}") for c in range(CLASSES) for j in range(FUNCTIONS)]
    lent = lambda c, j: F.coalesce(*[F.col(f"m{(c + k) % CLASSES}_{j}") + F.lit(k) for k in range(CLASSES)])
    order = [(c, j) for j in range(FUNCTIONS) for c in range(CLASSES)]
    # most lines have shingles in all classes and borrow nothing
    full = reduce(and_, [F.col(f"m{c}_0").isNotNull() for c in range(CLASSES)])
    sig = F.when(full, F.array(*[F.col(f"m{c}_{j}") for c, j in order])).otherwise(F.array(*[lent(c, j) for c, j in order]))
    return d.groupBy("h").agg(*own).select("h", sig.alias("sig"))


def shingle_set(line: str) -> str:
    """SQL for the distinct shingles' hashes of a column of lines that are not shorter than a shingle; a line takes an eighth of its set's room."""
    each = f"transform(sequence(0, octet_length(bin) div 4 - {SHINGLE}), i -> {SHINGLE_HASH})"
    return f"array_distinct(flatten(transform(array(encode({line}, 'UTF-32')), bin -> {each})))"


def line_classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """(occurrences (h, ord, th, pos); (h, first) of lines that repeat, exactly or nearly; first is a struct of ord, th and pos)."""
    scratch = Scratch(spark, "lines")
    lines = occurrences(docs)
    places = scratch.keep(lines.select("h", "ord", "th", "pos"), "places")
    distinct = lines.groupBy("h").agg(F.first("line").alias("line"))
    sigs = signatures(distinct)
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[k] for k in band]) for b, band in enumerate(BAND)])
    # a byte of each coordinate, above the bits that name its class, tells agreement from chance
    sigs = scratch.keep(sigs.select("h", keys.alias("keys"), F.expr("transform(sig, x -> cast((shiftright(x, 3) & 255) - 128 as tinyint))").alias("sig")), "signatures")
    postings = sigs.select(F.explode("keys").alias("key"), F.col("h").alias("node"))

    def near(pairs: DataFrame) -> DataFrame:
        """At the limit of 0.8 about 32 of 40 coordinates are expected to agree."""
        side = lambda k: sigs.select(F.col("h").alias(k), F.col("sig").alias(f"s{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(f"size(filter(zip_with(sa, sb, (x, y) -> x = y), x -> x)) >= {MATCHES}")

    def sets(asked: DataFrame) -> DataFrame:
        # few enough hashes go to all tasks; beyond that the lines are shuffled
        asked = bounded(scratch.keep(asked.select(F.col("node").alias("h")), "asked"))
        scratch.drop(sigs)  # the pairs are written
        found = lines.select("h", "line").join(asked, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
        return found.where(f"char_length(line) >= {SHINGLE}").selectExpr("h as node", "line as s")

    roots = link(postings, near, sets, PERCENT, scratch, shingle_set)
    firsts = places.groupBy("h").agg(F.min(F.struct("ord", "th", "pos")).alias("first"), F.count("*").alias("c"))
    firsts = firsts.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").where("c > 1 or root is not null")
    firsts = scratch.keep(firsts.select("h", "first", F.coalesce("root", "h").alias("root")), "repeated")
    least = firsts.groupBy("root").agg(F.min("first").alias("first"))
    return places, scratch.keep(firsts.select("h", "root").join(least, "root").select("h", "first"), "firsts"), scratch


def dropped_lines(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """((ord, th, rows, dropped, every) of texts that lose lines or occur in several rows; the lines' places; storage).

    ``dropped``: positions that the first of these rows loses, or null; ``every``: the positions of all lines with a word, where rows repeat.
    """
    places, firsts, scratch = line_classes(spark, docs)
    gone = places.join(firsts, "h").where("ord <> first.ord or th <> first.th or pos <> first.pos")
    gone = gone.groupBy("ord", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    # a row of a text has a line at each place once
    several = places.groupBy("ord", "th", "pos").agg(F.count("*").alias("rows")).where("rows > 1")
    several = several.groupBy("ord", "th").agg(F.max("rows").alias("rows"), F.sort_array(F.collect_set("pos")).alias("every"))
    marks = gone.join(several, ["ord", "th"], "full").select("ord", "th", F.coalesce("rows", F.lit(1)).alias("rows"), "dropped", "every")
    return scratch.keep(marks, "marks"), places, scratch


def judged(spark: SparkSession, docs: DataFrame, *more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that stay as they are; rows (ord, th, ..., dropped, again) that lose lines or repeat; the lines' places).

    ``again``: an equal row comes before it.
    """
    marks, places, scratch = dropped_lines(spark, docs)
    keys = bounded(scratch.keep(marks.select("ord", "th"), "marked"))
    rows = named(docs, *more)
    marked = rows.join(keys, ["ord", "th"], "left_semi").join(marks, ["ord", "th"])
    once = marked.where("rows = 1").withColumn("again", F.lit(False))
    several = marked.where("rows > 1").withColumn("again", F.row_number().over(Window.partitionBy("ord", "th").orderBy(F.lit(0))) > 1)
    cut = once.union(several).withColumn("dropped", F.when(F.col("again"), F.col("every")).otherwise(F.col("dropped")))
    return rows.join(keys, ["ord", "th"], "left_anti"), cut.drop("rows", "every"), places


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: lines with a word, lines kept, positions of those dropped."""
    docs = table(spark, sf_dir, "documents")
    same, cut, places = judged(spark, docs, "doc_id")
    none = F.array().cast("array<int>")
    rows = same.withColumn("dropped", none).union(cut.select("ord", "th", "doc_id", F.coalesce("dropped", none).alias("dropped")))
    out = rows.join(places.groupBy("ord", "th").agg(F.countDistinct("pos").alias("n_lines")), ["ord", "th"], "left")
    n = F.coalesce("n_lines", F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size("dropped")).cast("long").alias("n_kept"), "dropped")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their dropped lines; those that lose all lines with a word go.

    Documents that had no such line stay as they are. ``n_chars`` follows the text.
    """
    # the row itself goes along as one struct, so that no column's name can clash
    same, cut, _ = judged(spark, docs, F.struct("*").alias("row"))
    d = cut.where("not again").withColumn("lines", F.split(F.col("row.text").cast("string"), "\n"))
    left = "array_join(transform(array_except(sequence(0, size(lines) - 1), dropped), i -> lines[i]), '\\n')"
    d = d.select("row", F.inline(F.expr(f"array(struct(dropped is not null as cut, case when dropped is null then row.text else {left} end as text))")))
    d = d.where(F.expr("not cut") | F.col("text").rlike(WORD))
    made = {"text": F.col("text").cast(docs.schema["text"].dataType), "n_chars": F.length("text").cast("long")}
    d = d.select(*[F.when(F.col("cut"), made[c]).otherwise(F.col("row")[c]).alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns])
    return same.select("row.*").union(d)
