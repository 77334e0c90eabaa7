"""Operator 10: learned decision lists of quality rules, in DataFrame operations only.

Statistics of a text are built-in column expressions. Rules are learned by
sequential covering on the statistics of at most ``MOST_LABELLED`` labelled rows
(the first in a hash order of doc_id, so any corpus size gives one sample):
a conjunction of thresholds grows by FOIL gain on two thirds of the sample, is
pruned on the rest, and is kept while it is precise enough there; covered rows
go, and the next rule is learned. The list is emitted as one ordered
``CASE WHEN`` over the statistics. Learning reads plain rows on the driver, of
which the bound is proven; everything else covers all rows.

Defined cases: null or blank text has zero for all statistics and fails the base
rule (fewer than 50 words). Without labels of both kinds the list is empty and
the base rule alone decides. Repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, WORD, table

MOST_LABELLED = 8192
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MAX_RULES, MAX_TERMS, CUTS = 8, 4, 24
#: A rule must be right this often on the rows held back for pruning, and cover as many.
PRECISION, LEAST_COVERED = 0.97, 8
FEATURES = ["word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "distinct_rate", "line_words"]


def _without(text: str, chars: str) -> str:
    quoted = chars.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    quoted = quoted.replace("\x0b", "\\u000B").replace("\x0c", "\\u000C")
    return f"length(translate({text}, '{quoted}', ''))"


def statistics(docs: DataFrame) -> DataFrame:
    """Adds the counts of ``text`` to all columns of ``docs``; made columns start with ``q_``.

    Words in repeated 3-word windows: each window's hash is packed with its
    position into one long, these are sorted as primitives, and positions of
    equal neighbours are kept; time is n log n in the words, also in one very
    long text. The hash keeps 64 bits less those of the position (49 bits in a
    text of 20,000 words).
    """
    d = docs.withColumn("q_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn("q_w", F.regexp_extract_all("q_text", F.lit(WORD), 0)).withColumn("q_lines", F.split("q_text", "\n"))
    d = d.withColumn("q_lines", F.expr(r"filter(q_lines, x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn("q_n", F.size("q_w").cast("long"))
    d = d.withColumn("q_bits", F.expr("cast(ceil(log2(greatest(q_n, 2) + 1)) as int)"))
    d = d.withColumn(
        "q_keys",
        F.expr(
            "case when q_n < 4 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, cast(q_n - 3 as int)), i -> "
            "shiftleft(xxhash64(q_w[i], q_w[i + 1], q_w[i + 2]), q_bits) | cast(i as bigint))) end"
        ),
    )
    d = d.withColumn(
        "q_at",
        F.expr(
            "sort_array(transform(filter(q_keys, (k, j) -> "
            "(j > 0 and shiftright(k, q_bits) = shiftright(q_keys[greatest(j - 1, 0)], q_bits)) or "
            "(j < size(q_keys) - 1 and shiftright(k, q_bits) = shiftright(q_keys[least(j + 1, size(q_keys) - 1)], q_bits))), "
            "k -> k & (shiftleft(1L, q_bits) - 1)))"
        ),
    )
    d = d.withColumn(
        "q_repeat",
        F.expr(
            "aggregate(transform(q_at, (p, j) -> case when j = size(q_at) - 1 then 3L else least(3L, q_at[least(j + 1, size(q_at) - 1)] - p) end), "
            "0L, (s, x) -> s + x)"
        ),
    )
    d = d.withColumn("q_chars", F.expr(_without("q_text", SPACES) + " * 1L"))
    d = d.withColumn("q_symbols", F.expr(f"(length(q_text) - {_without('q_text', SYMBOLS)}) * 1L"))
    d = d.withColumn("q_upper", F.expr(f"(length(q_text) - {_without('q_text', UPPER)}) * 1L"))
    d = d.withColumn("q_bang", F.expr(f"(length(q_text) - {_without('q_text', '!?')}) * 1L"))
    d = d.withColumn("q_nlines", F.size("q_lines").cast("long"))
    d = d.withColumn("q_dup", F.expr("(size(q_lines) - size(array_distinct(q_lines))) * 1L"))
    d = d.withColumn("q_distinct", F.expr("size(array_distinct(q_w)) * 1L"))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    made = {
        "word_len": per("q_chars", "q_n"), "symbol_rate": per("q_symbols", "q_n"), "dup_line_rate": per("q_dup", "q_nlines"),
        "repeat_rate": per("q_repeat", "q_n"), "upper_rate": per("q_upper", "q_chars"), "bang_rate": per("q_bang", "q_n"),
        "distinct_rate": per("q_distinct", "q_n"), "line_words": per("q_n", "q_nlines"),
    }
    d = d.withColumns({f"q_{k}": v for k, v in made.items()})
    # A generator ends the projection: filters on the statistics are not moved
    # below it, where they would be computed again for every array element.
    counts = ["q_n", "q_chars", "q_symbols", "q_upper", "q_bang", "q_nlines", "q_dup", "q_distinct", "q_repeat"]
    made_all = F.struct(*[F.col(c).alias(c) for c in [*counts, *[f"q_{k}" for k in made]]])
    return d.select(*docs.columns, F.inline(F.array(made_all)))


def base_failed() -> Column:
    return (F.col("q_n") < 50) | (100 * F.col("q_repeat") > 50 * F.col("q_n"))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _holds(rule: list[tuple[int, str, float]], row: tuple) -> bool:
    return all(row[f] >= v if op == ">=" else row[f] <= v for f, op, v in rule)


def learn(rows: list[tuple[tuple[float, ...], bool]], salt: int = 0) -> list[list[tuple[int, str, float]]]:
    """Rules that find bad rows, in order. ``rows``: (statistics, bad)."""
    grow = [r for i, r in enumerate(rows) if (i + salt) % 3]
    prune = [r for i, r in enumerate(rows) if not (i + salt) % 3]
    cuts = []
    for f in range(len(rows[0][0]) if rows else 0):
        seen = sorted({x[f] for x, bad in rows if bad})
        cuts.append(sorted({seen[(len(seen) - 1) * k // CUTS] for k in range(CUTS + 1)}) if seen else [])
    rules: list[list[tuple[int, str, float]]] = []
    while len(rules) < MAX_RULES and any(bad for _, bad in grow):
        rule: list[tuple[int, str, float]] = []
        now = grow
        while len(rule) < MAX_TERMS and any(not bad for _, bad in now):
            p0 = sum(bad for _, bad in now)
            n0 = len(now) - p0
            best = (1e-9, None)
            for f, values in enumerate(cuts):
                for op in (">=", "<="):
                    for v in values:
                        hit = [bad for x, bad in now if (x[f] >= v if op == ">=" else x[f] <= v)]
                        g = _gain(p0, n0, sum(hit), len(hit) - sum(hit))
                        if g > best[0]:
                            best = (g, (f, op, v))
            if best[1] is None:
                break
            rule.append(best[1])
            now = [r for r in now if _holds(rule, r[0])]
        if not rule:
            break

        def worth(terms):
            hit = [bad for x, bad in prune if _holds(terms, x)]
            return ((2 * sum(hit) - len(hit)) / (len(hit) + 1), len(hit), sum(hit))

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        _, hits, right = worth(rule)
        if hits < LEAST_COVERED or right < PRECISION * hits:
            break
        rules.append(rule)
        grow = [r for r in grow if not _holds(rule, r[0])]
        prune = [r for r in prune if not _holds(rule, r[0])]
    return rules


def decision(rules: list[list[tuple[int, str, float]]]) -> Column:
    """The number of the first rule that holds, as an ordered conditional; null if none."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, op, v in rule:
            c = F.col(f"q_{FEATURES[f]}")
            test = test & (c >= F.lit(v) if op == ">=" else c <= F.lit(v))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame) -> list[list[tuple[int, str, float]]]:
    """Learns a list from ``labels`` (doc_id, quality): 0 is bad."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("s_id"))
        .agg(F.min("quality").alias("s_quality"))
        .withColumn("s_order", F.xxhash64("s_id"))
        .orderBy("s_order", "s_id")
        .limit(MOST_LABELLED)
    )
    # at most MOST_LABELLED rows of three numbers
    some = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("s_id"))
    got = statistics(some).where(~base_failed()).select("s_order", "doc_id", "s_quality", *[f"q_{f}" for f in FEATURES]).distinct().collect()
    got = sorted(got, key=tuple)
    return learn([(tuple(r)[3:], r["s_quality"] == 0) for r in got])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with their statistics, ``base_failed``'s test, rule and verdict."""
    rules = fit(docs, labels)
    d = statistics(docs).withColumn("q_base_failed", base_failed()).withColumn("q_rule", decision(rules))
    return d.withColumn("q_kept", ~F.col("q_base_failed") & F.col("q_rule").isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        F.col("q_n").alias("n_words"),
        F.col("q_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup").alias("n_dup_lines"),
        F.col("q_repeat").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_rule").alias("rule"),
        F.col("q_kept").alias("kept"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns they came with."""
    return judged(docs, table(spark, sf_dir, "labels")).where("q_kept").select(*docs.columns)
