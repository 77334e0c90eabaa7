"""Line dedup: which lines hold a word, and signatures with and without empty classes."""

import re

from pyspark.sql import functions as F

from foliant.llm import line_dedup
from foliant.llm.common import WORD


def test_lines_with_a_word_without_a_regular_expression(spark):
    lines = ["", " ", "\t", "\v\f\r \t", "a", " a", " ", "  ", "\r\x1c", " \x85", "\v\fb \r", "\0", "é "]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string")
    found = line_dedup.occurrences(docs)
    assert [lines[r["pos"]] for r in found.orderBy("pos").collect()] == [x for x in lines if re.search(WORD, x)]
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_lend_where_a_class_is_empty(spark):
    texts = ["abcdefgh", "abcdefghi", "the quick brown fox jumps over the lazy dog, twice " * 3, "é" * 8, "xyzxyzxyzxyzxyz"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h long, line string")
    got = {r["h"]: r["sig"] for r in line_dedup.signatures(lines).collect()}
    each = lines.selectExpr("h", f"explode({line_dedup.shingle_set('line')}) as x").groupBy("h").agg(F.collect_list("x").alias("x")).collect()
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    n = line_dedup.CLASSES
    spread = set()
    for r in each:
        least = [[min((x ^ m for x in r["x"] if x & n - 1 == c), default=None) for c in range(n)] for m in line_dedup.MASKS]
        spread.add(None in least[0])
        want = [wrap(next(row[(c + k) % n] + k for k in range(n) if row[(c + k) % n] is not None)) for row in least for c in range(n)]
        assert got[r["h"]] == want
    assert spread == {True, False}
