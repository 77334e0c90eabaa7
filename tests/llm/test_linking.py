"""Linking of similar sets through centred lists, and what the removing stages do with odd rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliant.llm import components, decontaminate, line_dedup, near_dedup, source_mixing
from foliant.llm.common import Scratch


def families(seed):
    """Sets of one hot list: edited copies of two templates near and below the limit, subsets, unlike ones, and one far larger."""
    r = random.Random(seed)
    out = []
    for base in (range(0, 60), range(1000, 1090)):
        for _ in range(70):
            s = set(base)
            for e in r.sample(sorted(s), r.randint(0, 12)):
                s.discard(e)
                if r.random() < 0.6:
                    s.add(r.choice([e + 100_000, r.randrange(2000, 2040)]))
            out.append(s)
    out += [set(range(k)) for k in range(3, 60, 4)] + [set(range(5000 + 40 * k, 5030 + 40 * k)) | {1} for k in range(12)] + [set(range(400))]
    return [sorted(s) for s in dict.fromkeys(map(frozenset, out))]


@pytest.mark.parametrize(("short", "levels"), [(256, 6), (4, 6), (2, 1)])
def test_links_equal_brute_force(spark, monkeypatch, short, levels):
    monkeypatch.setattr(components, "SHORT", short)
    monkeypatch.setattr(components, "LEVELS", levels)
    sets = families(short)
    data = spark.createDataFrame(list(enumerate(sets)), "node long, s array<long>")
    postings = data.select(F.lit(7).cast("long").alias("key"), "node").union(data.where("node % 2 = 0").select(F.lit(8).cast("long").alias("key"), "node"))
    roots = components.link(postings, lambda p: p, lambda asked: data.join(asked, "node"), 80, Scratch(spark, "t")).collect()
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        k = len({*sets[a]} & {*sets[b]})
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in roots}
    assert len({find(x) for x in range(len(sets))}) > 10
    assert [got.get(x, x) for x in range(len(sets))] == [find(x) for x in range(len(sets))]


def test_lines_of_one_set_are_near(spark):
    """Lines of unequal length with the same shingles, odd ids, and an id with two texts."""
    alike = [("-" * 9, "-" * 30), ("=" * 100, "=" * 600), ("ab " * 60, "ab " * 400), ("click here to buy " * 5, "click here to buy " * 30)]
    rows = [(10 * k + j, line, "x") for k, pair in enumerate(alike, 1) for j, line in enumerate(pair)]
    rows += [(90, "the opening line of a first text\nits second line, said once", "x"), (90, "a quite unlike beginning here\nno other text holds this one", "x"), (80, "the opening line of a first text", "x")]
    rows += [(None, "said by a row without an id\nonly here, first", "x"), (None, "only here, second", "x"), (70, "said by a row without an id", "x"), (60, "twice the same row", "p"), (60, "twice the same row", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").withColumn("q_text", F.lit(1)).withColumn("lines", F.lit("l")).withColumn("dropped", F.lit("d"))
    kept = line_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 999, r["text"]) for r in kept.collect())
    want = [(10 * k, pair[0]) for k, pair in enumerate(alike, 1)] + [(60, "twice the same row"), (70, "said by a row without an id"), (80, "the opening line of a first text"), (90, "its second line, said once"), (90, "a quite unlike beginning here\nno other text holds this one"), (999, "only here, first"), (999, "only here, second")]
    assert got == sorted(want) and {r["q_text"] for r in kept.collect()} == {1} and {r["dropped"] for r in kept.collect()} == {"d"}


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_near_stage_judges_rows(spark):
    """A copied row takes no other text of its id along; null ids stand for themselves; any column name is passed on."""
    one, two = words(1, 60), words(2, 60)
    rows = [(1, one, 5), (2, one, 6), (2, two, 7), (None, words(3, 60), 8), (None, words(4, 60), 9), (None, one, 1), (3, "", 2), (3, "", 2), (4, words(5, 60), 3), (4, words(5, 60), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int").withColumn("_key", F.lit("k")).withColumn("id", F.lit("i")).withColumn("h", F.lit("h")).withColumn("repeated", F.lit("r"))
    kept = near_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["gone_id"]) for r in kept.collect()) == [(0, 8), (0, 9), (1, 5), (2, 7), (3, 2), (3, 2), (4, 3)]


def test_decontamination_stage_judges_texts(spark, tmp_path):
    item = words(77, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{words(6, 50)} {item} {words(7, 50)}"
    rows = [(1, leak), (1, words(8, 60)), (None, leak), (None, words(9, 60)), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bad_id", F.lit(1)).withColumn("row", F.lit("r"))
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect()) == sorted([(1, words(8, 60)), (0, words(9, 60)), (2, "")])


def test_leaks_in_paraphrase(spark):
    """Items are found whole and with every tenth or fifth word of their first three quarters replaced; unlike texts are left alone."""
    items = [(k, words(500 + k, 40)) for k in range(60)]

    def edited(k, step):
        w = items[k][1].split()
        return " ".join("changed" if step and i % step == step - 1 and i < 30 else x for i, x in enumerate(w))

    docs = [(1000 * j + k, f"{words(2000 + k, 40)} {edited(k, step)} {words(3000 + k, 40)}") for j, step in enumerate((0, 10, 5)) for k in range(60)]
    docs += [(9000 + k, words(4000 + k, 120)) for k in range(200)]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for j in range(3):
        assert sum((1000 * j + k, k) in found for k in range(60)) >= 54
    assert all(d < 9000 and d % 1000 == i for d, i in found)


def test_mixing_stage_keeps_texts(spark):
    docs = spark.createDataFrame([(k, words(k, 300), "ab"[k % 2], 1) for k in range(6)] + [(None, None, None, 1)], "doc_id long, text string, source string, size int")
    out = source_mixing.stage(spark, docs, "")
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert sorted((r["doc_id"], r["size"]) for r in out.collect() if r["doc_id"] is not None) == [(k, 300) for k in range(6)]
