"""Boundary cases whose values follow from the operators' rules."""

from pyspark.sql import functions as F

from foliant.operators import accounting, layout, numbering


def test_estimate_formula(spark):
    runs = spark.createDataFrame([(1, "m", "m", 30, 40_000, 40), (2, "m", "x", 30, 40_000, 40), (3, "m", "x", 0, 0, 0)], "run int, model string, vision_model string, pages long, chars long, equations long")
    prices = spark.createDataFrame([("m", 2.5, 15.0)], "model string, price_in double, price_out double")
    got = {r["run"]: r for r in accounting.estimate(runs, prices).collect()}
    assert tuple(got[1])[2:5] == (46, 65_000, 56_960) and got[1]["usd"] == 1.0169
    assert got[2]["usd"] is None and tuple(got[3])[2:] == (0, 0, 0, 0.0)


def test_ledger_limits(spark):
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, price_in double, price_out double")
    kind = "run int, seq int, model string, prompt_tokens long, completion_tokens long, cache_hit boolean"
    calls = [(1, 1, "m", 500_000, 0, False), (1, 2, "m", 0, 0, False), (2, 1, "m", 500_000, 0, False), (2, 2, "x", 9, 9, True), (3, 1, "m", 900, 0, False), (3, 2, "x", 90, 20, False), (4, 1, "x", 5, 5, True)]
    costed = accounting.cost(spark.createDataFrame(calls, kind), prices)
    usd = {r["run"]: r["usd"] for r in accounting.rollup(costed).collect()}
    assert usd == {1: 1.0, 2: 1.0, 3: None, 4: 0.0}
    stop = lambda limit, tokens: {r["run"]: r["seq"] for r in accounting.first_rejected(costed, limit, tokens).collect()}
    assert stop(1.0, 1000) == {3: 2} and stop(1.0, 1010) == {} and stop(0.999, 2000) == {1: 1, 2: 1} and stop(0.0, 2000) == {1: 1, 2: 1, 3: 1}


def test_short_counts(spark):
    d = spark.createDataFrame([(n,) for n in (12, 1500, 2_000_000, 12_345_678, 999_999, 100_000, 1_234_567_890)], "n long")
    assert [r["s"] for r in d.select(accounting.short_count(F.col("n")).alias("s")).collect()] == ["12", "1.5k", "2M", "12.3457M", "999.999k", "100k", "1234.57M"]


def test_short_counts_equal_printf(spark):
    import duckdb

    # halves whose nearest double is below or above, carries, and sums from a million millions on
    ns = [1_188_945, 1_211_315, 1_211_325, 9_999_995, 99_999_950, 999_999_499_999, 999_999_500_000, 10**12, 1_000_005_000_000, 1_234_565_000_000, 1_999_999_999_999_999, 9_007_199_254_740_993, 2**63 - 1]
    ns += [999, 1000, 1001, 10_010, 999_990, 1_000_000, *range(1_000_005, 1_400_000, 1_370), *range(10_000_050, 99_000_000, 314_150)]
    want = duckdb.execute("select printf('%g', n / case when n < 1000 then 1 when n < 1000000 then 1e3 else 1e6 end) || case when n < 1000 then '' when n < 1000000 then 'k' else 'M' end from (select unnest(?::bigint[]) as n)", [ns]).fetchall()
    d = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, n long").select("i", accounting.short_count(F.col("n")).alias("s"))
    assert [r["s"] for r in d.orderBy("i").collect()] == [w for (w,) in want]


def test_paragraph_merge(spark):
    d = spark.createDataFrame(
        [(1, 1, 0, 100.0, 90.0, 10.0, "A line that is bro-"), (1, 2, 0, 80.0, 70.0, 10.0, "ken here"), (1, 3, 0, 45.0, 35.0, 10.0, "far"), (1, 4, 1, 99.0, 89.0, 10.0, "goes on.")],
        "doc long, n long, page long, top double, bottom double, height double, text string",
    )
    got = layout.merge_paragraphs(d).first()["merged"]
    assert [(r["first"], r["members"], r["text"]) for r in got] == [(1, 2, "A line that is broken here"), (3, 2, "far goes on.")]


def test_section_numbers(spark):
    heads = [(1, 1, 2, True, False), (1, 2, 1, True, False), (1, 3, 2, True, False), (1, 4, 2, False, False), (1, 5, 1, True, True), (1, 6, 2, True, True)]
    # an unnumbered heading opens a scope of its own; six levels
    heads += [(2, n, level, numbered, False) for n, (level, numbered) in enumerate([(1, True), (2, True), (2, True), (1, False), (2, True), (3, True), (2, False), (3, True), (1, True), (4, True), (6, True)])]
    d = spark.createDataFrame(heads, "doc int, n int, level int, numbered boolean, appendix boolean")
    got = numbering.section_numbers(d).orderBy("doc", "n").collect()
    assert [r["number"] for r in got if r["doc"] == 1] == ["1", "1", "1.1", None, "A", "1.1"]
    assert [r["number"] for r in got if r["doc"] == 2] == ["1", "1.1", "1.2", None, "1.1", "1.1.1", None, "1.1.1", "2", "2.1", "2.1.1"]


def test_section_numbers_sort_once(spark):
    # each further order of the same rows is a further copy of them in a task's memory
    d = spark.createDataFrame([(1, 1, 1, True, False)], "doc int, n int, level int, numbered boolean, appendix boolean")
    plan = numbering.section_numbers(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_section_numbers_in_and_out_of_the_appendix(spark):
    # the appendix need not come last: its counts go on where they were, under the same headings
    heads = [(1, True, False), (2, True, True), (2, True, False), (2, True, True), (1, True, True), (2, True, False), (1, True, False), (2, True, True), (None, True, False), (3, True, True)]
    d = spark.createDataFrame([(1, n, *h) for n, h in enumerate(heads)], "doc int, n int, level int, numbered boolean, appendix boolean")
    assert [r["number"] for r in numbering.section_numbers(d).orderBy("n").collect()] == ["1", "1", "1.1", "2", "A", "1.1", "2", "1.1", "", "1.1.1"]


def test_headings_grow_by_tasks(spark, monkeypatch):
    from foliant.sources import adapters

    sf = "/root/testdata/sf0.001"
    few = {tuple(r) for r in adapters.headings(spark, sf).collect()}
    monkeypatch.setattr(adapters, "SHARE", 10_000)
    d = adapters.headings(spark, sf)
    assert d.rdd.getNumPartitions() == adapters.shares(adapters.read(spark, sf, "lineitem")) > 4 and {tuple(r) for r in d.collect()} == few
    # numbering by document needs no second shuffle
    assert numbering.section_parents(d)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_backlinks_are_shuffled_once(spark, tmp_path, monkeypatch):
    import duckdb

    from foliant.plans import numbering as plans
    from foliant.sources import adapters

    monkeypatch.setattr(adapters, "SHARE", 100)
    rows = [(p, o, o % 3, o % 2, 1.0) for p in (1, 12, None, -1) for o in range(40 if p == 12 else 3)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    d = plans.backlink_seq(spark, str(tmp_path))
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1 and d.rdd.getNumPartitions() > 4
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(plans.ENTRIES["backlink_seq"].sql).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in d.collect()) and (None, 3) in want


def test_valleys_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = [(f"d{p % 3}" if p else None, p, lo := rng.randrange(-20, 120), lo + rng.randrange(-3, 90)) for p in range(12) for _ in range(rng.choice((1, 2, 5, 160)))] + [("e", 1, 5, 5), ("f", 1, -9, 300)]
    want = []
    for doc, page in sorted({r[:2] for r in rows}, key=repr):
        spans = [r[2:] for r in rows if r[:2] == (doc, page)]
        thin = [doc is None or sum(lo <= x < hi for lo, hi in spans) <= max(1.0, 0.02 * len(spans)) for x in range(100)]
        starts = [x for x in range(100) if thin[x] and (x == 0 or not thin[x - 1])]
        runs = [(x, next((y for y in range(x, 100) if not thin[y]), 100) - 1) for x in starts]
        want += [(doc, page, x, y) for x, y in runs if y - x + 1 >= 4]
    d = spark.createDataFrame(rows, "doc string, page long, lo int, hi int")
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in layout.valleys(layout.occupancy(d, 0, 100), 4).collect())
    # a line is three rows at most, where it was a row for each unit
    wide = spark.createDataFrame([("d", 1, 0, 100_000)], "doc string, page long, lo int, hi int")
    assert layout.occupancy(wide, 0, 100_000).count() == 1


def test_rate_limit_equals_loop(spark):
    times = [0, 1, 2, 10, 11, 30]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "gate int, id int, us long")
    want, last = [], None
    for t in times:
        last = t if last is None else max(t, last + 3)
        want.append(last)
    assert [r["release_us"] for r in accounting.paced(d, 3).orderBy("id").collect()] == want


def test_stream_limiter(spark, tmp_path):
    from foliant.streaming.ledger import paced

    spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 1, 2, 10])], "gate long, id long, us long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("gate long, id long, us long").parquet(str(tmp_path / "in"))
    q = paced(s, 3).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["release_us"] for r in spark.table("paced").orderBy("id").collect()] == [0, 3, 6, 10]


def test_paragraphs_end_as_published(spark):
    kind = "doc long, n long, page long, top double, bottom double, height double, text string, role string"
    row = lambda n, page, top, text, role="paragraph", height=10.0: (1, n, page, top, top - 10, height, text, role)
    d = spark.createDataFrame([row(1, 0, 100.0, "Ends with a colon:"), row(2, 0, 95.0, "a figure", "figure"), row(3, 1, 100.0, "  goes on (so). ") , row(4, 2, 100.0, "New"), row(5, 3, 100.0, "it is said.\""), row(6, 4, 100.0, "Last")], kind)
    got = layout.merge_paragraphs(d).first()["merged"]
    assert [(r["first"], r["members"], r["text"]) for r in got] == [(1, 2, "Ends with a colon: goes on (so). "), (4, 2, "New it is said.\""), (6, 1, "Last")]
    tiny = spark.createDataFrame([row(1, 0, 100.0, "a", height=0.1), row(2, 0, 87.6, "b", height=0.1), row(3, 0, 87.4, "c", height=0.1)], kind)
    assert [r["members"] for r in layout.merge_paragraphs(tiny).first()["merged"]] == [2, 1]


def test_runners_stand_in_one_band(spark):
    rows = [(1, page, f"Page {page}", 760.0 + page % 2) for page in range(5)] + [(1, page, "Moves", 30.0 + 9 * (page % 2)) for page in range(5)] + [(1, page, f"text {'abcde'[page]}", 400.0) for page in range(5)] + [(2, page, "Few", 5.0) for page in range(3)]
    kept = layout.strip_repeated(spark.createDataFrame(rows, "doc int, page int, line string, bottom double"))
    assert sorted((r["doc"], r["line"]) for r in kept.collect()) == [(1, "Moves")] * 2 + [(1, f"text {c}") for c in "abcde"] + [(2, "Few")] * 3


def test_font_jump_against_the_larger(spark):
    d = spark.createDataFrame([(1, 1, 0, 1, 100.0, 90.0, 10.0, 10.0), (1, 1, 0, 2, 88.0, 78.0, 10.0, 13.0), (1, 1, 0, 3, 76.0, 66.0, 10.0, 20.0)], "doc int, page int, col int, seq int, top double, bottom double, height double, font double")
    assert [r["block"] for r in layout.blocks(d).orderBy("seq").collect()] == [0, 0, 1]
