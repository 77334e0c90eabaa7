"""Mixing: the texts are shuffled once in a step, and what one step needs does not outlive it."""

import os

from foliant.llm import common, source_mixing


def test_texts_and_blocks_are_shuffled_in_steps_of_their_own(spark, monkeypatch):
    steps, live = {}, {}
    keep = common.Scratch.keep

    def kept(self, df, name):
        steps[name] = df._jdf.queryExecution().executedPlan().toString()
        out = keep(self, df, name)
        live[name] = out.scratch_path.removeprefix("file:")
        return out

    monkeypatch.setattr(common.Scratch, "keep", kept)
    rows = [(i, f"w{i} " * (40 + 7 * i), "ab"[i % 2]) for i in range(30)] + [(30, None, "a"), (31, "", None), (None, "x y z " * 50, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mixing.mixed(spark, docs).collect()
    # documents are placed, by chunk, in one step; the next one cuts and shuffles blocks
    assert "hashpartitioning(sid" in steps["placed"] and "collect_list" in steps["mix"] and "collect_list" not in steps["placed"]
    assert not os.path.exists(live["placed"]) and os.path.exists(live["mix"])
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    total = sum(r["taken"] for r in got)
    assert abs(total - sum({r["source"]: r["target"] for r in got}.values())) <= 3 * source_mixing.BLOCK
    assert all(r["taken"] <= 2 * r["size"] for r in got)
