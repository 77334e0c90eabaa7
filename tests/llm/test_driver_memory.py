"""What the driver frees goes back to the system when a step is written."""

import numpy as np

from foliant.llm import common


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_written_steps_return_freed_memory(spark, tmp_path):
    scratch = common.Scratch(spark, "memory")
    scratch.keep(spark.range(1), "first")
    blocks = [np.ones(5000, np.uint8) for _ in range(40_000)]
    last = blocks[-1]  # pins the end of the C library's heap
    del blocks
    before = resident()
    assert scratch.keep(spark.range(3), "step").count() == 3
    assert before - resident() > 100_000_000 and len(last) == 5000


def test_the_jvm_is_asked_too(spark):
    assert common.trimmed(spark)
