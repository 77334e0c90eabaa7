"""Operator 9: token counts by a separator scan of flat, unindexed token files.

A file is a run of 16-bit token identifiers, documents one after the other, each
followed by the end-of-document identifier; nothing says where documents start.
It is scanned in blocks of ``BLOCK_IDS``: numpy finds the separators of a block,
and a prefix scan over the blocks of a file (identifiers and separators before
a block, the last separator before it) stitches documents that cross blocks.

Files are kept as rows (file, block, ids) of one Parquet table, which any store
takes and Spark can split; ``raw_blocks`` reads bare binary files in the same form.

Defined cases: null and empty texts have 0 tokens; identifiers after a file's
last separator belong to no document; repeated rows are counted each.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, python_batches, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY, END = "byte_bpe_50k.tiktoken", 50256
BLOCK_IDS = 1 << 16
#: The published pre-tokenising pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}


def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    path = os.path.join(folder, name)
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(re.sub(r"\W", "_", name), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def _tokenize(folder: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        held, n_held, block, ordinal, file = [], 0, 0, 0, None

        def rows(blocks, docs):
            k = len(blocks) + len(docs)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * k, pa.int32()),
                    pa.array([b for b, _ in blocks] + [None] * len(docs), pa.int64()),
                    pa.array([x for _, x in blocks] + [None] * len(docs), pa.binary()),
                    pa.array([None] * len(blocks) + [o for o, _ in docs], pa.int64()),
                    pa.array([None] * len(blocks) + [i for _, i in docs], pa.int64()),
                ],
                names=["file", "block", "ids", "ordinal", "doc_id"],
            )

        for batch in batches:
            file = batch.column(0)[0].as_py() if batch.num_rows else file
            docs, blocks = [], []
            for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = enc.encode_ordinary(text.as_py() or "")
                ids.append(END)
                held.append(np.asarray(ids, dtype="<u2"))
                n_held += len(ids)
                docs.append((ordinal, doc_id))
                ordinal += 1
                if n_held >= block_ids:
                    flat = np.concatenate(held)
                    full = n_held // block_ids
                    for k in range(full):
                        blocks.append((block, flat[k * block_ids : (k + 1) * block_ids].tobytes()))
                        block += 1
                    held = [flat[full * block_ids :]]
                    n_held -= full * block_ids
            if docs:
                yield rows(blocks, docs)
        if n_held:
            yield rows([(block, np.concatenate(held).tobytes())], [])

    return run


def write_flat(spark: SparkSession, docs: DataFrame, scratch: Scratch, folder: str = TOKENIZERS, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Token files of ``docs`` (doc_id, text): (file, block, ids), and who was written in which order."""
    python_batches(spark)
    rows = docs.select(F.spark_partition_id().alias("file"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scratch.keep(rows.mapInArrow(_tokenize(folder, block_ids), "file int, block long, ids binary, ordinal long, doc_id long"), "flat")
    return out.where("ids is not null").select("file", "block", "ids"), out.where("ordinal is not null").select("file", "ordinal", "doc_id")


def raw_blocks(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, ids) of bare binary files; ``file`` is the path."""
    files = spark.read.format("binaryFile").load(path)
    size = 2 * block_ids
    at = files.select(F.col("path").alias("file"), "content", F.explode(F.expr(f"sequence(0L, greatest(0L, (length - 1) div {size}))")).alias("block"))
    return at.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("ids"))


def _separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ends = [], []
        for ids in batch.column("ids"):
            flat = np.frombuffer(ids.as_buffer(), "<u2")
            n.append(len(flat))
            ends.append(np.flatnonzero(flat == END).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n_ids", "ends"]
        )


def scan_counts(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the files."""
    python_batches(spark)
    kind = dict(blocks.dtypes)["file"]
    found = blocks.select("file", "block", "ids").mapInArrow(_separators, f"file {kind}, block long, n_ids long, ends array<bigint>")
    before = "over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    placed = found.selectExpr("*", f"coalesce(sum(n_ids) {before}, 0L) as at", f"coalesce(sum(size(ends)) {before}, 0L) as ordinal_at")
    placed = placed.selectExpr("*", f"coalesce(max(case when size(ends) > 0 then at + ends[greatest(size(ends) - 1, 0)] end) {before}, -1L) as last_end")
    placed = placed.where("size(ends) > 0").selectExpr(
        "file", "ordinal_at",
        "transform(ends, (e, i) -> case when i = 0 then at + e - last_end - 1 else e - ends[greatest(i - 1, 0)] - 1 end) as counts",
    )
    return placed.select("file", "ordinal_at", F.posexplode("counts").alias("i", "n_tokens")).select("file", (F.col("ordinal_at") + F.col("i")).alias("ordinal"), "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    blocks, order = write_flat(spark, table(spark, sf_dir, "documents"), scratch)
    return order.join(scan_counts(spark, blocks), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
