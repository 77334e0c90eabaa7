"""Operator 6: mixing sources to target weights, in DataFrame operations only.

The words of each source form one stream (documents in a fixed pseudorandom
order), packed into blocks of ``BLOCK`` words. A source's share of the mix is a
number of slots. Every slot draws its output shard by hash, which makes a
source's counts over the shards a multinomial draw whose total is the share
itself, so the mix meets its targets and reruns agree. Slot k takes block
pi(k mod n) of its source, pi being a pseudorandom permutation for each source
and epoch (swap-or-not rounds, which permute any range [0, n) without a table),
and slots and packed blocks are joined by index: the mix is a written table of
(shard, position, words), the text of each slot. What is taken of a document is counted from that table.

Hot sources: positions come from two-level prefix sums over hash chunks of
bounded size, and slots are generated in ranges dealt to all tasks.

Defined cases: null text has size 0 and nothing of it is taken; a null source is
a source of its own, last in order; a source without words has target 0; repeated
rows count as often as they occur; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, parts, table

BLOCK = 128
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
ROUNDS, SEED = 10, 20240817
SLOTS_PER_SHARD = 4096
CHUNK_ROWS = 2_000
RANGE = 8192
#: As an SQL literal.
PATTERN = "'" + WORD.replace("\\", "\\\\") + "'"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size).

    Water filling: sources saturate in the order of size over weight. With the
    first j saturated the level is what is left over their weights; a source
    whose own limit lies below the level that remains is saturated too.
    """
    cases = " ".join(f"when {i} then {w}.0D" for i, w in enumerate(WEIGHTS))
    s = sizes.selectExpr("source", "source_size", "row_number() over (order by source nulls last) - 1 as sid")
    s = s.selectExpr("*", f"case sid % {len(WEIGHTS)} {cases} end as weight")
    s = s.selectExpr(
        "*",
        f"{SHARE}D * sum(source_size) over () as budget",
        f"{MOST}D * source_size as limit",
        "row_number() over (order by source_size / weight, sid) as place",
    )
    s = s.selectExpr(
        "*",
        "budget - coalesce(sum(limit) over (order by place rows between unbounded preceding and 1 preceding), 0D) as left_over",
        "sum(weight) over (order by place desc rows between unbounded preceding and current row) as weights",
    )
    s = s.selectExpr("*", "left_over / weights as level")
    s = s.selectExpr("*", "limit / weight <= level as full")
    s = s.selectExpr("*", "min(case when not full then place end) over () as free_from")
    s = s.selectExpr("*", "max(case when place = free_from then level end) over () as open_level")
    return s.selectExpr(
        "source", "cast(sid as bigint) sid", "source_size",
        "case when free_from is null or place < free_from then limit else least(limit, weight * open_level) end as target",
    )


def permuted(index: str, n: str, *keys: str) -> str:
    """SQL for a pseudorandom permutation of [0, n): swap-or-not, ROUNDS rounds."""
    of = ", ".join(keys)
    other = f"pmod(pmod(xxhash64({SEED}, {of}, r), {n}) - x, {n})"
    swap = f"case when (xxhash64({SEED + 1}, {of}, r, greatest(x, {other})) & 1) = 1 then {other} else x end"
    return f"aggregate(sequence(1, {ROUNDS}), {index}, (x, r) -> {swap})"


def measured(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, source, h, size, ...) of documents; h is the text's hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("h"), sized("text").alias("size"), *more)


def placed(d: DataFrame, per: DataFrame, sums: DataFrame, chunks: int) -> DataFrame:
    """Measured documents with their source's figures and their place in its stream: sid, chunk, rn, start.

    Rows that agree in id, source and text are ties, and any order among them is as good.
    """
    d = d.join(F.broadcast(sums) if sums.count() <= 4096 else sums, d["source"].eqNullSafe(sums["source"])).drop(sums["source"])
    d = d.withColumn("chunk", chunk_of("doc_id", "h", chunks))
    d = d.selectExpr(
        "*",
        "row_number() over (partition by sid, chunk order by doc_id, h) as rn",
        "coalesce(sum(size) over (partition by sid, chunk order by doc_id, h rows between unbounded preceding and 1 preceding), 0L) as before",
    )
    return d.join(F.broadcast(per) if per.count() <= 65536 else per, ["sid", "chunk"]).withColumn("start", F.expr("base + before")).drop("base", "before", "h")


def sized(text: str):
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), 0)), F.lit(0)).cast("long")


def chunk_of(key: str, h: str, chunks: int):
    return F.pmod(F.xxhash64(F.lit(SEED), key, h), F.lit(chunks)).cast("int")


def mix(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> tuple[Callable[..., DataFrame], DataFrame, Scratch]:
    """(a function that places documents in the streams, slots of the mix, storage).

    ``place(*columns)``: doc_id, source, size, source_size, target, sid, start, chunk, rn and the columns of ``docs`` asked for.
    Texts are not stored on the way: what is summed is written without them.
    Slots: shard, position, sid, slot, epoch, block.
    """
    scratch = Scratch(spark, "mix")
    sizes = scratch.keep(measured(docs), "sizes")
    chunks = sizes.count() // CHUNK_ROWS + 1
    sums = scratch.keep(targets(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))), "targets")
    d = sizes.join(F.broadcast(sums) if sums.count() <= 4096 else sums, sizes["source"].eqNullSafe(sums["source"]))
    per = d.groupBy("sid", chunk_of("doc_id", "h", chunks).alias("chunk")).agg(F.sum("size").alias("chunk_size"))
    per = per.selectExpr("sid", "chunk", "coalesce(sum(chunk_size) over (partition by sid order by chunk rows between unbounded preceding and 1 preceding), 0L) as base")
    per = scratch.keep(per, "chunks")
    n = f"cast(ceil(source_size / {block}.0D) as bigint)"
    plan = sums.where("source_size > 0").selectExpr("sid", f"{n} as n", f"least(2 * {n}, cast(round(target * {n} / source_size) as bigint)) as slots")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // SLOTS_PER_SHARD))
    ranges = plan.where("slots > 0").select("sid", "n", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RANGE})")).alias("g"))
    ranges = ranges.repartition(parts(spark), "sid", "g")
    slots = ranges.select("sid", "n", F.explode(F.expr(f"sequence(g * {RANGE}, least(slots, (g + 1) * {RANGE}) - 1)")).alias("slot"))
    slots = slots.selectExpr("sid", "slot", "n", "slot div n as epoch", f"cast(pmod(xxhash64({SEED}, sid, slot, 'shard'), {shards}) as bigint) as shard")
    slots = slots.withColumn("position", F.expr(f"row_number() over (partition by shard order by xxhash64({SEED}, sid, slot, 'position'), sid, slot) - 1"))
    slots = slots.selectExpr("shard", "position", "sid", "slot", "epoch", f"{permuted('slot % n', 'n', 'sid', 'epoch')} as block")
    # without texts and rows there is nothing to read but the sizes
    return lambda *more: placed(measured(docs, *more) if more else sizes, per, sums, chunks), slots, scratch


def packed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sid, block, words, pieces) of all blocks; ``docs`` with their place and the text.

    ``words`` is the block's text, its words joined by blanks; ``pieces`` are the documents in it, in order, with the number of their words there.
    """
    # the array of words is bound by a lambda, so it is made once for a document
    first, last = f"greatest(0L, b * {block} - start)", f"least(size, (b + 1) * {block} - start)"
    piece = f"named_struct('block', b, 'part', struct(start + {first} as at, chunk, rn, {last} - {first} as n, array_join(slice(w, cast({first} + 1 as int), cast({last} - {first} as int)), ' ') as words))"
    pieces = f"flatten(transform(array(regexp_extract_all(text, {PATTERN}, 0)), w -> transform(sequence(start div {block}, (start + size - 1) div {block}), b -> {piece})))"
    at = docs.where("size > 0").select("sid", F.inline(F.expr(pieces)))
    at = at.groupBy("sid", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return at.selectExpr("sid", "block", "array_join(parts.words, ' ') as words", "transform(parts, p -> struct(p.chunk, p.rn, p.n)) as pieces")


def dealt(docs: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: (shard, position, sid, slot, epoch, block, words, pieces), a row for each slot."""
    return slots.join(packed(docs, block).hint("merge"), ["sid", "block"]).select("shard", "position", "sid", "slot", "epoch", "block", "words", "pieces")


def taken(docs: DataFrame, out: DataFrame) -> DataFrame:
    """Adds ``taken``: the words of each document in the mix ``out``, repeats counted."""
    got = out.select("sid", F.inline("pieces")).groupBy("sid", "chunk", "rn").agg(F.sum("n").alias("taken"))
    return docs.join(got, ["sid", "chunk", "rn"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, *more) -> DataFrame:
    """Documents with size, source_size, target, taken, and the columns ``more``; the mix itself is written on the way."""
    place, slots, scratch = mix(spark, docs)
    # written with their places, so that the texts' shuffle files are gone before the blocks are shuffled
    texts = place(F.col("text").cast("string").alias("text")).where("size > 0")
    texts = scratch.keep(texts.select("sid", "chunk", "rn", "start", "size", "text"), "placed")
    out = scratch.keep(dealt(texts, slots), "mix")
    scratch.drop(texts)
    return taken(place(*more), out)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of ``docs``, texts included, with size, source_size, target and taken; of clashing names the new column stays."""
    new = ["size", "source_size", "target", "taken"]
    out = mixed(spark, docs, F.struct("*").alias("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *new)
