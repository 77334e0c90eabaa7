"""Operator 2: conversations from reply trees, in DataFrame operations only.

Messages form trees by parent id. Self-joins that double the distance climbed
(pointer jumping) enumerate root-to-leaf paths in log2(depth) rounds; branches
are ranked by the sum of their messages' scores, and each chosen path becomes
one formatted conversation::

    <s>[role]text</s><s>[role]text</s>...

Inside roles and texts ``\\``, ``<``, ``[`` and ``]`` become ``\\e``, ``\\l``, ``\\b``
and ``\\r``, so no control string can occur in them, and the text comes back
exactly. ``spans`` holds, for each turn, the code points [start, end) of the
assistant texts (the loss mask), or null.

Defined cases: null text or role counts as empty; a message whose parent is
missing is a root; repeated message ids are told apart by the caller (the query
numbers rows); messages on a parent cycle have no root and give no path; empty
tables give empty results. One path is one string, so one conversation must fit
in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tree_paths(messages: DataFrame, branches: int | None, scratch: Scratch) -> DataFrame:
    """(tree, leaf, place, node) of the best ``branches`` root-to-leaf paths of each tree.

    ``messages``: (tree, node, parent, score), node unique and not null. Equal
    scores are decided by the smaller leaf. None takes all branches.
    """
    nodes = messages.select("node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("node").alias("parent"))
    links = nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"))
    state = nodes.select("node", "score").join(links, "node", "left").select("node", "up", F.lit(1).cast("long").alias("size"), F.col("score").alias("total"))
    state = scratch.keep(state, "climb")
    # only messages that have not reached their root climb on
    finished, climbing = state.where("up is null"), state.where("up is not null")
    jumps = []
    most = max(1, state.count()).bit_length() + 1
    while len(jumps) <= most and not climbing.isEmpty():
        jumps.append(climbing.select("node", "up"))
        above = finished.union(climbing).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("size").alias("s2"), F.col("total").alias("t2"))
        moved = climbing.join(above, "up", "left").select(
            "node",
            F.col("up2").alias("up"),
            (F.col("size") + F.coalesce("s2", F.lit(0))).alias("size"),
            (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"),
        )
        moved = scratch.keep(moved, "climb")
        finished, climbing = finished.union(moved.where("up is null")), moved.where("up is not null")
    leaves = finished.join(nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    leaves = leaves.join(messages.select("tree", "node"), "node").select("tree", F.col("node").alias("leaf"), "size", "total")
    if branches == 1:
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("t"), "leaf", "size")).alias("b"))
        leaves = best.select("tree", F.col("b.leaf").alias("leaf"), F.col("b.size").alias("size"))
    elif branches is not None:
        # Spark keeps the first rows of each task before it shuffles (window group limit)
        leaves = leaves.selectExpr("*", "row_number() over (partition by tree order by total desc, leaf) as rank").where(f"rank <= {branches}").drop("rank")
    path = scratch.keep(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.col("size").alias("place")), "paths")
    for k, jump in enumerate(jumps):
        up = path.join(jump, "node").select("tree", "leaf", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        path = scratch.keep(path.union(up), "paths")
    return path.select("tree", "leaf", "place", "node")


def format_paths(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, spans) from (tree, leaf, place, role, text)."""
    made = turns.select("tree", "leaf", "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = made.select("tree", "leaf", "place", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    made = made.selectExpr("tree", "leaf", "place", "role", "length(text) as size", "concat('<s>[', role, ']', text, '</s>') as piece")
    # where a turn starts: running sums, linear in the turns of a path; the aggregate below keeps their partitioning
    made = made.selectExpr("*", "coalesce(sum(length(piece)) over (partition by tree, leaf order by place rows between unbounded preceding and 1 preceding), 0L) as at")
    made = made.selectExpr("*", "at + length(piece) - 4 as until")
    turn = "struct(place, piece, case when role = 'assistant' then named_struct('start', until - size, 'end', until) end as span) as turn"
    made = made.selectExpr("tree", "leaf", turn).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return made.select("tree", "leaf", F.concat_ws("", "turns.piece").alias("formatted"), F.col("turns.span").alias("spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its mask say.

    One split at the end mark (which no text can hold) keeps the reading linear;
    a turn's text ends where its part ends, so the part's last ``end - start`` code
    points are what its span masks.
    """
    d = chats.withColumn("parts", F.expr("slice(split(formatted, '</s>'), 1, size(split(formatted, '</s>')) - 1)"))
    d = d.withColumn("roles", F.expr("transform(parts, p -> substring(p, 5, locate(']', p) - 5))"))
    d = d.withColumn("texts", F.expr("transform(parts, p -> substring(p, locate(']', p) + 1))"))
    d = d.withColumn("roles", F.transform("roles", unescape)).withColumn("masked", F.expr("zip_with(parts, spans, (p, s) -> case when s is not null then substring(p, cast(length(p) - (s.end - s.start) + 1 as int)) end)"))
    d = d.withColumn("texts", F.transform("texts", unescape)).withColumn("masked", F.transform(F.expr("filter(masked, t -> t is not null)"), unescape))
    return d.select(
        "tree",
        "leaf",
        F.size("parts").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.expr("zip_with(roles, texts, (r, t) -> concat(r, '\\n', t, '\\n'))")), 256).alias("turns_sha256"),
        F.length(F.concat_ws("", "masked")).cast("long").alias("loss_chars"),
        F.sha2(F.concat_ws("", "masked"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) of linear conversations (conv_id, turn, role, text).

    Each row answers the one before it; equal turns are ordered by role and text.
    """
    scratch = Scratch(spark, "chat")
    numbered = rows.selectExpr(
        "conv_id", "role", "text",
        "row_number() over (partition by conv_id order by turn, role, text) as n",
    )
    numbered = scratch.keep(
        numbered.selectExpr("*", "coalesce(cast(conv_id as string), 'null') as tree").selectExpr(
            "conv_id", "role", "text", "tree", "concat(tree, '#', n) as node", "case when n > 1 then concat(tree, '#', n - 1) end as parent", "0.0D as score"
        ),
        "messages",
    )
    paths = tree_paths(numbered, 1, scratch)
    turns = paths.join(numbered.select("node", "role", "text"), "node")
    chats = scratch.keep(format_paths(turns), "chats")
    names = numbered.where("parent is null").select("tree", "conv_id")
    return chats.join(names, "tree")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    chats = format_conversations(spark, rows.union(extra))
    names = chats.select("tree", "conv_id")
    return read_back(chats).join(names, "tree").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(9 + length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\\\<\\[\\]]', '', 'g'))) + count(*) * 0 AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
