"""Referential integrity and row invariants of document trees, as joins and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMES = ("https", "http", "mailto")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def allowed_scheme(url: Column) -> Column:
    return scheme(url).isin(*SCHEMES)


def duplicates(anchors: DataFrame) -> DataFrame:
    """(doc, id, n) of anchors that occur more than once."""
    return anchors.groupBy("doc", "id").agg(F.count("*").alias("n")).where("n > 1")


def dangling(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """References (doc, target, ...) whose target is no anchor (doc, id); empty targets are another matter."""
    known = anchors.select("doc", F.col("id").alias("target")).distinct()
    return refs.where("target <> ''").join(known, ["doc", "target"], "left_anti")


def orphans(owned: DataFrame, refs: DataFrame) -> DataFrame:
    """Owned rows (doc, id) that no reference (doc, target) names."""
    return owned.join(refs.select("doc", F.col("target").alias("id")).distinct(), ["doc", "id"], "left_anti")


def equation_rule(d: DataFrame) -> DataFrame:
    """Adds ``rule``, the first invariant that an equation row breaks, or null."""
    return d.withColumn(
        "rule",
        F.expr(
            "case when confidence is not null and (confidence < 0 or confidence > 1) then 'confidence-range' "
            "when content_kind = 'latex' and (latex is null or not verified or asset_id is not null) then 'latex-content' "
            "when content_kind = 'image' and (asset_id is null or verified) then 'image-content' end"
        ),
    )


def table_rule(d: DataFrame) -> DataFrame:
    return d.withColumn("rule", F.expr("case when content_kind = 'grid' and rows is null then 'grid-content' when content_kind = 'image' and asset_id is null then 'image-content' end"))


def valid_base64(text: Column) -> Column:
    """Non-empty, padded, and decodable."""
    return F.coalesce((F.length(text) > 0) & (F.length(text) % 4 == 0) & text.rlike("^[A-Za-z0-9+/]+={0,2}$"), F.lit(False))
