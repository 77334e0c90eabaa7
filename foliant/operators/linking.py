"""Citations, cross references and splices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marker of numeric citations, the words of references, and the limits.
CITE = r"\[(\d{1,3}(?:\s*[,;]\s*\d{1,3})*(?:\s*[-–]\s*\d{1,3})?)\]"
STRUCTURAL = {
    "eq": r"(?i)\b(?:Eq\.?|Equation)\s*\(?([0-9]+[a-z]?)\)?",
    "fig": r"(?i)\b(?:Fig\.?|Figure)\s*([0-9]+[a-z]?)",
    "tab": r"(?i)\b(?:Table|Tab\.?)\s*([0-9]+)",
    "sec": r"(?i)(?:\b(?:Sec\.?|Section)\s*|§\s*)([0-9]+(?:\.[0-9]+)*)",
}
MOST_IDS = 50
LEAST_POINTS = 40.0


def matches(texts: DataFrame, pattern: str) -> DataFrame:
    """(id, marker, found, start, end): a row for each match of ``pattern`` in ``text``; its first group and its span.

    The pieces between matches give the places, so texts stay in the JVM.
    """
    d = texts.select("id", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("whole"), F.regexp_extract_all("text", F.lit(pattern), 1).alias("groups"))
    d = d.where("size(whole) > 0").selectExpr("id", "posexplode(arrays_zip(gaps, whole, groups)) as (marker, m)").where("m.whole is not null")
    w = "over (partition by id order by marker rows between unbounded preceding and current row)"
    d = d.selectExpr("id", "marker", "m.groups as found", f"cast(sum(length(m.gaps) + length(m.whole)) {w} as int) as end", "length(m.whole) as n")
    return d.selectExpr("id", "marker", "found", "end - n as start", "end")


def cite_numbers(texts: DataFrame) -> DataFrame:
    """(id, marker, k, number, start, end) of numeric citations in ``text``, k in the order of the marker.

    A range expands to MOST_IDS numbers at most, and so does a marker (the format's limit); a
    range that descends gives none.
    """
    d = matches(texts, CITE).select("id", "marker", "start", "end", F.posexplode(F.split("found", "[,;]")).alias("piece", "part"))
    d = d.selectExpr("*", r"cast(regexp_extract(part, '^\\s*(\\d+)', 1) as int) as lo", r"cast(regexp_extract(part, '(\\d+)\\s*$', 1) as int) as hi")
    d = d.where("hi >= lo").select("id", "marker", "start", "end", "piece", F.explode(F.expr(f"sequence(lo, least(hi, lo + {MOST_IDS - 1}))")).alias("number"))
    d = d.selectExpr("id", "marker", "row_number() over (partition by id, marker order by piece, number) as k", "number", "start", "end")
    return d.where(F.col("k") <= MOST_IDS)


def cite_links(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """(id, marker, start, end, bib_ids): markers of which every number is known, ids as cited; the others are left as text."""
    j = cites.join(bib.select(F.col("number"), "bib_id"), "number", "left")
    g = j.groupBy("id", "marker", "start", "end").agg(F.count_if(F.col("bib_id").isNull()).alias("missing"), F.array_sort(F.collect_list(F.struct("k", "bib_id"))).alias("ids"))
    return g.where("missing = 0").selectExpr("id", "marker", "start", "end", "ids.bib_id as bib_ids")


def structural_refs(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, kind, number, target, start, end) of references to known (kind, number) targets, without overlaps."""
    found = None
    for kind, pattern in STRUCTURAL.items():
        one = matches(texts, pattern).select("id", F.lit(kind).alias("kind"), F.col("found").alias("number"), "start", "end")
        found = one if found is None else found.unionByName(one)
    known = found.join(targets, ["kind", "number"]).select("id", "kind", "number", "target", "start", "end")
    return known.join(non_overlapping(known), ["id", "start", "end"], "left_semi")


def non_overlapping(spans: DataFrame) -> DataFrame:
    """(id, start, end) kept by a greedy pass over (start, longest first); spans are [start, end), empty ones go."""
    packed = spans.where("end > start").groupBy("id").agg(F.array_sort(F.collect_list(F.expr("struct(start, -(end - start) as shorter, end)"))).alias("xs"))
    fold = "aggregate(xs, cast(array() as array<struct<start:int,end:int>>), (a, x) -> case when size(a) = 0 or x.start >= try_element_at(a, -1).end then array_append(a, named_struct('start', x.start, 'end', x.end)) else a end)"
    return packed.select("id", F.expr(f"inline({fold})"))


def apply_splices(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, seq, piece, spliced): the text between spans and the spans themselves, in order; empty pieces left out.

    Spans that overlap or reach beyond the text are an error.
    """
    s = spans.selectExpr("*", "coalesce(lag(end) over (partition by id order by start), 0) as before")
    last = spans.groupBy("id").agg(F.max("end").alias("before"))
    gaps = s.selectExpr("id", "before as start", "start as end", "before", "false as spliced").unionByName(s.selectExpr("id", "start", "end", "before", "true as spliced"))
    rest = texts.join(last, "id", "left").selectExpr("id", "coalesce(before, 0) as start", "length(text) as end", "0 as before", "false as spliced")
    d = gaps.unionByName(rest).where("end > start").join(texts, "id")
    return d.selectExpr("id", "cast(row_number() over (partition by id order by start) as bigint) as seq", "case when start < 0 or end > length(text) or spliced and start < before then raise_error('spans overlap or leave the text') else substring(text, start + 1, end - start) end as piece", "spliced")


def reference_text(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, shown): references (id, seq, label, form) by their targets (label, kind, number); unknown ones show ??.

    form: ref shows the number, eqref wraps it, cref names the kind; more than
    one label in a cref takes the plural of the first kind's word.
    """
    word = "case kind when 'eq' then 'Eq.' when 'fig' then 'Fig.' when 'tab' then 'Table' when 'fn' then 'Footnote' else 'Section' end"
    j = refs.join(targets, "label", "left").selectExpr("id", "seq", "form", "number", f"{word} as word")
    g = j.groupBy("id", "form").agg(F.array_sort(F.collect_list(F.struct("seq", "word", "number"))).alias("xs"))
    shown = "array_join(transform(xs, x -> coalesce(case when form = 'eqref' then concat('(', x.number, ')') else x.number end, '??')), ', ')"
    name = "case when size(xs) > 1 then concat(rtrim('.', xs[0].word), 's.') else xs[0].word end".replace("rtrim('.', xs[0].word)", "trim(trailing '.' from xs[0].word)")
    return g.selectExpr("id", "form", f"case when form = 'cref' then concat({name}, ' ', {shown}) else {shown} end as shown")


def pair_regions(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, id, block, rank, l, b, r, t, missing): the region of each caption on its page.

    A linked block, else the largest beside, else the largest that begins at or over the caption's top, wherever it
    lies across. Boxes are l, b, r, t with the origin at the bottom; beside means that the
    vertical ranges overlap. A region of under LEAST_POINTS either way, or none, is missing.
    The page is the equality key, so pages are paired on their own.
    """
    c = captions.select("doc", "page", "id", "linked", *[F.col(x).alias(f"c{x}") for x in "lbrt"])
    j = c.join(blocks.select("doc", "page", "block", *"lbrt"), ["doc", "page"]).where("block <> id").selectExpr(
        "*", "(r - l) * (t - b) as area",
        "case when block = linked then 0 when b < ct and t > cb and (r <= cl or l >= cr) then 1 when b >= ct then 2 end as rank",
    )
    best = j.where("rank is not null").groupBy("doc", "page", "id").agg(F.min(F.struct("rank", (-F.col("area")).alias("minus"), "block", *"lbrt")).alias("x"))
    out = c.select("doc", "page", "id").join(best, ["doc", "page", "id"], "left")
    return out.select("doc", "page", "id", *[F.col(f"x.{k}").alias(k) for k in ("block", "rank", *"lbrt")], F.expr(f"x is null or x.r - x.l < {LEAST_POINTS} or x.t - x.b < {LEAST_POINTS}").alias("missing"))
