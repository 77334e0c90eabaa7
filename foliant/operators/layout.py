"""Lines, blocks, columns, segments and reading order. Everything partitions by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_key(line: Column) -> Column:
    """A running line's identity: folded case, digits as #, one blank for white space."""
    folded = F.regexp_replace(F.lower(line), "ß", "ss")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"\d+", "#"), r"[ \t\n\x0B\f\r]+", " "))


def line_band(bottom: Column, points: float = 6.0) -> Column:
    """The band of the page that a line stands in; halves go to the even one."""
    return F.rint(bottom / points).cast("long")


def repeated_keys(lines: DataFrame, share: float = 0.6, least_pages: int = 4) -> DataFrame:
    """(doc, key, band, n_pages) of lines (doc, page, line, bottom) on at least ``share`` of a document's pages, in one band.

    The page count of a document is joined back; counts combine on the map side.
    """
    keyed = lines.select("doc", "page", line_key(F.col("line")).alias("key"), line_band(F.col("bottom")).alias("band"))
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    hits = keyed.distinct().groupBy("doc", "key", "band").agg(F.count("*").alias("n_pages"))
    return hits.join(pages, "doc").where(F.col("n_pages") >= share * F.col("pages")).select("doc", "key", "band", "n_pages")


def strip_repeated(lines: DataFrame, share: float = 0.6, least_pages: int = 4) -> DataFrame:
    """Lines without the running ones."""
    keyed = lines.withColumn("key", line_key(F.col("line"))).withColumn("band", line_band(F.col("bottom")))
    return keyed.join(repeated_keys(lines, share, least_pages).select("doc", "key", "band"), ["doc", "key", "band"], "left_anti").drop("key", "band")


def blocks(lines: DataFrame, gap: float = 1.8, font_jump: float = 0.25) -> DataFrame:
    """Adds ``block``, the number of a line's block within its page and column.

    Lines: (doc, page, col, seq, top, bottom, height, font). A block ends when the
    vertical gap exceeds ``gap`` times the page's median line height, or the font
    changes by more than ``font_jump`` of the larger one.
    """
    med = lines.groupBy("doc", "page").agg(F.median("height").alias("median_height"))
    d = lines.join(med, ["doc", "page"])
    w = "over (partition by doc, page, col order by seq)"
    d = d.selectExpr("*", f"lag(bottom) {w} as p_bottom", f"lag(font) {w} as p_font")
    d = d.withColumn(
        "cut",
        F.expr(f"case when p_bottom is null then 0 when p_bottom - top > {gap}D * median_height or abs(font - p_font) > {font_jump}D * greatest(font, p_font) then 1 else 0 end"),
    )
    return d.selectExpr("*", f"sum(cut) {w} as block").drop("p_bottom", "p_font", "cut")


def merge_paragraphs(rows: DataFrame, gap: float = 2.5) -> DataFrame:
    """(doc, merged array<struct<first,members,text>>) by a fold over each document's paragraphs in order.

    The gap is measured from the first block of the group, in line heights of one point at least;
    on another page a paragraph goes on if the text so far has no closing punctuation. Hyphens at
    joins are repaired, other joins take one blank. Rows: (doc, n, page, top, bottom, height, text)
    and, if there is one, ``role``: other blocks than paragraphs are passed over and divide nothing.
    """
    if "role" in rows.columns:
        rows = rows.where("role = 'paragraph'")
    packed = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "page", "top", "bottom", "height", "text"))).alias("xs"))
    same = f"(x.page = last.page and last.bottom - x.top < {gap}D * greatest(last.height, x.height, 1.0D))"
    # fixed value: the endings that close a paragraph
    over = r"(x.page <> last.page and not last.text rlike '(?:[.!?]|\\.[\\x22\\x27])\\s*\\z')"
    glued = r"case when last.text rlike '[a-z]-$' and x.text rlike '^[a-z]' then concat(substring(last.text, 1, length(last.text) - 1), x.text) else concat(regexp_replace(last.text, '\\s+\\z', ''), ' ', regexp_replace(x.text, '^\\s+', '')) end"
    new = "named_struct('first', x.n, 'members', 1, 'page', x.page, 'bottom', x.bottom, 'height', x.height, 'text', x.text)"
    # the accumulator holds the closed paragraphs and the open one
    step = (
        f"case when last is null then named_struct('done', acc.done, 'last', {new}) "
        f"when {same} or {over} then named_struct('done', acc.done, 'last', named_struct('first', last.first, 'members', last.members + 1, 'page', last.page, 'bottom', last.bottom, 'height', last.height, 'text', {glued})) "
        f"else named_struct('done', array_append(acc.done, last), 'last', {new}) end"
    ).replace("last.", "acc.last.").replace("acc.acc.", "acc.").replace("when last is null", "when acc.last is null").replace("(acc.done, last)", "(acc.done, acc.last)")
    kind = "struct<first:bigint,members:int,page:bigint,bottom:double,height:double,text:string>"
    start = f"named_struct('done', cast(array() as array<{kind}>), 'last', cast(null as {kind}))"
    return packed.select("doc", F.expr(f"aggregate(xs, {start}, (acc, x) -> {step}, acc -> array_append(acc.done, acc.last))").alias("merged"))


def occupancy(lines: DataFrame, lo: int, hi: int) -> DataFrame:
    """(doc, page, total, first, stop, n): lines over each stretch of units of [lo, hi) between two line ends; (doc, page, lo, hi) in, hi exclusive.

    A running sum of line beginnings and ends, so a line is three rows at most, however wide. Pages whose
    lines are all empty have one stretch without any; total counts these lines too.
    """
    turn = lambda at, by, line: f"named_struct('first', cast(least(greatest({at}, {lo}), {hi}) as int), 'turn', {by}L, 'line', {line}L)"
    # as in a join by name, lines of a page without a document or number are counted but take no room
    ends = f"case when hi > lo and doc is not null and page is not null then array({turn('lo', 1, 1)}, {turn('hi', -1, 0)}, {turn(lo, 0, 0)}) else array({turn(lo, 0, 1)}) end"
    turns = lines.select("doc", "page", F.expr(f"inline({ends})")).groupBy("doc", "page", "first").agg(F.sum("turn").alias("turn"), F.sum("line").alias("line"))
    w = "over (partition by doc, page order by first)"
    d = turns.selectExpr("doc", "page", "first", f"lead(first, 1, {hi}) {w} as stop", f"sum(turn) {w} as n", "sum(line) over (partition by doc, page) as total")
    return d.where("first < stop")


def valleys(held: DataFrame, least: int, share: float = 0.02) -> DataFrame:
    """(doc, page, first, last): runs of at least ``least`` thin units, from stretches as ``occupancy`` gives them.

    Thin: no more than max(1, share of the page's lines).
    """
    thin = held.selectExpr("*", f"n > greatest(1.0D, {share}D * total) as thick")
    runs = thin.selectExpr("*", "count_if(thick) over (partition by doc, page order by first) as g").where("not thick")
    runs = runs.groupBy("doc", "page", "g").agg(F.min("first").alias("first"), (F.max("stop") - 1).alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= least).select("doc", "page", "first", "last")


def columns(lines: DataFrame, step: int = 8, least_lines: int = 20) -> DataFrame:
    """(doc, page, seq, col, warning) of lines (doc, page, width, seq, l, r) by the one gap that divides a page in two.

    Occupancy over steps of the page's width is a running sum of line beginnings and ends. A gap has at
    most 2 % of the lines (one at least), three steps, and its middle in the central 40 % of the page. Pages of
    fewer lines, without a gap or with under 60 % of the lines beside it are one column; of two columns, lines that
    cross the gap are left out; several gaps are told of.
    """
    d = lines.selectExpr("*", f"cast(floor(width / {step}) as int) as last", f"cast(greatest(0, floor(l / {step})) as int) as lo", f"cast(floor(r / {step}) as int) as hi")
    d = d.withColumn("hi", F.least("hi", "last"))
    total = d.groupBy("doc", "page").agg(F.count("*").alias("n"), F.max("last").alias("last"), F.max("width").alias("width"))
    turns = d.where("hi >= lo").selectExpr("doc", "page", "lo as bin", "1 as turn").union(d.where("hi >= lo").selectExpr("doc", "page", "hi + 1", "-1")).union(total.selectExpr("doc", "page", "0", "0"))
    turns = turns.groupBy("doc", "page", "bin").agg(F.sum("turn").alias("turn")).join(total.where(f"n >= {least_lines} and width > 0"), ["doc", "page"]).where("bin <= last")
    w = "over (partition by doc, page order by bin)"
    runs = turns.selectExpr("*", f"sum(turn) {w} as held", f"coalesce(lead(bin) {w}, last + 1) as stop").selectExpr("*", "held <= greatest(1, floor(n * 0.02)) as thin")
    runs = runs.selectExpr("*", f"sum(cast(not thin as int)) {w} as island").where("thin").groupBy("doc", "page", "n", "width", "island").agg(F.min("bin").alias("first"), F.max("stop").alias("stop"))
    middle = f"(first + stop) * {step / 2}D"
    gaps = runs.where(f"stop - first >= 3 and {middle} between width * 0.3D and width * 0.7D").groupBy("doc", "page").agg(F.count("*").alias("gaps"), F.min(F.expr(middle)).alias("valley"))
    d = d.join(gaps, ["doc", "page"], "left").selectExpr("*", "case when gaps = 1 and r <= valley then 0 when gaps = 1 and l >= valley then 1 end as side")
    w = "over (partition by doc, page)"
    d = d.selectExpr("*", f"gaps = 1 and count(side) {w} / count(*) {w} >= 0.6D as two")
    d = d.where("not coalesce(two, false) or side is not null")
    return d.selectExpr("doc", "page", "seq", "case when two then side else 0 end as col", "case when gaps > 1 then 'layout-columns-unhandled' end as warning")


def page_batches(pages: DataFrame, size: int = 8) -> DataFrame:
    """Adds ``batch``: distinct pages of a document in order, ``size`` at a time."""
    return pages.selectExpr("*", f"cast((dense_rank() over (partition by doc order by page) - 1) div {size} as bigint) as batch")


def reconcile_order(rows: DataFrame) -> DataFrame:
    """Adds ``place``: the proposed position first, then blocks without one in geometric order."""
    return rows.selectExpr("*", "row_number() over (partition by doc order by proposed is null, proposed, geometric) as place")


def role_rules(rows: DataFrame) -> DataFrame:
    """Adds ``final_role``: a title after page 2 is a heading; a further abstract is a paragraph."""
    d = rows.selectExpr("*", "row_number() over (partition by doc, role order by n) as nth")
    return d.selectExpr("*", "case when role = 'title' and page > 2 then 'heading' when role = 'abstract' and nth > 1 then 'paragraph' else role end as final_role").drop("nth")
