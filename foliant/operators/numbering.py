"""Anchors, section trees and counters as running windows over document order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchors(blocks: DataFrame) -> DataFrame:
    """Adds ``anchor``: kind and a count for each kind, in order ``n``."""
    return blocks.selectExpr("*", "concat(kind, '-', row_number() over (partition by doc, kind order by n)) as anchor")


def section_numbers(heads: DataFrame, levels: int = 6) -> DataFrame:
    """Adds ``number``: dotted counters of headings (doc, n, level, numbered, appendix); levels not yet seen are left out.

    A level counts anew under each heading above it, numbered or not, and in the
    appendix all levels start again; its sections of level 1 are lettered,
    while those below show the decimal counter. Unnumbered headings do not count.
    """
    # one order for all: running counts outside (0) and inside the appendix (1), less those at the heading that the count is under
    w = "over (partition by doc order by n)"
    ks, parts = range(1, levels + 1), {0: "not coalesce(appendix, false)", 1: "coalesce(appendix, false)"}
    d = heads.selectExpr("*", *[f"count_if(numbered and level = {k} and {at}) {w} as a{k}_{p}" for k in ks for p, at in parts.items()])
    d = d.selectExpr("*", *[f"last(case when level < {k} then a{k}_{p} end, true) {w} as b{k}_{p}" for k in ks[1:] for p in parts])
    count = {k: "case when coalesce(appendix, false) then " + " else ".join(f"a{k}_{p}" + (f" - coalesce(b{k}_{p}, 0L)" if k > 1 else "") for p in (1, 0)) + " end" for k in ks}
    made = [c for c in d.columns if c not in heads.columns]
    d = d.selectExpr("*", *[f"{count[k]} as c{k}" for k in ks])
    shown = [f"case when level >= {k} and c{k} > 0 then {f'case when level = 1 and appendix then chr(64 + cast(c1 as int)) else cast(c1 as string) end' if k == 1 else f'cast(c{k} as string)'} end" for k in ks]
    return d.selectExpr("*", f"case when numbered then concat_ws('.', {', '.join(shown)}) end as number").drop(*made, *[f"c{k}" for k in ks])


def section_parents(heads: DataFrame) -> DataFrame:
    """(doc, n, parent): the nearest heading before with a smaller level, else 0; a fold with a stack for each document."""
    packed = heads.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "level"))).alias("xs"))
    kind = "struct<n:bigint,level:int>"
    step = (
        "named_struct('stack', array_append(filter(a.stack, s -> s.level < x.level), named_struct('n', cast(x.n as bigint), 'level', x.level)), "
        "'out', array_append(a.out, named_struct('n', cast(x.n as bigint), 'parent', coalesce(try_element_at(filter(a.stack, s -> s.level < x.level), -1).n, 0L))))"
    )
    start = f"named_struct('stack', cast(array() as array<{kind}>), 'out', cast(array() as array<struct<n:bigint,parent:bigint>>))"
    return packed.select("doc", F.expr(f"inline(aggregate(xs, {start}, (a, x) -> {step}, a -> a.out))"))


def captioned_numbers(blocks: DataFrame) -> DataFrame:
    """Adds ``number`` to blocks with a caption: a count for each kind."""
    return blocks.selectExpr("*", "case when captioned then cast(count_if(captioned) over (partition by doc, kind order by n) as bigint) end as number")


def equation_numbers(rows: DataFrame, within_sections: bool = False) -> DataFrame:
    """Adds ``number`` to equation rows (doc, n, row, numbered, section): counted, within level-1 sections if asked."""
    part = "doc, section" if within_sections else "doc"
    shown = "concat(section, '.', k)" if within_sections else "cast(k as string)"
    d = rows.selectExpr("*", f"count_if(numbered) over (partition by {part} order by n, row) as k")
    return d.selectExpr("*", f"case when numbered then concat('(', {shown}, ')') end as number").drop("k")


def label_targets(events: DataFrame) -> DataFrame:
    """Labels (kind = 'label') bound to the nearest numberable block before them; null if none."""
    d = events.selectExpr("*", "last(case when kind <> 'label' and numberable then n end, true) over (partition by doc order by n rows between unbounded preceding and 1 preceding) as target")
    return d.where("kind = 'label'").select("doc", "n", "target")
