"""Inputs, conversion plans, fallbacks, quality gates and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier grammars, hosts, plans, codes and phrases.
NEW_ID, OLD_ID = r"\d{4}\.\d{4,5}", r"[a-z][a-z-]*(?:\.[A-Z]{2})?/\d{7}"
HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")
PLANS = {"arxiv": ["arxiv-html", "latex", "pdf"], "latex-local": ["latex"], "pdf-local": ["pdf"]}
TERMINAL = ("security", "cost-limit")
EXIT = {"usage": 2, "input": 3, "fetch": 4, "conversion": 5, "engines": 5, "llm": 6, "cost": 7, "config": 8, "security": 9, "exists": 10}
REASONS = (
    "html-unavailable", "html-stub", "html-no-content", "html-missing-title", "html-low-quality", "pandoc-missing",
    "eprint-is-pdf-only", "no-main-tex", "offline-uncached", "llm-not-configured", "cost-declined",
)
STUBS = ("HTML is not available for this paper", "conversion is pending", "conversion pending")


def resolve(raw: Column) -> Column:
    """struct(kind, paper, version) of a raw input; kind is null if unrecognised.

    A page of one of the hosts must name an identifier; other web addresses are not
    inputs. Names with a known ending are local files, whose existence the driver tests.
    """
    web = r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)(?::\d*)?(/[^?#]*)"
    is_web = raw.rlike(r"(?i)^https?:")
    path = F.regexp_extract(raw, web, 2)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    page = F.regexp_extract(path, r"^/(abs|pdf|html)/(.*)$", 1)
    named = F.regexp_extract(path, r"^/(abs|pdf|html)/(.*)$", 2)
    named = F.when(page == "pdf", F.regexp_replace(named, r"(?i)\.pdf$", "")).otherwise(named)
    known = F.lower(F.regexp_extract(raw, web, 1)).isin(*HOSTS)
    plain = F.regexp_replace(F.when(is_web, F.when(known & (page != ""), named).otherwise("")).otherwise(raw), r"^(?i:arxiv):", "")
    is_id = plain.rlike(rf"^(?:{NEW_ID}|{OLD_ID})(?:v\d+)?\z")
    local = ~is_web & ~is_id
    kind = F.when(is_id, "arxiv").when(local & F.lower(raw).rlike(r"\.pdf$"), "pdf-local").when(local & F.lower(raw).rlike(r"\.(tex|tar|tgz|gz)$"), "latex-local")
    paper = F.when(is_id, F.regexp_replace(plain, r"v\d+$", ""))
    version = F.when(is_id & plain.rlike(r"v\d+$"), F.regexp_extract(plain, r"v(\d+)$", 1).cast("int"))
    return F.struct(kind.alias("kind"), paper.alias("paper"), version.alias("version"))


def slug(kind: Column, paper: Column, version: Column, raw: Column) -> Column:
    """A file name for an input; each unsafe character gives way to one hyphen. Null for what is no input."""
    name = F.regexp_extract(raw, r"([^/]*)$", 1)
    stem = F.when(F.lower(name).rlike(r"\.(tar\.gz|tgz)$"), F.regexp_replace(name, r"(?i)\.(tar\.gz|tgz)$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))
    made = F.when(kind == "arxiv", F.concat(F.lit("arxiv-"), F.replace(paper, F.lit("/"), F.lit("-")), F.coalesce(F.concat(F.lit("v"), version), F.lit("")))).otherwise(stem)
    return F.when(kind.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(made, r"[^A-Za-z0-9._-]", "-"), F.lit("")), F.lit("paper")))


def plan(kind: Column, engine: Column | None = None) -> Column:
    """Engines to try for an input's kind; a forced one alone, or null if it can't take the kind ('auto' forces none)."""
    out = F.lit(None)
    for k, engines in PLANS.items():
        out = F.when(kind == k, F.array(*[F.lit(e) for e in engines])).otherwise(out)
    if engine is None:
        return out
    return F.when(engine == "auto", out).when(F.array_contains(out, engine), F.array(engine))


def first_success(attempts: DataFrame) -> DataFrame:
    """(doc, winner, stopped, notes): attempts (doc, ord, engine, ok, code) in plan order.

    The first success wins; failures before it are notes. A terminal code before
    any success stops the plan.
    """
    g = attempts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "engine", "ok", "code"))).alias("xs"))
    terminal = ", ".join(f"'{t}'" for t in TERMINAL)
    g = g.withColumn("at", F.expr(f"try_element_at(filter(xs, x -> x.ok or x.code in ({terminal})), 1)"))
    return g.selectExpr(
        "doc", "case when at.ok then at.engine end as winner", "coalesce(not at.ok, false) as stopped",
        "transform(filter(xs, x -> not x.ok and (at is null or x.ord < at.ord)), x -> named_struct('engine', x.engine, 'reason', x.code)) as notes",
    )


def reason(code: Column, engine: Column | None = None, error: Column | None = None) -> Column:
    """Why an engine was passed over: by its error's type (fetch, llm, config or conversion) where that decides, else by the code."""
    own = F.when(code.isin(*REASONS), code).otherwise(F.concat(F.lit("convert-failed:"), code))
    if engine is None or error is None:
        return own
    raised = F.concat(F.lit("convert-failed:"), code)
    fetch = F.when(engine == "arxiv-html", "html-unavailable").otherwise(raised)
    model = F.when(engine == "pdf", "llm-not-configured").otherwise(raised)
    return F.when(error == "fetch", fetch).when(error.isin("llm", "config"), model).otherwise(own)


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\x0B\f\r]+", " "))


def quality_gate(pages: DataFrame, content: str = "ltx_(?:section|para)", errors: str = "ltx_(?:ERROR|missing)") -> DataFrame:
    """Adds ok, reason, markers, text_kb for each page's ``html``; checks in fixed order.

    Markers, elements with an error class, are counted on pages that pass the checks before.
    """
    attribute = lambda name: rf"""(?is)<[a-z][^>]*?\sclass\s*=\s*["']?[^"'>]*{name}"""
    d = pages.withColumn("shown", visible_text(F.col("html")))
    titles = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<title\b[^>]*>(.*?)</title\s*>"), 1), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), r"[ \t\n\x0B\f\r]+", " ")))
    stub = F.lit(False)
    for phrase in STUBS:
        stub = stub | F.lower("shown").contains(phrase.lower())
    early = (
        F.when(stub, "html-stub")
        .when(~F.col("html").rlike(attribute(rf'''(?<![^\s"'=]){content}(?![^\s"'>])''')), "html-no-content")
        .when(~F.exists(titles, lambda t: t != ""), "html-missing-title")
    )
    d = d.withColumn("text_kb", F.floor(F.length("shown") / 1024).cast("long")).withColumn("early", early)
    d = d.withColumn("markers", F.when(F.col("early").isNull(), F.regexp_count("html", F.lit(attribute(errors)))).otherwise(0).cast("long"))
    low = F.when(F.col("markers") > F.greatest(F.lit(20.0), F.col("text_kb") / 2), "html-low-quality")
    return d.withColumn("reason", F.coalesce("early", low)).withColumn("ok", F.col("reason").isNull()).drop("shown", "early")


def inventory(files: DataFrame) -> DataFrame:
    """(id, version, kinds, bytes) of cached files (id, version, kind, bytes); temporary files don't count."""
    return files.where("kind not like '%.tmp'").groupBy("id", "version").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("bytes").alias("bytes"))


def promote(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def layered(layers: DataFrame) -> DataFrame:
    """(key, value): the value of the highest layer that has one."""
    return layers.where("value is not null").groupBy("key").agg(F.max_by("value", "layer").alias("value"))


def image_type(data: Column) -> Column:
    """By the first bytes: an XML prolog may come before an svg element, a comment may not."""
    head = F.hex(F.substring(data, 1, 8))
    text = F.decode(F.substring(data, 1, 4096), "ISO-8859-1")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(text.rlike(r"^\s*(?:<\?xml(?s:.*?)\?>\s*)?<svg"), "svg")
    )


def png_size(data: Column) -> Column:
    n = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A", F.struct(n(17).alias("width"), n(21).alias("height")))
