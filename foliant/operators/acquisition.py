"""Metadata, sources and their choice, availability, retries and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import matches

# Priorities, limits, names and phrases.
SOURCE_FILES = ("source.tar.gz", "source.tex", "source.pdf")
MAIN_NAMES = ("main", "paper", "ms", "arxiv")
BIB_SOURCES = ("bbl", "thebibliography", "bib")
MOST_IMAGES, MOST_ENTRIES = 200, 2000
DISPLAY = r"\\begin\{(?:equation|align|gather|eqnarray|multline|flalign|alignat)\*?\}|\\\[|\$\$"
EQUATION_LIKE = r"(?:=|∫|∑|\\(?:frac|begin|sum))"
AUTHOR_YEAR = r"(\((?:[A-Z][A-Za-z'’-]+[^()]{0,60}?\d{4}[a-z]?(?:;[^()]{0,80})*)\))"
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")

ATOM = (
    "struct<entry:array<struct<id:string,title:string,summary:string,updated:string,author:array<struct<name:string>>,"
    "link:array<struct<_href:string,_rel:string>>,doi:string,category:array<struct<_term:string>>>>,_corrupt_record:string>"
)


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def atom_metadata(feeds: DataFrame) -> DataFrame:
    """(id, code, paper, latest, resolved, title, authors, summary, url, doi, categories) of feeds (id, paper, requested, xml).

    The first entry counts. ``code`` tells why there is none: xml-dtd (declarations are refused
    before anything is parsed), metadata-invalid-xml, arxiv-id-not-found or arxiv-version-not-found.
    """
    d = feeds.withColumn("dtd", F.col("xml").rlike("(?i)<!DOCTYPE|<!ENTITY"))
    d = d.withColumn("x", F.from_xml(F.when(~F.col("dtd"), F.col("xml")), ATOM, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    d = d.withColumn("e", F.expr("try_element_at(x.entry, 1)")).withColumn("eid", _clean(F.col("e.id"))).withColumn("title", _clean(F.col("e.title")))
    value = F.coalesce(F.nullif(F.regexp_extract("eid", r"^.*?/(?:abs|pdf|html)/(.*)$", 1), F.lit("")), F.col("eid"))
    d = d.withColumn("value", value).withColumn("latest", F.coalesce(F.nullif(F.regexp_extract("value", r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(1)))
    base = F.regexp_replace("value", r"v\d+$", "")
    code = (
        F.when(F.col("dtd"), "xml-dtd")
        .when(F.col("x._corrupt_record").isNotNull(), "metadata-invalid-xml")
        .when((F.col("eid") == "") | (F.lower("title") == "error"), "arxiv-id-not-found")
        .when(F.col("requested") > F.col("latest"), "arxiv-version-not-found")
    )
    href = F.expr("try_element_at(filter(e.link, l -> l._href <> '' and (l._rel is null or l._rel = 'alternate')), 1)._href")
    d = d.select(
        "id", code.alias("code"), base.alias("paper"), "latest", F.coalesce(F.nullif(F.col("requested"), F.lit(0)), F.col("latest")).alias("resolved"), "title",
        F.transform(F.coalesce("e.author", F.array().cast("array<struct<name:string>>")), lambda a: _clean(a["name"])).alias("authors"), _clean(F.col("e.summary")).alias("summary"),
        F.coalesce(href, F.concat(F.lit("https://arxiv.org/abs/"), base, F.lit("v"), "latest")).alias("url"), F.nullif(_clean(F.col("e.doi")), F.lit("")).alias("doi"),
        F.expr("filter(transform(coalesce(e.category, array()), c -> c._term), t -> t <> '')").alias("categories"),
    )
    return d.select("id", "code", *[F.when(F.col("code").isNull(), F.col(c)).alias(c) for c in d.columns[2:]])


def best_source(files: DataFrame) -> DataFrame:
    """(id, version, kind): of cached files (id, version, kind) the source that is tried first."""
    rank = F.array_position(F.array(*[F.lit(k) for k in SOURCE_FILES]), F.col("kind"))
    return files.where(F.col("kind").isin(*SOURCE_FILES)).groupBy("id", "version").agg(F.min_by("kind", rank).alias("kind"))


def is_pdf(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 5)) == "255044462D"


def page_images(pages: DataFrame) -> DataFrame:
    """(id, place, src, name, skipped) of a page's images, in order; ``name`` is the stored file's stem.

    Only relative addresses of the first MOST_IMAGES are fetched.
    """
    d = pages.select("id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<img\b[^>]*>"), 0)).alias("place", "tag"))
    src = F.coalesce(*[F.nullif(F.regexp_extract("tag", rf"(?is)\ssrc\s*=\s*{q}", 1), F.lit("")) for q in (r'"([^"]*)"', r"'([^']*)'", r"""([^\s"'>]+)""")], F.lit(""))
    d = d.select("id", "place", src.alias("src"))
    skipped = (F.col("src") == "") | F.col("src").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)") | (F.col("place") >= MOST_IMAGES)
    return d.select("id", "place", "src", F.when(~skipped, F.sha1("src")).alias("name"), skipped.alias("skipped"))


def decoded(data: Column) -> Column:
    """struct(text, fallback): UTF-8, or Latin-1 where the bytes are no UTF-8."""
    valid = F.is_valid_utf8(data.cast("string"))
    return F.struct(F.when(valid, data.cast("string")).otherwise(F.decode(data, "ISO-8859-1")).alias("text"), (~valid).alias("fallback"))


def main_files(files: DataFrame, includes: DataFrame, doublings: int = 5) -> DataFrame:
    """(project, path, how, ambiguous): the main file of each project.

    files: (project, path, text, bytes); includes: (project, path, target). The only file with a
    document class, else the best-known name, else the file that reaches most files, then the
    largest. Reach doubles with each self-join, so 2 ** ``doublings`` levels of includes count.
    """
    d = files.withColumn("stem", F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")))
    d = d.withColumn("classed", F.col("text").rlike(r"\\documentclass(?:\s*\[[^\]]*\])?\s*\{"))
    known = files.select("project", F.col("path").alias("target"))
    reach = includes.select("project", "path", "target").join(known, ["project", "target"], "left_semi").union(files.selectExpr("project", "path", "path")).distinct()
    for _ in range(doublings):
        further = reach.select("project", F.col("path").alias("target"), F.col("target").alias("next"))
        reach = reach.join(further, ["project", "target"]).select("project", "path", F.col("next").alias("target")).distinct()
    counts = reach.groupBy("project", "path").agg(F.count("*").alias("reached"))
    named = F.array_position(F.array(*[F.lit(n) for n in MAIN_NAMES]), F.col("stem"))
    d = d.join(counts, ["project", "path"]).withColumn("name_rank", F.when(named > 0, named))
    d = d.selectExpr("*", "sum(cast(classed as int)) over (partition by project) as classes", "count(name_rank) over (partition by project) as names")
    d = d.withColumn("how", F.when(F.col("classes") == 1, "class").when(F.col("names") > 0, "name").otherwise("reach"))
    d = d.selectExpr("*", "case how when 'class' then cast(not classed as int) when 'name' then coalesce(name_rank, 99) else 0 end as a", "case when how = 'reach' then -reached else 0 end as b", "case when how = 'reach' then -bytes else 0 end as c")
    d = d.selectExpr("*", "row_number() over (partition by project order by a, b, c, path) as place", "count(*) over (partition by project, b, c) as equals")
    return d.where("place = 1").selectExpr("project", "path", "how", "how = 'reach' and equals > 1 as ambiguous")


def display_environments(texts: DataFrame) -> DataFrame:
    """(id, place, environment) of display mathematics in ``text``, in order; those without a name are 'display'."""
    d = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(DISPLAY), 0)).alias("place", "opening"))
    name = F.regexp_extract("opening", r"\{(.*)\}", 1)
    return d.select("id", "place", F.when(name == "", "display").otherwise(name).alias("environment"))


def bibliography_source(entries: DataFrame) -> DataFrame:
    """(project, source, place, key, capped): the entries (project, source, place, key) of the first source that has any, MOST_ENTRIES at most."""
    rank = F.array_position(F.array(*[F.lit(s) for s in BIB_SOURCES]), F.col("source"))
    best = entries.groupBy("project").agg(F.min_by("source", rank).alias("source"))
    d = entries.join(best, ["project", "source"]).selectExpr("*", "row_number() over (partition by project order by place) as nth", f"count(*) over (partition by project) > {MOST_ENTRIES} as capped")
    return d.where(F.col("nth") <= MOST_ENTRIES).select("project", "source", "place", "key", "capped")


def availability(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(request, engine, available, reason) for requests (request, kind, paper, version, offline, converter, has_path, keyed, host) and cached pages (paper, version).

    ``converter`` is the converter's major version, null if it is missing.
    """
    cached = pages.groupBy("paper").agg(F.collect_set("version").alias("versions"))
    d = requests.join(cached, "paper", "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<int>")))
    here = F.when(F.col("version").isNull(), F.size("versions") > 0).otherwise(F.array_contains("versions", F.col("version")))
    html = F.when((F.col("kind") != "arxiv") | F.col("paper").isNull(), "html-unavailable").when(F.col("offline") & ~here, "offline-uncached")
    latex = F.when(F.coalesce("converter", F.lit(0)) < 3, "pandoc-missing").when((F.col("kind") != "arxiv") & ((F.col("kind") != "latex-local") | ~F.col("has_path")), "eprint-is-pdf-only")
    keyless = ~F.col("keyed") & ~F.lower(F.coalesce("host", F.lit(""))).isin(*LOCAL_HOSTS)
    pdf = (
        F.when((F.col("kind") == "pdf-local") & ~F.col("has_path"), "pdf-artifact-missing").when((F.col("kind") == "arxiv") & F.col("paper").isNull(), "arxiv-id-missing")
        .when(~F.col("kind").isin("pdf-local", "arxiv"), "pdf-input-kind").when(F.col("offline"), "offline-uncached").when(keyless, "llm-not-configured")
    )
    each = F.array(*[F.struct(F.lit(n).alias("engine"), r.alias("reason")) for n, r in (("arxiv-html", html), ("latex", latex), ("pdf", pdf))])
    return d.select("request", F.inline(each)).select("request", "engine", F.col("reason").isNull().alias("available"), "reason")


def retries(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Adds ``wait`` and ``outcome`` to attempts (request, attempt from 0, status or null for no answer, retry_after, jitter).

    Overload, server errors and lost connections are tried again, the longer the later, and not
    before the server asks for it.
    """
    again = F.col("status").isNull() | (F.col("status") == 429) | (F.col("status") >= 500)
    pause = F.pow(F.col("attempt") + 1, F.lit(2)) + F.col("jitter")
    asked = F.when(F.col("status").isNotNull(), F.coalesce("retry_after", F.lit(0.0))).otherwise(0.0)
    more = again & (F.col("attempt") < most - 1)
    outcome = F.when(more, "retry").when(again | (F.col("status") >= 401), "llm-transport").otherwise("answer")
    return attempts.withColumn("wait", F.when(more, F.greatest(asked, pause))).withColumn("outcome", outcome)


def call_price(price_in: Column, price_out: Column, purpose: Column, image_tokens: int = 1100) -> Column:
    """What one more call may cost: an image's tokens, and the most that its purpose may answer; unknown prices as held back."""
    answer = F.when(purpose == "equation", 1024).otherwise(4096)
    return ((image_tokens + 200) * F.coalesce(price_in, F.lit(10.0)) + answer * F.coalesce(price_out, F.lit(30.0))) / 1e6


def prompt_slots(calls: DataFrame) -> DataFrame:
    """Adds ``problem`` to prompts (template, slots map): the first slot in order that is missing or unknown; and ``prompt``, null then."""
    fields = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), 1))
    given = F.map_keys("slots")
    first = lambda a, word: F.concat(F.lit(f"{word} prompt slot: "), F.try_element_at(F.array_sort(a), F.lit(1)))
    d = calls.withColumn("problem", F.coalesce(first(F.array_except(fields, given), "missing"), first(F.array_except(given, fields), "unknown")))
    # pieces between the slots, so that a filled text's own braces are left alone
    gaps, names = F.split("template", r"\{\w+\}", -1), F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), 1)
    filled = F.concat_ws("", F.transform(F.arrays_zip(gaps.alias("g"), names.alias("n")), lambda x: F.concat(x["g"], F.coalesce(F.try_element_at("slots", x["n"]), F.lit("")))))
    return d.withColumn("prompt", F.when(F.col("problem").isNull(), filled))


def first_ids(elements: DataFrame) -> DataFrame:
    """(doc, html_id, anchor, duplicate): the first element of an id gives its target, the others are told of."""
    d = elements.where("html_id <> ''").selectExpr("*", "row_number() over (partition by doc, html_id order by n) as nth")
    return d.selectExpr("doc", "n", "html_id", "anchor", "nth > 1 as duplicate")


def section_level(classes: Column) -> Column:
    return F.when(F.array_contains(classes, "ltx_subsubsection"), 3).when(F.array_contains(classes, "ltx_subsection"), 2).otherwise(1)


def target_kind(classes: Column) -> Column:
    """What a reference's target is by its classes; a section if nothing tells."""
    has = lambda *names: F.arrays_overlap(classes, F.array(*[F.lit(n) for n in names]))
    return F.coalesce(
        F.when(F.exists(classes, lambda c: c.startswith("ltx_equation")), "eq").when(has("ltx_figure"), "fig").when(has("ltx_table", "ltx_tabular"), "tab").when(has("ltx_note"), "fn").when(has("ltx_bibitem"), "bib"),
        F.lit("sec"),
    )


def author_year_links(texts: DataFrame, mappings: DataFrame, bib: DataFrame) -> DataFrame:
    """(id, start, end, bib_ids) of author-year markers that ``mappings`` (n, marker, entries) name; bib: (place from 0, bib_id).

    A mapping counts for the first marker, in order of texts, that reads as its own; places beyond the
    bibliography are left out.
    """
    found = matches(texts, AUTHOR_YEAR).groupBy("found").agg(F.min(F.struct("id", "start", "end")).alias("at"))
    d = mappings.join(found, F.col("marker") == F.col("found")).select("n", "at.*", F.posexplode("entries").alias("k", "place"))
    d = d.join(bib, "place").groupBy("n", "id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("k", "bib_id"))).alias("xs"))
    return d.selectExpr("n", "id", "start", "end", "xs.bib_id as bib_ids")


def preflight(blocks: DataFrame) -> DataFrame:
    """(doc, chars, equations): characters and blocks that look like equations, for the estimate before a run."""
    return blocks.groupBy("doc").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text").rlike(EQUATION_LIKE)).alias("equations"))
