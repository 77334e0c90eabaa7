"""Parsers as DataFrame operators: Arrow-batched Python over single rows, then ordinary columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import parsers


#: Results, and characters of texts, that are held as Python objects before they are handed on.
MOST_ROWS, MOST_CHARS = 4096, 1 << 20


def _each(df: DataFrame, parse: Callable, schema: str, names: list[str]) -> DataFrame:
    """(id, text) rows through ``parse``, a row for each result; what is held at a time grows with one text's results only, not with the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, chars = [], 0
        for b in batches:
            for i, t in zip(b["id"], b["text"], strict=True):
                for n, r in enumerate(parse(t or "")):
                    rows.append((i, n, *r))
                    if len(rows) >= MOST_ROWS:
                        yield pd.DataFrame(rows, columns=["id", "n", *names])
                        rows, chars = [], 0
                chars += len(t or "")
                if rows and chars >= MOST_CHARS:
                    yield pd.DataFrame(rows, columns=["id", "n", *names])
                    rows, chars = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["id", "n", *names])

    return df.select("id", "text").mapInPandas(run, f"id long, n int, {schema}")


def tex_tokens(df: DataFrame) -> DataFrame:
    return _each(df, parsers.tokenize_tex, "start int, stop int, kind string, style string, names string, pre string, post string, cut boolean", ["start", "stop", "kind", "style", "names", "pre", "post", "cut"])


def bibtex_rows(df: DataFrame) -> DataFrame:
    return _each(df, parsers.bibtex_entries, "place int, type string, key string, fields map<string,string>", ["place", "type", "key", "fields"])


def bbl_rows(df: DataFrame) -> DataFrame:
    return _each(df, parsers.bbl_items, "place int, key string, label string, body string", ["place", "key", "label", "body"])


def macro_rows(df: DataFrame) -> DataFrame:
    return _each(df, lambda t: parsers.macros(t).items(), "name string, body string", ["name", "body"])


def html_rows(df: DataFrame) -> DataFrame:
    return _each(df, parsers.html_nodes, "path array<int>, tag string, classes string, node_id string, link string, own_text string", ["path", "tag", "classes", "node_id", "link", "own_text"])


def html_rule_rows(df: DataFrame) -> DataFrame:
    return _each(df, lambda t: [(c,) for c in parsers.html_violations(t)], "code string", ["code"])


def stripped(df: DataFrame) -> DataFrame:
    return _each(df, lambda t: [(parsers.strip_comments(t),)], "stripped string", ["stripped"])


def equation_rows(df: DataFrame) -> DataFrame:
    return _each(df, lambda t: [(r,) for r in parsers.split_rows(t)], "row string", ["row"])


def char_lines(df: DataFrame) -> DataFrame:
    """(doc, page, l, b, r, t, text) from characters (doc, page, text, l, b, r, t, font); a page is one group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = parsers.lines_of_chars(list(pdf[["text", "l", "b", "r", "t", "font"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(*key, *r) for r in rows], columns=["doc", "page", "l", "b", "r", "t", "text"])

    return df.groupBy("doc", "page").applyInPandas(run, "doc long, page long, l double, b double, r double, t double, text string")
