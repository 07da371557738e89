"""Markdown of typed blocks, and of pages with running heads and notes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: File-name tags of engines that don't follow the rule.
ENGINE_TAGS = {"apple_vision": "_appleOCR", "surya": "_suryaOCR"}


def origin_marker(scan: Column, path: Column) -> Column:
    """The comment that says where a page comes from."""
    has = F.coalesce(path, F.lit("")) != ""
    return F.when(has, F.concat(F.lit("<!-- branch "), scan.cast("string"), F.lit("."), path, F.lit(" -->"))).otherwise(
        F.concat(F.lit("<!-- scan #"), scan.cast("string"), F.lit(" -->"))
    )


def engine_tag(engine: Column, complement: Column) -> Column:
    """An engine's tag in file names; that of ``apple_docs`` names the engine that completed it."""
    tag = F.concat(F.lit("_"), engine, F.when((engine == "apple_docs") & (complement != ""), F.concat(F.lit("_"), complement)).otherwise(F.lit("")), F.lit("OCR"))
    for name, fixed in ENGINE_TAGS.items():
        tag = F.when(engine == name, F.lit(fixed)).otherwise(tag)
    return tag


def typed_block(kind: Column, text: Column, level: Column) -> Column:
    """One block as Markdown: raw, heading, list, quote, footnote, or a paragraph, bold when it is a line of capitals."""
    return (
        F.when(kind == "raw", text)
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text))
        .when(kind == "list", F.concat(F.lit("- "), text))
        .when(kind.isin("quote", "footnote"), F.concat(F.lit("> "), text))
        .when(T.looks_bold(text), F.concat(F.lit("**"), text, F.lit("**")))
        .otherwise(text)
    )


def document_markdown(blocks: Column) -> Column:
    """array<struct<type,text,items,markdown>> as Markdown; items of neighbouring lists stay together, empty blocks go."""
    bare = lambda x: F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))

    def body(b: Column) -> Column:
        items = F.filter(F.transform(F.coalesce(b["items"], F.array().cast("array<string>")), bare), lambda t: t != "")
        text = bare(b["text"])
        return (
            F.when(b["type"] == "list", F.transform(items, lambda t: F.concat(F.lit("- "), t)))
            .when(b["type"] == "table", F.array(bare(b["markdown"])))
            .otherwise(F.array(F.when(T.looks_heading(text), F.concat(F.lit("## "), text)).otherwise(text)))
        )

    made = F.transform(blocks, lambda b: F.struct((b["type"] == "list").alias("is_list"), F.filter(body(b), lambda t: t != "").alias("said")))
    kept = F.filter(made, lambda b: F.size(b["said"]) > 0)
    none, blank = F.array().cast("array<string>"), F.array(F.lit(""))

    def lines(b: Column, i: Column) -> Column:
        after_list = F.coalesce(F.try_element_at(kept, F.when(i > 0, i))["is_list"], F.lit(False))
        before = F.when(b["is_list"] != after_list, blank).otherwise(none)
        return F.concat(before, b["said"], F.when(b["is_list"], none).otherwise(blank))

    return F.regexp_replace(F.array_join(F.flatten(F.transform(kept, lines)), "\n"), r"\n+$", "")


def ordered_notes(text: Column, markers: Column) -> Column:
    """Numbers of a page's notes that are markers, in the order in which they first appear, raised, in brackets or leading a line."""
    found = F.regexp_extract_all(T.norm_superscripts(text), F.lit(r"(?m)\$\^\{\d+\}\$|^\s*\d+\.|\(\d{1,3}\)"), F.lit(0))
    numbers = F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.array_distinct(F.filter(numbers, lambda n: F.array_contains(markers, n)))


def whole_page(body: Column, header: Column, footer: Column, wrap: bool = True) -> Column:
    """Body, then the notes that stand in header or footer; what else they hold comes before and after, wrapped or plain."""

    def furniture(kind: str, rest: Column) -> Column:
        rest = F.trim(rest)
        shown = F.concat(F.lit(f'<{kind} class="page-{kind}">\n\n'), rest, F.lit(f"\n\n</{kind}>")) if wrap else rest
        return F.when(rest != "", shown)

    top, low = (T.split_definitions(F.coalesce(c, F.lit(""))) for c in (header, footer))
    notes = F.concat_ws("\n", *(F.when(x[0] != "", x[0]) for x in (top, low)))
    return F.concat_ws("\n\n", furniture("header", top[1]), body, F.when(notes != "", notes), furniture("footer", low[1]))
