"""Remote document sources as JSON tables: listings, block trees, properties. Fetching itself is left to a reader; here
its responses become rows, with bounded loops of joins for trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, utc
from ..storage import kept
from .openapi import as_items, member

#: Fixed value: the title of a page without one.
UNTITLED = "(제목 없음)"
#: Bounds of a walk: levels of folders or blocks, and lines of a page.
MAX_DEPTH, MAX_LINES = 4, 2000
#: What Markdown writes before a block of a type.
PREFIXES = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}


def plain(rich: Column) -> Column:
    """The characters of a rich text array."""
    return F.array_join(F.transform(as_items(rich), lambda x: F.coalesce(member(x, "plain_text"), F.lit(""))), "")


def property_text(prop: Column, nested: bool = True) -> Column:
    """A typed property as text; relations and rollups have none. A formula is taken one level deep."""
    kind = member(prop, "type")
    names = lambda value: F.array_join(F.filter(F.transform(as_items(value), lambda x: member(x, "name")), lambda n: n != ""), ", ")
    start, end = member(prop, "date", "start"), member(prop, "date", "end")
    out = (
        F.when(kind == "title", plain(member(prop, "title")))
        .when(kind == "rich_text", plain(member(prop, "rich_text")))
        .when(kind.isin("select", "status"), F.coalesce(member(prop, "select", "name"), member(prop, "status", "name")))
        .when(kind == "multi_select", names(member(prop, "multi_select")))
        .when(kind == "people", names(member(prop, "people")))
        .when(kind == "date", F.when(F.coalesce(start, F.lit("")) == "", "").otherwise(F.concat(start, F.coalesce(F.concat(F.lit(" ~ "), F.nullif(end, F.lit(""))), F.lit("")))))
        .when(kind == "checkbox", F.when(member(prop, "checkbox") == "true", "true").otherwise("false"))
        .when(kind == "boolean", member(prop, "boolean"))
        .when(kind.isin("number", "url", "email", "phone_number", "string"), F.coalesce(*[member(prop, k) for k in ("number", "url", "email", "phone_number", "string")]))
    )
    if nested:
        out = out.when(kind == "formula", property_text(member(prop, "formula"), nested=False))
    return F.coalesce(out, F.lit(""))


def block_text(block: Column, kind: Column) -> Column:
    """A block, whose content is the member named like its type, with its Markdown prefix; the cells of a table row that
    aren't empty are joined by ` | `."""
    marks = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])

    def said(content: Column) -> Column:
        cells = F.array_join(F.filter(F.transform(as_items(member(content, "cells")), lambda x: F.trim(plain(x))), lambda x: x != ""), " | ")
        parts = [F.trim(plain(member(content, "rich_text"))), cells, F.trim(plain(member(content, "caption")))] + [F.trim(F.coalesce(member(content, x), F.lit(""))) for x in ("title", "url", "expression")]
        done = F.when(member(content, "checked") == "true", "- [x] ").otherwise("- [ ] ")
        prefix = F.when(kind == "to_do", done).otherwise(F.coalesce(F.try_element_at(marks, kind), F.lit("")))
        return once(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " "), lambda text: F.when(text == "", "").otherwise(F.concat(prefix, text)))

    # what is used several times is an item of an array, else it is worked out each time
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return once(F.call_function("get_json_object", block, F.concat(F.lit("$['"), kind, F.lit("']"))), said)


def page_bodies(roots: DataFrame, blocks: DataFrame, depth: int = MAX_DEPTH, lines: int = MAX_LINES) -> DataFrame:
    """(page_id, text) of pages (page_id) from blocks (block_id, parent_id, ordinal, type, block): depth first, to a bounded
    depth, not into child pages, the first `lines` lines."""
    # every level reads the blocks and the level above: both are worked out once
    own = kept(blocks.select("block_id", "parent_id", "ordinal", "type", block_text(F.col("block"), F.col("type")).alias("line")), "blocks")
    level = roots.select("page_id", F.col("page_id").alias("at"), F.array().cast("array<int>").alias("way"))
    found = None
    for _ in range(depth):
        here = kept(level.join(own, F.col("at") == F.col("parent_id")).select("page_id", F.col("block_id").alias("at"), F.concat("way", F.array("ordinal")).alias("way"), "type", "line"), "blocks")
        found = here if found is None else found.union(here)
        level = here.where("type <> 'child_page'").select("page_id", "at", "way")
    text = F.slice(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("way", "line")))), 1, lines)
    return found.where("type <> 'child_page'").groupBy("page_id").agg(clean_text(F.array_join(F.transform(text, lambda x: x.line), "\n")).alias("text"))


def property_lines(properties: Column) -> Column:
    """`name: value` lines of a page's properties that have a value, in their order."""
    entries = F.map_entries(F.from_json(properties, "map<string,string>"))
    lines = F.transform(entries, lambda e: F.when(property_text(e["value"]) != "", F.concat(e["key"], F.lit(": "), property_text(e["value"]))))
    return F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull())


def page_texts(pages: DataFrame, blocks: DataFrame, max_chars: int = 200_000) -> DataFrame:
    """(page_id, text, truncated) of pages (page_id, properties): the properties' lines, then the body's. Properties that can't be
    read are left out; a text of exactly max_chars isn't cut."""
    own = pages.select("page_id", F.array_join(property_lines(F.col("properties")), "\n").alias("head"))
    rows = own.join(page_bodies(pages.select("page_id"), blocks).withColumnRenamed("text", "body"), "page_id", "left")
    text = F.concat_ws("\n", F.nullif("head", F.lit("")), F.nullif("body", F.lit("")))
    return rows.select("page_id", F.substring(clean_text(text), 1, max_chars).alias("text"), (F.length(text) > max_chars).alias("truncated"))


def folder_files(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(root, external_id, title, url, modified_at) of files under folders (root), however deep: entries (id, parent,
    is_folder, name, url, modified). A folder is entered once for a root; a file that is reached twice counts once."""
    folders = entries.where("is_folder").select("parent", "id").distinct()
    level = walked = kept(roots.select("root", F.col("root").alias("at")).distinct(), "folders")
    while not level.isEmpty():
        below = level.join(folders, F.col("at") == F.col("parent")).select("root", F.col("id").alias("at")).distinct()
        level = kept(below.join(walked, ["root", "at"], "left_anti"), "folders")
        walked = walked.union(level)
    own = walked.join(entries.where("not is_folder"), F.col("at") == F.col("parent"))
    files = own.groupBy("root", F.col("id").alias("external_id")).agg(F.min(F.struct("parent", "name", "url", "modified")).alias("x"))
    return files.select("root", "external_id", F.col("x.name").alias("title"), F.coalesce("x.url", F.lit("")).alias("url"), utc("x.modified").alias("modified_at"))


def page_tree(roots: DataFrame, blocks: DataFrame, rows: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, external_id, title, depth) of the pages under roots (root), to a bounded depth of pages: child pages, and the rows
    (database_id, external_id, title) of child databases, each with its own children. Blocks: (block_id, parent_id, type, block). Blocks
    that hold others, but are no pages, are passed through without counting as a level. A page reached twice has its
    smallest depth."""
    held = blocks.select(F.col("block_id").alias("id"), F.col("parent_id").alias("parent"), "type", member(F.col("block"), "child_page", "title").alias("title"))
    level = found = kept(roots.select("root", F.col("root").alias("at"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("depth")).distinct(), "tree")
    for n in range(1, depth + 2):
        # through what isn't a page, level by level
        inside = within = kept(level.select("root", "at"), "tree")
        while not inside.isEmpty():
            inner = inside.join(held.where(~F.col("type").isin("child_page", "child_database")), F.col("at") == F.col("parent")).select("root", F.col("id").alias("at")).distinct()
            inside = kept(inner.join(within, ["root", "at"], "left_anti"), "tree")
            within = within.union(inside)
        below = within.join(held.where(F.col("type").isin("child_page", "child_database")), F.col("at") == F.col("parent"))
        pages = below.where("type = 'child_page'").select("root", F.col("id").alias("at"), "title")
        listed = below.where("type = 'child_database'").join(rows, F.col("id") == F.col("database_id")).select("root", F.col("external_id").alias("at"), rows["title"])
        fresh = pages.union(listed).join(found.select("root", "at"), ["root", "at"], "left_anti")
        level = kept(fresh.groupBy("root", "at").agg(F.min("title").alias("title"), F.lit(n).alias("depth")), "tree")
        if level.isEmpty():
            break
        found = found.union(level)
    return found.where("depth > 0").select("root", F.col("at").alias("external_id"), F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"), "depth")


def page_listing(pages: DataFrame) -> DataFrame:
    """(external_id, title, url, modified_at) of page objects (page), JSON."""
    page = F.col("page")
    titles = F.transform(F.filter(F.map_values(F.from_json(member(page, "properties"), "map<string,string>")), lambda p: member(p, "type") == "title"), lambda p: plain(member(p, "title")))
    own_id = F.coalesce(member(page, "id"), F.lit(""))
    return pages.select(
        own_id.alias("external_id"),
        F.coalesce(F.nullif(F.try_element_at(titles, F.lit(1)), F.lit("")), F.lit(UNTITLED)).alias("title"),
        F.coalesce(F.nullif(member(page, "url"), F.lit("")), F.concat(F.lit("https://www.notion.so/"), F.replace(own_id, F.lit("-"), F.lit("")))).alias("url"),
        utc(member(page, "last_edited_time")).alias("modified_at"),
    )
