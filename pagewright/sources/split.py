"""Multi-page documents as one document a page, and the pages' reading order."""

from __future__ import annotations

import copy
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import Unreadable

# Keys of page lists and page numbers in JSON layouts, compared in lower case.
PAGE_LISTS = ("pages", "page_results", "parsedresults", "page_list", "document_pages", "documentpages")
PAGE_NUMBERS = ("pagenumber", "page_number", "page_num", "page", "pageid", "page_id", "pageno", "page_no", "physical_img_nr")
PAGES = "file string, path string, page string, content binary, error string"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def alto_pages(data: bytes) -> list[tuple[str, bytes]]:
    """(number, document) of every Page, each with the whole header; a document type is refused."""
    if re.search(rb"<!DOCTYPE", data, re.IGNORECASE):
        raise Unreadable("doctype")
    root = ET.fromstring(data)
    if root.tag.startswith("{"):
        ET.register_namespace("", root.tag[1:].partition("}")[0])
    layout = next((e for e in root if _name(e) == "Layout"), None)
    numbers = [e.get("PHYSICAL_IMG_NR") or str(k) for k, e in enumerate((e for e in layout if _name(e) == "Page"), 1)] if layout is not None else []
    out = []
    for k, number in enumerate(numbers):
        one = copy.deepcopy(root)
        body = next(e for e in one if _name(e) == "Layout")
        for j, page in enumerate([e for e in body if _name(e) == "Page"]):
            if j != k:
                body.remove(page)
        out.append((number, ET.tostring(one, encoding="utf-8", xml_declaration=True)))
    return out


def _containers(data) -> Iterator[tuple[list[str], list]]:
    """Lists of objects at most two keys deep, outer ones first."""
    if isinstance(data, dict):
        outer = [([k], v) for k, v in data.items()]
        inner = [([k, k2], v2) for k, v in data.items() if isinstance(v, dict) for k2, v2 in v.items()]
        yield from ((path, v) for path, v in outer + inner if isinstance(v, list) and v and all(isinstance(x, dict) for x in v))


def _number(item: dict, keys: tuple[str, ...] = PAGE_NUMBERS):
    return next((v for k, v in item.items() if isinstance(k, str) and k.lower() in keys and v is not None), None)


def _with(data: dict, path: list[str], value) -> dict:
    return {**data, path[0]: _with(data[path[0]], path[1:], value) if path[1:] else value}


def tagged(items: list[dict]) -> dict | None:
    """Items by the page field that most of them carry, if it has more than one value; in order of first appearance."""
    for key in PAGE_NUMBERS:
        found = [(x, n) for x in items if (n := _number(x, (key,))) is not None]
        groups: dict = {}
        for item, number in found:
            groups.setdefault(json.dumps(number), (number, []))[1].append(item)
        if 2 * len(found) > len(items) and len(groups) > 1:
            return dict(groups.values()) if all(isinstance(n, (str, int, float)) for n, _ in groups.values()) else None
    return None


def page_list(data) -> tuple[list[str], list] | None:
    return next(((path, v) for path, v in _containers(data) if path[-1].lower() in PAGE_LISTS), None)


def tagged_list(data) -> tuple[list[str], dict] | None:
    return next(((path, groups) for path, v in _containers(data) if (groups := tagged(v))), None)


def json_page_documents(data) -> list[tuple[str, object]]:
    """(number, document) of each page: a list of pages, else a list whose items name their page, else the document whole."""
    if found := page_list(data):
        path, pages = found
        return [(str(n if (n := _number(p)) is not None else k), _with(data, path, p)) for k, p in enumerate(pages, 1)]
    if grouped := tagged_list(data):
        path, groups = grouped
        return [(str(n), _with(data, path, items)) for n, items in groups.items()]
    return [("1", data)]


def page_scope(data):
    """The part of a page document that belongs to the page: the object or items that a split left in the place of the list."""
    if isinstance(data, dict):
        for value in (data, *(v for v in data.values() if isinstance(v, dict))):
            for k, v in value.items():
                if isinstance(k, str) and k.lower() in PAGE_LISTS and isinstance(v, (dict, list)):
                    return v
    return data


def split_pages(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) of ALTO or JSON -> PAGES, a row a page; a file that can't be split is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                file, data = name.split(".", 1)[0], bytes(content)
                try:
                    if data.lstrip()[:1] == b"<":
                        pages = alto_pages(data)
                    else:
                        pages = [(n, json.dumps(d, ensure_ascii=False).encode()) for n, d in json_page_documents(json.loads(data))]
                    rows += [(file, path, n, d, None) for n, d in pages] or [(file, path, None, None, "no_pages")]
                except Exception as e:  # one broken file is that file's error
                    rows.append((file, path, None, None, str(e) if isinstance(e, Unreadable) else f"broken: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["file", "path", "page", "content", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def stale_pages(existing: DataFrame, written: DataFrame) -> DataFrame:
    """Pages (file, page) of an earlier run, of documents written now, that this run didn't write."""
    return existing.join(written.select("file").distinct(), "file", "left_semi").join(written, ["file", "page"], "left_anti")


def reading_order(data: bytes) -> list[str]:
    """Ids of an ALTO page's text blocks: its ReadingOrder, else the chain of IDNEXT, else document order."""
    root = ET.fromstring(data)
    blocks = [e for e in root.iter() if _name(e) == "TextBlock" and e.get("ID")]
    ids = [e.get("ID") for e in blocks]
    if (order := next((e for e in root.iter() if _name(e) == "ReadingOrder"), None)) is not None:
        groups = {_name(e): e for e in order if _name(e) in ("OrderedGroup", "UnorderedGroup")}
        chosen = groups["OrderedGroup"] if len(groups.get("OrderedGroup", ())) else groups.get("UnorderedGroup")
        if chosen is None:
            raise Unreadable("reading order without a group")
        refs = [e.get("REF") for e in chosen.iter() if e.get("REF")]
        if not set(refs) <= set(ids):
            raise Unreadable("reading order below blocks")
        return refs
    following = {e.get("ID"): e.get("IDNEXT") for e in blocks}
    if not any(following.values()):
        return ids
    at, chain = next((i for i in ids if i not in following.values()), None), []
    while at and at not in chain:
        chain.append(at)
        at = following.get(at)
    return chain


def in_chain_order(blocks: DataFrame, longest: int = 10_000) -> DataFrame:
    """blocks (file, page, id, next, pos) with place: along the chain from the block nobody names; blocks off the chain come after, by pos.

    A chain is one page's, so it is followed within one row of that page.
    """
    nodes = blocks.groupBy("file", "page").agg(F.map_from_entries(F.collect_list(F.struct("id", "next"))).alias("to"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("all"))
    heads = "filter(transform(all, b -> b.id), i -> NOT array_contains(array_compact(map_values(to)), i))"
    walk = (
        f"aggregate(sequence(1, least(size(all), {longest})), struct(cast(array() AS array<string>) AS done, element_at({heads}, 1) AS at),"
        " (s, k) -> CASE WHEN s.at IS NULL OR array_contains(s.done, s.at) THEN s ELSE struct(array_append(s.done, s.at) AS done, try_element_at(to, s.at) AS at) END, s -> s.done)"
    )
    chained = nodes.withColumn("done", F.expr(f"CASE WHEN exists(map_values(to), n -> n IS NOT NULL) AND size({heads}) > 0 THEN {walk} ELSE transform(all, b -> b.id) END"))
    whole = chained.select("file", "page", F.posexplode(F.expr("array_distinct(concat(done, transform(all, b -> b.id)))")).alias("place", "id"))
    return blocks.join(whole, ["file", "page", "id"])
