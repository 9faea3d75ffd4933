"""Documents to elements and pages."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.packing import greedy_groups, group_numbers
from corpusloom.functions.ranking import last_upto

ELEMENTS = "doc_id string, element_id string, order int, type string, format string, content string, level int, ignored boolean"
MAX_PAGE_CHARS = 2000
#: Elements that a Python worker makes before it hands them on.
ELEMENTS_AT_ONCE = 2_000

# Fixed values
BLOCK_TAGS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol section blockquote pre code article aside footer header nav".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IGNORED_TAGS = frozenset("script style nav footer aside head".split())
BOX_TYPES = {"page-header": "page_header", "section-header": "heading", "table": "table", "picture": "image", "page-footer": "page_footer", "caption": "caption", "footnote": "footnote", "equation": "equation", "code": "code"}


def _paragraphs(text: str) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n\s*\r?\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")


def parse_plain_text(docs: DataFrame) -> DataFrame:
    """A paragraph for each run of text between blank lines."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(_paragraphs("text")).alias("order", "content"))
    return _plain_elements(rows)


def _plain_elements(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("doc_id", F.concat("doc_id", F.lit("_el_"), F.col("order").cast("string")).alias("element_id"), "order", F.lit("paragraph").alias("type"), F.lit("text").alias("format"), "content", F.lit(None).cast("int").alias("level"), F.lit(False).alias("ignored"), *more)


def plain_text_pages(docs: DataFrame, max_page_chars: int = MAX_PAGE_CHARS) -> DataFrame:
    """``with_pages`` of ``parse_plain_text``, within the row of each document: nothing is moved. Elements leave their document's row together and in order."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), _paragraphs("text").alias("_p"))  # a filter on _p would be run on the text, a second time
    numbers = group_numbers(F.transform("_p", lambda x: F.length(x)), max_page_chars)
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("_p").alias("content"), numbers.alias("page_no"))).alias("order", "_z")).select("doc_id", "order", "_z.*")
    return _page_ids(_plain_elements(rows, "page_no"))


class _Page(HTMLParser):
    """Collects (type, format, content, level, ignored) of a page's blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.table: list[str] = []
        self.tables = 0

    @property
    def hidden(self) -> bool:
        return any(t in IGNORED_TAGS for t in self.open)

    def flush(self) -> None:
        content, self.text = "".join(self.text).strip(), []
        if not content:
            return
        block = next((t for t in reversed(self.open) if t in BLOCK_TAGS), "")
        heading = re.fullmatch("h[1-6]", block)
        kind = "heading" if heading else {"li": "list_item", "ul": "list", "ol": "list"}.get(block, "paragraph")
        self.found.append((kind, "text", content, int(block[1]) if heading else None, self.hidden))

    def handle_starttag(self, tag, attrs):
        if tag == "table" and not self.tables:
            self.flush()
        if tag == "table" or self.tables:
            self.tables += tag == "table"
            self.table.append("<" + " ".join([tag, *(k if v is None else f'{k}="{html.escape(v)}"' for k, v in attrs)]) + ">")
            if tag == "table" and self.tables == 1 or tag in IGNORED_TAGS:
                self.open.append(tag)
            return
        if tag not in VOID_TAGS:
            self.open.append(tag)
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag):
        if self.tables:
            self.table.append(f"</{tag}>")
            self.tables -= tag == "table"
            if not self.tables:
                self.found.append(("table", "html", "".join(self.table), None, self.hidden))
                self.table = []
        if not self.tables and tag in BLOCK_TAGS:
            self.flush()
        if tag in self.open and (not self.tables or tag in IGNORED_TAGS):
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        (self.table if self.tables else self.text).append(html.escape(data) if self.tables else data)


def html_blocks(text: str) -> list[tuple]:
    page = _Page()
    page.feed(text or "")
    page.flush()
    return page.found


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"( {0,3})(?:[-*+]|(\d{1,9})[.)])(?:[ \t]+(.*))?$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_DIVIDER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = re.compile(r" {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$)|!--|\?|![A-Z])")


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", line.strip()))]


def markdown_blocks(text: str) -> list[tuple]:
    """(type, format, content, level, ignored) of the blocks of a Markdown text."""
    lines, found, i = (text or "").replace("\r\n", "\n").split("\n"), [], 0

    def fence(i: int) -> tuple[str, int]:
        opened = _FENCE.match(lines[i].lstrip())
        mark, body, i = opened[1], [], i + 1
        while i < len(lines) and not re.fullmatch(rf"\s*{re.escape(mark[0])}{{{len(mark)},}}\s*", lines[i]):
            body.append(lines[i])
            i += 1
        return f"```{opened[2].strip()}\n" + "".join(x + "\n" for x in body) + "```", i + 1

    def starts_block(i: int) -> bool:
        line = lines[i]
        return bool(_HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or (m := _ITEM.match(line)) and m[3] and (not m[2] or m[2] == "1") or _HTML_BLOCK.match(line))

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _HEADING.match(line):
            found.append(("heading", "markdown", (m[2] or "").strip(), len(m[1]), False))
            i += 1
        elif _FENCE.match(line):
            content, i = fence(i)
            found.append(("paragraph", "markdown", content, None, False))
        elif _RULE.match(line):
            i += 1
        elif m := _ITEM.match(line):
            ordered, items = bool(m[2]), []
            while i < len(lines):
                line = lines[i]
                if (m := _ITEM.match(line)) and bool(m[2]) == ordered:
                    items.append(m[3] or "")
                elif line.startswith((" ", "\t")) and line.strip():
                    if _FENCE.match(line.lstrip()):
                        block, i = fence(i)
                        items[-1] += f"\n{block}\n"
                        continue
                    inner = _ITEM.match(line.strip())
                    items[-1] += (inner[3] or "") if inner else ("\n" if items[-1] else "") + line.strip()
                elif line.strip() and not starts_block(i) and lines[i - 1].strip():
                    items[-1] += "\n" + line.strip()
                elif line.strip() or not (i + 1 < len(lines) and (lines[i + 1].startswith((" ", "\t")) or (m := _ITEM.match(lines[i + 1])) and bool(m[2]) == ordered)):
                    break
                i += 1
            found.append(("list", "markdown", "\n".join((f"{k}. " if ordered else "- ") + x.strip() for k, x in enumerate(items, 1)), None, False))
        elif "|" in line and i + 1 < len(lines) and _DIVIDER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            head, rows, i = _cells(line), [], i + 2
            while i < len(lines) and lines[i].strip() and not starts_block(i):
                rows.append((_cells(lines[i]) + [""] * len(head))[: len(head)])
                i += 1
            row = lambda tag, cells: ["<tr>", *(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells), "</tr>"]
            body = ["<tbody>", *(x for r in rows for x in row("td", r)), "</tbody>"] if rows else []
            found.append(("table", "html", "\n".join(["<table>", "<thead>", *row("th", head), "</thead>", *body, "</table>"]), None, False))
        elif _HTML_BLOCK.match(line):
            start = i
            while i < len(lines) and lines[i].strip():
                i += 1
            found.append(("paragraph", "html", "\n".join(lines[start:i]).strip(), None, False))
        else:
            start = i
            i += 1
            while i < len(lines) and lines[i].strip() and not starts_block(i) and not re.fullmatch(r" {0,3}(=+|-+)[ \t]*", lines[i]):
                i += 1
            content = "\n".join(x.strip() for x in lines[start:i])
            if i < len(lines) and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", lines[i]):
                found.append(("heading", "markdown", content, 1 if "=" in lines[i] else 2, False))
                i += 1
            else:
                found.append(("paragraph", "markdown", content, None, False))
    return found


def _frames(rows: Iterator[tuple], schema: str, types: dict) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded size, so that a worker never holds the elements of a whole batch of documents."""
    names = [f.split()[0] for f in schema.split(", ")]
    while part := list(islice(rows, ELEMENTS_AT_ONCE)):
        yield pd.DataFrame(part, columns=names).astype(types)


def parse_with(docs: DataFrame, column: str, blocks) -> DataFrame:
    """Elements by a parser function: text to (type, format, content, level, ignored) blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((d, f"{d}_el_{k}", k, *b[:3], b[3], b[4]) for d, text in zip(batch["doc_id"], batch["text"]) for k, b in enumerate(blocks(text)))
            yield from _frames(rows, ELEMENTS, {"order": "int32", "level": "Int32", "ignored": bool})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(column).alias("text")).mapInPandas(run, ELEMENTS)


def parse_html(docs: DataFrame, column: str = "html") -> DataFrame:
    """Blocks of HTML pages; tables stay HTML, blocks of navigation, scripts and the like are marked ignored."""
    return parse_with(docs, column, html_blocks)


def parse_markdown(docs: DataFrame, column: str = "text") -> DataFrame:
    return parse_with(docs, column, markdown_blocks)


def normalize_page_json(docs: DataFrame) -> DataFrame:
    """Elements of parser output ``pages`` (array of page_no, text, page_boxes).

    Pages are ordered by page_no if these are exactly 1 to N in any order, else numbered by position. Boxes cut typed elements out
    of the page's text; pages without boxes fall back to blank-line paragraphs. Elements are numbered over the document.
    """
    n = F.size("pages")
    valid = F.array_sort(F.transform("pages", lambda p: p["page_no"])) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    pages = docs.where(n > 0).select(F.col("doc_id").cast("string").alias("doc_id"), valid.alias("valid"), F.posexplode("pages").alias("at", "page"))
    pages = pages.select("doc_id", F.when(F.col("valid"), F.col("page.page_no")).otherwise(F.col("at") + 1).cast("int").alias("page_no"), F.coalesce("page.text", F.lit("")).alias("text"), "page.page_boxes")
    types = F.create_map(*(F.lit(x) for kv in BOX_TYPES.items() for x in kv))
    empty = F.lit(None).cast("array<double>")
    cut = F.transform(
        F.filter("page_boxes", lambda b: F.size(F.coalesce(b["pos"], F.array())) >= 2),
        lambda b: F.struct(
            F.coalesce(types[b["class"]], F.lit("paragraph")).alias("type"),
            F.regexp_replace(F.substring(F.col("text"), (b["pos"][0] + 1).cast("int"), F.greatest((b["pos"][1] - b["pos"][0]).cast("int"), F.lit(0))), r"^\s+|\s+$", "").alias("content"),
            F.when(F.size(b["bbox"]) == 4, b["bbox"]).alias("bbox"),
        ),
    )
    plain = F.transform(F.split("text", r"\r?\n\s*\r?\n"), lambda x: F.struct(F.lit("paragraph").alias("type"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("content"), empty.alias("bbox")))
    items = F.filter(F.when(F.size(F.coalesce("page_boxes", F.array())) > 0, cut).otherwise(plain), lambda x: x["content"] != "")
    rows = pages.select("doc_id", "page_no", F.posexplode(items).alias("k", "e"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "k")) - 1
    heading = F.col("e.type") == "heading"
    marks = F.regexp_extract("e.content", r"^(#{1,6})\s+", 1)
    boxed = F.col("e.bbox").isNotNull() | (F.col("e.type") != "paragraph")
    return rows.select(
        "doc_id", order.alias("order"), F.concat("doc_id", F.lit("_el_"), order.cast("string")).alias("element_id"), F.concat("doc_id", F.lit("_page_"), F.col("page_no").cast("string")).alias("page_id"), F.col("e.type").alias("type"),
        F.when(heading & boxed, F.regexp_replace("e.content", r"^#{1,6}\s+", "")).otherwise(F.col("e.content")).alias("content"),
        F.when(heading, F.when(marks != "", F.length(marks)).otherwise(1)).alias("level"), F.col("e.bbox").alias("bbox"),
    )


# Labels of a layout model and the element types they stand for; any other label is of unknown type.
LAYOUT_TYPES = {
    "title": "heading", "section_header": "heading", "paragraph": "paragraph", "text": "paragraph", "list_item": "list_item", "table": "table", "picture": "image", "chart": "image", "caption": "caption", "footnote": "footnote",
    "formula": "equation", "equation": "equation", "page_header": "page_header", "page_footer": "page_footer", "document_index": "section_index", "code": "code", "reference": "paragraph", "form": "paragraph",
    "key_value_region": "paragraph", "checkbox_selected": "paragraph", "checkbox-selected": "paragraph", "checkbox_unselected": "paragraph", "checkbox-unselected": "paragraph", "grading_scale": "paragraph",
    "handwritten_text": "paragraph", "empty_value": "paragraph", "field_region": "paragraph", "field_heading": "paragraph", "field_item": "paragraph", "field_key": "paragraph", "field_value": "paragraph", "field_hint": "paragraph", "marker": "paragraph",
}
LAYOUT_ROLES = {"title": "title", "section_header": "sectionHeading", "page_header": "pageHeader", "page_footer": "pageFooter", "footnote": "footnote", "caption": "caption"}
LAYOUT_FORMATS = {"formula": "latex", "code": "text", "table": "html", "document_index": "html", "picture": "asset_ref", "chart": "asset_ref"}
LAYOUT_IGNORED = ("page_header", "page_footer", "document_index")
LAYOUT = ELEMENTS + ", role string, parent_id string, page_no int, bbox array<double>, asset_uri string, cells array<struct<row:int,col:int,row_span:int,col_span:int,header:boolean,text:string>>"


def _topleft(box: dict, height: float | None) -> list[float]:
    """left, top, right and bottom as measured from the top left corner."""
    left, top, right, bottom = (float(box.get(k) or 0) for k in "ltrb")
    if str(box.get("coord_origin", "")).upper() == "BOTTOMLEFT" and height:
        top, bottom = sorted((height - top, height - bottom))
    return [left, top, right, bottom]


def _grid_html(rows: int, cols: int, cells: list[tuple]) -> str:
    """The table that table_grid_html builds, for the cells of one element."""
    if rows <= 0 or cols <= 0:
        return ""
    at = {(r, c): k for k, (r, c, *_) in enumerate(cells)}
    hidden = {(i, j) for r, c, h, w, *_ in cells for i in range(r, r + h) for j in range(c, c + w) if (i, j) != (r, c)}

    def one(place: tuple[int, int]) -> str:
        if place not in at:
            return "<td></td>"
        _, _, h, w, header, text = cells[at[place]]
        tag = "th" if header else "td"
        return f"<{tag}" + (f' rowspan="{h}"' if h > 1 else "") + (f' colspan="{w}"' if w > 1 else "") + f">{html.escape(text)}</{tag}>"

    lines = ("  <tr>" + "".join(one((r, c)) for c in range(cols) if (r, c) not in hidden) + "</tr>" for r in range(rows))
    return "\n".join(["<table>", *lines, "</table>"])


def layout_items(text: str) -> list[dict]:
    """Elements of a layout document in reading order: depth first over the body's references, without the inside of tables.

    A reference is resolved in texts, tables, pictures and groups. ``parent`` is the position of the element that holds it.
    """
    data = json.loads(text)
    heights = {int(p.get("page_no") or k): (p.get("size") or {}).get("height") for k, p in (data.get("pages") or {}).items()}
    out, seen = [], set()
    queue = [(c.get("$ref"), None) for c in reversed((data.get("body") or {}).get("children") or [])]
    while queue:
        ref, parent = queue.pop()
        _, kind, number = [*str(ref).split("/"), "", ""][:3]
        rows = data.get(kind) or []
        if ref in seen or kind not in ("texts", "tables", "pictures", "groups") or not number.isdigit() or int(number) >= len(rows):
            continue
        seen.add(ref)
        node, label = rows[int(number)], rows[int(number)].get("label") or "unknown"
        children = [(c.get("$ref"), len(out)) for c in node.get("children") or []]
        prov = (node.get("prov") or [{}])[0]
        page = prov.get("page_no")
        box = _topleft(prov["bbox"], heights.get(page)) if prov.get("bbox") else None
        found = {"type": LAYOUT_TYPES.get(label, "unknown"), "format": LAYOUT_FORMATS.get(label, "markdown"), "content": node.get("text") or "", "level": None, "ignored": label in LAYOUT_IGNORED, "role": LAYOUT_ROLES.get(label), "parent": parent, "page_no": page, "bbox": box, "asset_uri": None, "cells": None}
        if kind == "groups":
            found |= {"type": "list", "content": "", "format": "markdown", "ignored": False, "role": None}
        elif found["type"] == "heading":
            found["level"] = node.get("level") or (1 if label == "title" else None)
        elif label == "list_item":
            found["content"] = f"{node.get('marker') or '-'} {found['content']}".strip()
        elif label.startswith("checkbox"):
            found["content"] = (("[ ] " if "unselected" in label else "[x] ") + found["content"]).strip()
        elif found["type"] == "image":
            found["asset_uri"] = (node.get("image") or {}).get("uri")
        elif found["type"] in ("table", "section_index"):
            grid = node.get("data") or {}
            place = lambda c, k: c.get(f"start_{k}_offset_idx")
            cells = [(place(c, "row"), place(c, "col"), c.get("row_span") or 1, c.get("col_span") or 1, bool(c.get("column_header") or c.get("row_header")), c.get("text") or "") for c in grid.get("table_cells") or [] if place(c, "row") is not None and place(c, "col") is not None]
            found |= {"content": _grid_html(grid.get("num_rows") or 0, grid.get("num_cols") or 0, cells), "cells": cells if label == "table" else None}
            children = [] if label == "table" else children
        out.append(found)
        queue += reversed(children)
    return out


def normalize_layout_json(docs: DataFrame) -> DataFrame:
    """Elements of layout-model JSON (column ``json``) with role, parent, page, box, picture and table cells.

    Page headers, footers and indexes are marked ignored. Unknown labels keep their text as elements of unknown type.
    """

    def elements(batch: pd.DataFrame) -> Iterator[tuple]:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            for k, x in enumerate(layout_items(text) if text else []):
                yield (doc, f"{doc}_el_{k}", k, x["type"], x["format"], x["content"], x["level"], x["ignored"], x["role"], None if x["parent"] is None else f"{doc}_el_{x['parent']}", x["page_no"], x["bbox"], x["asset_uri"], x["cells"] and [dict(zip(("row", "col", "row_span", "col_span", "header", "text"), c)) for c in x["cells"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(elements(batch), LAYOUT, {"order": "int32", "level": "Int32", "page_no": "Int32", "ignored": bool})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("json").alias("text")).mapInPandas(run, LAYOUT)


def bbox_to_topleft(box: Column, page_height: Column) -> Column:
    """A box with left, top, right, bottom and coord_origin, measured from the top left corner."""
    flip = box["coord_origin"] == "BOTTOMLEFT"
    top, bottom = F.coalesce(page_height - box["top"], box["top"]), F.coalesce(page_height - box["bottom"], box["bottom"])
    return F.struct(
        box["left"].alias("left"), F.when(flip, F.least(top, bottom)).otherwise(box["top"]).alias("top"), box["right"].alias("right"),
        F.when(flip, F.greatest(top, bottom)).otherwise(box["bottom"]).alias("bottom"), F.when(flip, "TOPLEFT").otherwise(box["coord_origin"]).alias("coord_origin"),
    )


def group_bbox_union(parts: DataFrame) -> DataFrame:
    """Bounding box and character span of every (group_id, page_no)."""
    return parts.groupBy("group_id", "page_no").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))


def table_grid_html(cells: DataFrame) -> DataFrame:
    """HTML of every table (table_id, n_rows, n_cols, row, col, row_span, col_span, header, text) and whether a cell spans.

    Cells that a span covers are left out; places without a cell are empty ``td``.
    """
    spans = F.concat(F.when(F.col("row_span") > 1, F.format_string(' rowspan="%d"', "row_span")).otherwise(""), F.when(F.col("col_span") > 1, F.format_string(' colspan="%d"', "col_span")).otherwise(""))
    tag = F.when(F.col("header"), "th").otherwise("td")
    escaped = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    inside = cells.where("row between 0 and n_rows - 1 and col between 0 and n_cols - 1").withColumn("html", F.concat(F.lit("<"), tag, spans, F.lit(">"), escaped, F.lit("</"), tag, F.lit(">")))
    covered = inside.select("table_id", F.explode(F.sequence("row", F.least(F.col("row") + F.col("row_span"), F.col("n_rows")) - 1)).alias("r"), "row", "col", "col_span", "n_cols")
    covered = covered.select("table_id", "r", F.explode(F.sequence("col", F.least(F.col("col") + F.col("col_span"), F.col("n_cols")) - 1)).alias("c"), "row", "col").where("r != row or c != col").select("table_id", "r", "c").distinct()
    places = cells.groupBy("table_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.bool_or((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("is_complex"))
    places = places.where("n_rows > 0 and n_cols > 0").select("table_id", "is_complex", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("r")).select("table_id", "is_complex", "r", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("c"))
    grid = places.join(covered, ["table_id", "r", "c"], "left_anti").join(inside.select("table_id", F.col("row").alias("r"), F.col("col").alias("c"), "html"), ["table_id", "r", "c"], "left")
    row_html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("html", F.lit("<td></td>")).alias("h")))), lambda x: x["h"]), "")
    rows = grid.groupBy("table_id", "is_complex", "r").agg(F.concat(F.lit("  <tr>"), row_html, F.lit("</tr>")).alias("html"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "html"))), lambda x: x["html"]), "\n")
    return rows.groupBy("table_id", "is_complex").agg(F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("html"))


def ensure_elements(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements, and for documents without any those of the first non-blank of their markdown, html and text."""
    missing = docs.join(elements.select(F.col("doc_id").alias("_d")).distinct(), docs["doc_id"].cast("string") == F.col("_d"), "left_anti")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    md, page, text = missing.where(~blank("markdown")), missing.where(blank("markdown") & ~blank("html")), missing.where(blank("markdown") & blank("html") & ~blank("text"))
    names = [f.split()[0] for f in ELEMENTS.split(", ")]
    return elements.select(names).unionByName(parse_markdown(md, "markdown")).unionByName(parse_html(page)).unionByName(parse_plain_text(text))


def assign_pages(elements: DataFrame, max_page_chars: int = MAX_PAGE_CHARS) -> DataFrame:
    """doc_id, order and page_no: a new page starts when the next element would overfill a page that has text."""
    rows = elements.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("order").cast("int").alias("order"), F.length("content").alias("n"))
    return greedy_groups(rows, "doc_id", "order", "n", max_page_chars, "page_no")


def with_pages(elements: DataFrame, max_page_chars: int = MAX_PAGE_CHARS) -> DataFrame:
    """``elements`` with page_no and page_id. Sizes alone are gathered by document; texts meet their page in a join by element."""
    pages = assign_pages(elements, max_page_chars)
    paged = elements.withColumns({"doc_id": F.col("doc_id").cast("string"), "order": F.col("order").cast("int")}).join(pages, ["doc_id", "order"]).select(*elements.columns, "page_no")
    return _page_ids(paged)


def _page_ids(paged: DataFrame) -> DataFrame:
    return paged.withColumn("page_id", F.concat("doc_id", F.lit("_page_"), F.col("page_no").cast("string")))


def _open_headings(elements: DataFrame, value: Column) -> tuple[DataFrame, list[Column]]:
    """For each level 1 to 6 the heading that is open at a row (null if none), as struct(order, value).

    The last heading of a level is open unless one of a smaller level came after it. A document of any length is handled: what is open where a range of its elements
    begins is carried in.
    """
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    is_heading = (F.col("type") == "heading") & ~F.col("ignored") & (F.trim("content") != "")
    rows = last_upto(elements, "doc_id", "order", {f"_h{k}": F.when(is_heading & (level == k), F.struct("order", value.alias("value"))) for k in range(1, 7)})
    live = []
    for k in range(1, 7):
        above = F.greatest(F.lit(-1), F.lit(-2), *(F.coalesce(F.col(f"_h{j}.order"), F.lit(-1)) for j in range(1, k)))
        live.append(F.when(F.col(f"_h{k}.order") > above, F.col(f"_h{k}")))
    return rows, live


def heading_tree(elements: DataFrame) -> DataFrame:
    """element_id, parent_id and children_ids of every element that is not ignored.

    A ``parent_id`` that the elements carry stays; else the parent is the nearest open heading, of a smaller level for headings.
    """
    rows, live = _open_headings(elements, F.col("element_id"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    own = F.when(F.col("type") == "heading", level).otherwise(7)
    parent = F.coalesce(*((F.col("parent_id"),) if "parent_id" in elements.columns else ()), *(F.when(own > k, live[k - 1]["value"]) for k in range(6, 0, -1)))
    nodes = rows.where("not ignored").select("doc_id", "element_id", "order", parent.alias("parent_id"))
    children = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("element_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "element_id"))), lambda x: x["element_id"]).alias("children_ids"))
    return nodes.join(children, ["doc_id", "element_id"], "left").select("doc_id", "element_id", "parent_id", F.coalesce("children_ids", F.array().cast("array<string>")).alias("children_ids"))


def joined_text(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Blank-line join of the visible contents of every key, in order."""
    visible = elements.where(~F.col("ignored") & (F.trim("content") != ""))
    return visible.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "content"))), lambda x: x["content"]), "\n\n").alias("text"))


def page_text(elements: DataFrame) -> DataFrame:
    return joined_text(elements, ["doc_id", "page_id"])


def dq_structure(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with repeated element ids, a gap in the order, or elements on unknown pages."""
    order = elements.groupBy("doc_id").agg((F.countDistinct("element_id") < F.count("*")).alias("repeated_ids"), ((F.min("order") != 0) | (F.max("order") != F.count("*") - 1) | (F.countDistinct("order") < F.count("*"))).alias("order_gap"))
    lost = elements.where("page_id is not null").join(pages.select("doc_id", "page_id").distinct(), ["doc_id", "page_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown_pages"))
    return order.join(lost, "doc_id", "left").select("doc_id", "repeated_ids", "order_gap", F.coalesce("unknown_pages", F.lit(0)).alias("unknown_pages"))


def dq_types_and_links(elements: DataFrame, tree: DataFrame) -> DataFrame:
    """Elements of unknown type, or that their parent does not list."""
    parents = tree.select("doc_id", F.col("element_id").alias("parent_id"), F.col("children_ids").alias("siblings"))
    linked = tree.join(parents, ["doc_id", "parent_id"], "left").select("doc_id", "element_id", (F.col("parent_id").isNotNull() & ~F.coalesce(F.array_contains("siblings", F.col("element_id")), F.lit(False))).alias("unlisted"))
    return elements.join(linked, ["doc_id", "element_id"], "left").select("doc_id", "element_id", (F.col("type") == "unknown").alias("unknown_type"), F.coalesce("unlisted", F.lit(False)).alias("unlisted"))


def fold_text(text: Column) -> Column:
    """Quotes, ligatures and white space made uniform."""
    plain = F.translate(text, "‘’“” ", "''\"\" ")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def dq_completeness(texts: DataFrame, snippets: DataFrame) -> DataFrame:
    """Whether each required snippet (doc_id, snippet) occurs in its document's text."""
    return snippets.join(texts, "doc_id", "left").select("doc_id", "snippet", F.coalesce(F.contains(fold_text(F.col("text")), fold_text(F.col("snippet"))), F.lit(False)).alias("present"))
