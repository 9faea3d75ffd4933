"""Golden cases of the operators, on small inline tables."""

import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import model, split, tokens
from corpusloom.operators import bookkeeping, chunk, context, evaluate, intake, parse, query, render, retrieval, sweep, vectors
from corpusloom.sources import files

ELEMENT = "doc_id string, element_id string, order int, type string, format string, content string, level int, ignored boolean, page_id string, asset_uri string"


def elements(spark, *rows):
    return spark.createDataFrame([("doc", f"e{i}", i, kind, "text", text, level, ignored, page, uri) for i, (kind, text, level, ignored, page, uri) in enumerate(rows)], ELEMENT)


def block(kind, text, level=None, ignored=False, page=None, uri=None):
    return kind, text, level, ignored, page, uri


@pytest.mark.parametrize(("text", "lang", "n"), [("abcdefgh", "en", 2), ("안녕하세요반갑습니다", "ko", 15), ("abcd안녕", "ko", 4), ("", "en", 0), (None, "ko", 0), ("a", "en", 1)])
def test_token_count(spark, text, lang, n):
    row = spark.createDataFrame([(text, lang)], "t string, l string").select(tokens.token_count(F.col("t"), F.col("l")).alias("n")).first()
    assert row.n == n


def test_token_truncate(spark):
    rows = spark.createDataFrame([("안녕하세요", "ko"), ("abcdefghijklmnopqrstuvwxyz", "en")], "t string, l string")
    assert [r.t for r in rows.select(tokens.token_truncate(F.col("t"), F.col("l"), 5).alias("t")).collect()] == ["안녕하", "abcdefghijklmnopqrst"]


def test_plain_text_paragraphs(spark):
    rows = parse.parse_plain_text(spark.createDataFrame([(1, "one\r\n\r\ntwo\n \nthree\n\n"), (2, None), (3, "")], "doc_id long, text string")).orderBy("order").collect()
    assert [(r.doc_id, r.element_id, r.content) for r in rows] == [("1", "1_el_0", "one"), ("1", "1_el_1", "two"), ("1", "1_el_2", "three")]


MARKDOWN = """# Heading 1

Some paragraph with *italic* and **bold** text.

- Item A
- Item B

| Header 1 | Header 2 |
|---|---|
| Value 1 | Value <2> |

```python
# Code block
print("Hello")
```
<div>raw</div>

2. x
"""


def test_markdown_blocks():
    found = parse.markdown_blocks(MARKDOWN)
    assert [(k, f, lv) for k, f, _, lv, _ in found] == [("heading", "markdown", 1), ("paragraph", "markdown", None), ("list", "markdown", None), ("table", "html", None), ("paragraph", "markdown", None), ("paragraph", "html", None), ("list", "markdown", None)]
    assert found[2][2] == "- Item A\n- Item B" and "<td>Value 1</td>" in found[3][2] and "&lt;2&gt;" in found[3][2]
    assert found[4][2] == '```python\n# Code block\nprint("Hello")\n```' and found[6][2] == "1. x"
    assert parse.markdown_blocks("Title\n=====\ntext\n---") == [("heading", "markdown", "Title", 1, False), ("heading", "markdown", "text", 2, False)]
    assert parse.markdown_blocks(None) == [] and parse.markdown_blocks("- a\n  more\n- b")[0][2] == "- a\nmore\n- b"


def test_html_blocks():
    page = "<html><head><title>T</title><meta name=d></head><body><nav><a>Home</a></nav><h1>Welcome</h1><p>Text&amp;more<!-- no --></p><aside><p>Side</p><script>x()</script></aside><ul><li>one<li>two</ul><table class=a><tr><td>1<td>2</tr></table>tail</body>"
    found = parse.html_blocks(page)
    visible = [(k, c, lv) for k, _, c, lv, hidden in found if not hidden]
    assert visible == [("heading", "Welcome", 1), ("paragraph", "Text&more", None), ("list_item", "one", None), ("list_item", "two", None), ("table", '<table class="a"><tr><td>1<td>2</tr></table>', None), ("paragraph", "tail", None)]
    assert {c for _, _, c, _, hidden in found if hidden} == {"T", "Home", "Side", "x()"}
    assert parse.html_blocks(None) == []


@pytest.mark.parametrize(
    ("markdown", "want"),
    [
        ("# A\n\nb\nc\n\n- x\n- <y>", "<h1>A</h1>\n<p>b<br>c</p>\n<ul><li>x</li><li>&lt;y&gt;</li></ul>"),
        ("1. x\n2. y", "<ol><li>x</li><li>y</li></ol>"),
        ("| a | b |\n| --- | :---: |\n| 1 | 2 |", "<table>\n  <thead><tr><th>a</th><th>b</th></tr></thead>\n  <tbody>\n    <tr><td>1</td><td>2</td></tr>\n  </tbody>\n</table>"),
        ('![t](u "x")', '<img src="u" alt="t">'), ("![t](u) more", "<p>![t](u) more</p>"), ("####### no", "<p>####### no</p>"), ("", ""),
    ],
)
def test_markdown_as_html(spark, markdown, want):
    assert spark.createDataFrame([(markdown,)], "t string").select(render.markdown_html(F.col("t")).alias("h")).first().h == want


def test_pictures_and_fallbacks(spark):
    rows = elements(spark, block("image", "a[b]", uri="u.png"), block("image", "", uri="v.png"), block("image", "no source"))
    docs = spark.createDataFrame([("doc", "x", "y", "z"), ("own", " ", "# T", "z"), ("text", "", "", "z")], "doc_id string, html string, markdown string, text string")
    html = {r.doc_id: r.html for r in render.render_html(rows, docs).collect()}
    assert html == {"doc": '<figure><img src="u.png" alt="a[b]"><figcaption>a[b]</figcaption></figure>\n<img src="v.png" alt="">\n<p>no source</p>', "own": "<h1>T</h1>", "text": "<p>z</p>"}
    assert {r.doc_id: r.markdown for r in render.render_markdown(rows, docs).collect()} == {"doc": "![a\\[b\\]](u.png)\n\n![](v.png)\n\nno source", "own": "# T", "text": "z"}


@pytest.mark.parametrize(("numbers", "want"), [([3, 1, 2], [1, 2, 3]), ([1, 1, 2], [1, 2, 3]), ([None, 5], [1, 2])])
def test_page_json_numbers(spark, numbers, want):
    pages = [(n, f"text {i}", None) for i, n in enumerate(numbers)]
    docs = spark.createDataFrame([("d", pages)], "doc_id string, pages array<struct<page_no:int,text:string,page_boxes:array<struct<class:string,pos:array<int>,bbox:array<double>>>>>")
    rows = parse.normalize_page_json(docs).orderBy("order").collect()
    assert [r.page_id for r in rows] == [f"d_page_{n}" for n in want]
    if want == sorted(n or 0 for n in numbers):
        assert [r.content for r in rows] == ["text 1", "text 2", "text 0"]


def test_page_json_boxes(spark):
    boxes = [("section-header", [0, 9], [0.0, 1.0, 2.0, 3.0]), ("table", [9, 13], None), ("text", [5], None)]
    docs = spark.createDataFrame([("d", [(1, "## Title tabl", boxes)])], "doc_id string, pages array<struct<page_no:int,text:string,page_boxes:array<struct<class:string,pos:array<int>,bbox:array<double>>>>>")
    rows = parse.normalize_page_json(docs).orderBy("order").collect()
    assert [(r.type, r.content, r.level) for r in rows] == [("heading", "Title", 2), ("table", "tabl", None)]


def test_elements_leave_a_worker_in_pieces():
    """Frames are made as rows are asked for, and hold a bounded number of them."""
    made = []
    rows = ((made.append(k) or "d", f"d_el_{k}", k, "paragraph", "text", "x", None, False) for k in range(2 * parse.ELEMENTS_AT_ONCE + 1))
    frames = parse._frames(rows, parse.ELEMENTS, {"order": "int32", "level": "Int32", "ignored": bool})
    assert len(next(frames)) == len(made) == parse.ELEMENTS_AT_ONCE
    assert [len(f) for f in frames] == [parse.ELEMENTS_AT_ONCE, 1]


def test_layout_items(spark):
    node = lambda label, **more: {"label": label, **more}
    box = {"l": 1, "t": 90, "r": 5, "b": 80, "coord_origin": "BOTTOMLEFT"}
    cell = lambda r, c, text, **more: {"start_row_offset_idx": r, "start_col_offset_idx": c, "text": text, **more}
    data = {
        "pages": {"1": {"page_no": 1, "size": {"height": 100, "width": 50}}},
        "body": {"children": [{"$ref": r} for r in ("#/texts/1", "#/groups/0", "#/texts/1", "#/tables/0", "#/pictures/0", "#/texts/3", "#/texts/4", "#/texts/5", "#/tables/1", "#/texts/99", "#/odd/0")]},
        "groups": [node("list", children=[{"$ref": "#/texts/0"}, {"$ref": "#/texts/2"}, {"$ref": "#/texts/9"}])],
        "texts": [node("checkbox_selected", text="done"), node("title", text="T", prov=[{"page_no": 1, "bbox": box}]), node("list_item", text="a", marker="*"), node("page_footer", text="7"), node("field_key", text="key"), node("stamp", text="odd")],
        "tables": [node("table", children=[{"$ref": "#/texts/4"}], data={"num_rows": 2, "num_cols": 2, "table_cells": [cell(0, 0, "a&b", col_span=2, column_header=True), cell(1, 1, "c")]}), node("document_index", data={"num_rows": 1, "num_cols": 1, "table_cells": [cell(0, 0, "i")]})],
        "pictures": [node("picture", image={"uri": "u.png"}, children=[{"$ref": "#/texts/6"}])],
    }
    data["texts"].append(node("caption", text="fig"))
    rows = parse.normalize_layout_json(spark.createDataFrame([("d", json.dumps(data)), ("none", None)], "doc_id string, json string")).orderBy("order").collect()
    assert [(r.type, r.content, r.parent_id) for r in rows] == [
        ("heading", "T", None), ("list", "", None), ("paragraph", "[x] done", "d_el_1"), ("list_item", "* a", "d_el_1"),
        ("table", '<table>\n  <tr><th colspan="2">a&amp;b</th></tr>\n  <tr><td></td><td>c</td></tr>\n</table>', None), ("image", "", None), ("caption", "fig", "d_el_5"), ("page_footer", "7", None), ("paragraph", "key", None),
        ("unknown", "odd", None), ("section_index", "<table>\n  <tr><td>i</td></tr>\n</table>", None),
    ]
    assert [r.ignored for r in rows] == [r.type in ("page_footer", "section_index") for r in rows]
    assert (rows[0].level, rows[0].role, rows[0].page_no, rows[0].bbox) == (1, "title", 1, [1.0, 10.0, 5.0, 20.0]) and rows[5].asset_uri == "u.png" and rows[5].format == "asset_ref"
    assert [tuple(c) for c in rows[4].cells] == [(0, 0, 1, 2, True, "a&b"), (1, 1, 1, 1, False, "c")]
    tree = {r.element_id: r for r in parse.heading_tree(spark.createDataFrame(rows)).collect()}
    assert tree["d_el_2"].parent_id == "d_el_1" and tree["d_el_8"].parent_id == "d_el_0" and tree["d_el_1"].children_ids == ["d_el_2", "d_el_3"]
    assert set(parse.LAYOUT_TYPES) >= set(parse.LAYOUT_ROLES) and len(parse.LAYOUT_TYPES) == 33


def test_breadcrumbs_and_merge(spark):
    rows = elements(spark, block("heading", "취업규칙", 1), block("heading", "휴일 및 휴가", 2), block("paragraph", "본문"), block("heading", "보안 규정", 1), block("list_item", "- 비밀번호"), block("list_item", "- 외부"), block("heading", "hidden", 1, True), block("image", "차[트]", uri="s3://b/c.png"))
    chunks = chunk.semantic_chunk(rows).orderBy("order").collect()
    assert [c.page_content for c in chunks] == ["취업규칙 > 휴일 및 휴가: 본문", "보안 규정: - 비밀번호\n- 외부", r"보안 규정: ![차\[트\]](s3://b/c.png)"]
    assert chunks[1].type == "merged" and chunks[1].element_ids == ["e4", "e5"] and chunks[1].chunk_id == "doc:chunk:0002"


def test_breadcrumb_depth(spark):
    rows = elements(spark, *(block("heading", f"h{k}", k) for k in range(1, 6)), block("paragraph", "x"))
    crumb = lambda **c: chunk.breadcrumb(rows, chunk.ChunkConfig(**c)).first().breadcrumb
    assert crumb() == ["h1", "h4", "h5"] and crumb(include_root=False) == ["h3", "h4", "h5"] and crumb(breadcrumb_depth=0) == [] and crumb(breadcrumb_depth=9) == ["h1", "h2", "h3", "h4", "h5"]


def test_breadcrumb_equals_a_stack(spark):
    import random

    r = random.Random(3)
    rows = [block(*(("heading", f"h{i}", r.randint(1, 4)) if r.random() < 0.5 else ("paragraph", f"p{i}")), ignored=r.random() < 0.1) for i in range(200)]
    stack, want = [], {}
    for i, (kind, text, level, ignored, *_) in enumerate(rows):
        if not ignored and kind == "heading":
            stack = [*(s for s in stack if s[0] < level), (level, text)]
        elif not ignored:
            want[f"e{i}"] = [t for _, t in stack]
    got = {x.element_id: x.breadcrumb for x in chunk.breadcrumb(elements(spark, *rows), chunk.ChunkConfig(breadcrumb_depth=9)).collect()}
    assert got == want


def test_split_parts_and_navigation(spark):
    text = "alpha beta gamma delta epsilon zeta"
    rows = elements(spark, block("paragraph", text, page="p1"), block("paragraph", "next", page="p1"), block("paragraph", "last", page="p2"))
    chunks = chunk.semantic_chunk(rows, chunk.ChunkConfig(chunk_size=20, chunk_overlap=0))
    parts = chunks.where("is_split").orderBy("order").collect()
    assert [p.part_index for p in parts] == list(range(len(parts))) and all(p.part_count == len(parts) for p in parts) and " ".join(p.page_content for p in parts) == text
    nav = chunk.chunk_navigation(chunks).orderBy("order").collect()
    assert nav[0].previous_chunk_id is None and nav[-1].next_chunk_id is None and nav[1].previous_chunk_id == nav[0].chunk_id
    assert [n.first_on_page for n in nav] == [True] + [False] * (len(nav) - 2) + [True] and nav[-2].last_on_page and nav[-1].last_on_page


def test_chunk_fallback_and_prefix(spark):
    rows = elements(spark, block("heading", "only", 1))
    fallback = spark.createDataFrame([("doc", " whole "), ("blank", "  ")], "doc_id string, markdown string")
    prefixes = chunk.summary_prefix(spark.createDataFrame([("doc", "s" * 300, "en")], "doc_id string, summary string, lang string"))
    got = chunk.semantic_chunk(rows, prefixes=prefixes, fallback=fallback).collect()
    assert [c.page_content for c in got] == ["[Document Summary: " + "s" * 225 + "...]\n\nwhole"]


def test_split_text_rules():
    assert split.split_text("a" * 10, 4, 0) == ["aaaa", "aaaa", "aa"]
    assert split.split_text("one. two. three", 9, 0) == ["one. two", ". three"]
    image = "![x](http://h/" + "y" * 40 + ".png)"
    parts = split.split_keeping_images(f"before {image} after", 20, 0)
    assert parts == ["before", image, "after"]
    assert split.split_keeping_images("see ![a](http://h/x(1).png) end", 450, 0) == ["see", "![a](http://h/x(1)", ".png) end"]  # the target ends at the first closing bracket
    assert split.split_keeping_images("see ![b]( c.png ) end", 450, 0) == ["see ![b]( c.png ) end"]  # no image: a target has no white space
    words = " ".join(f"w{i}" for i in range(100))
    cut = split.split_text(words, 50, 20)
    assert all(len(c) <= 50 for c in cut) and {w for c in cut for w in c.split()} == set(words.split())
    assert split.split_text("", 5, 0) == []


def test_page_packing(spark):
    rows = elements(spark, *(block("paragraph", "x" * n) for n in (30, 30, 90, 10, 50)))
    assert [r.page_no for r in parse.assign_pages(rows, 70).orderBy("order").collect()] == [1, 1, 2, 3, 3]


def test_paging_keeps_the_elements(spark):
    rows = elements(spark, *(block("paragraph", "x" * n, n if n > 40 else None, uri=None) for n in (30, 30, 90, 10, 50)))
    paged = parse.with_pages(rows.drop("page_id"), 70).orderBy("order").collect()
    assert [(r.page_no, r.page_id, len(r.content), r.level) for r in paged] == [(1, "doc_page_1", 30, None), (1, "doc_page_1", 30, None), (2, "doc_page_2", 90, 90), (3, "doc_page_3", 10, None), (3, "doc_page_3", 50, 50)]


def test_chunk_pages_and_boxes(spark):
    chunks = spark.createDataFrame([("d", "c1", [0, 1], ["p9", "p8", "p9"], ["text", "text"]), ("d", "c2", [2], ["p7"], ["table"])], "doc_id string, chunk_id string, orders array<int>, page_ids array<string>, types array<string>")
    pages = spark.createDataFrame([("d", "p9", 1), ("d", "p8", 2)], "doc_id string, page_id string, page_no int")
    boxes = spark.createDataFrame([("d", 0, [1.0, 2.0, 3.0, 4.0]), ("d", 1, None), ("d", 2, None)], "doc_id string, order int, bbox array<double>")
    got = {r.chunk_id: (r.page_numbers, r.source_bboxes, r.element_order_end, r.source_types) for r in chunk.chunk_metadata(chunks, pages, boxes).collect()}
    assert got == {"c1": ([1, 2], [[1.0, 2.0, 3.0, 4.0]], 1, ["text"]), "c2": ([], [], 2, ["table"])}
    assert {r.chunk_id: r.page_numbers for r in chunk.chunk_metadata(chunks).collect()} == {"c1": [9, 8], "c2": [7]}


def test_table_grid(spark):
    cells = spark.createDataFrame([("t", 2, 2, 0, 0, 1, 2, True, "a&b"), ("t", 2, 2, 1, 1, 1, 1, False, "c"), ("t", 2, 2, 9, 9, 1, 1, False, "out")], "table_id string, n_rows int, n_cols int, row int, col int, row_span int, col_span int, header boolean, text string")
    row = parse.table_grid_html(cells).first()
    assert row.html == '<table>\n  <tr><th colspan="2">a&amp;b</th></tr>\n  <tr><td></td><td>c</td></tr>\n</table>' and row.is_complex


def test_rendering(spark):
    rows = elements(spark, block("heading", "T", 2), block("caption", "fig"), block("equation", "x=1"), block("list_item", "- a"), block("code", "y"), block("paragraph", "<b>"), block("page_footer", "7", None, True))
    assert render.render_markdown(rows).first().markdown == "## T\n\n*fig*\n\n$$\nx=1\n$$\n\n- a\n\n```\ny\n```\n\n<b>"
    assert render.render_html(rows).first().html == '<h2>T</h2>\n<p><em>fig</em></p>\n<pre><code class="language-latex">x=1</code></pre>\n<ul><li>a</li></ul>\n<pre><code>y</code></pre>\n<p>&lt;b&gt;</p>'
    assert render.pipe_table("<table><tr><th>a<th>b|c</tr><tr><td>1</td></tr></table>") == render.pipe_table("<table><TR><th>a</th><th><b>b|c</b></th></tr>\n<tr><td> 1\n</td></tr></table>") == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert render.pipe_table("<table>no cell</table>") == "no cell"
    assert render.strip_tags("<p>a</p><img src=u alt=t><br><br><br><br>b") == "a\n![t](u)\n\nb"


def test_bm25_weight(spark):
    chunks = spark.createDataFrame([("c", ["t"] * 10)], "chunk_id string, tokens array<string>")
    assert vectors.bm25_doc_weights(chunks, avg_length=100.0).first().weight == pytest.approx(2.38379, abs=1e-4)


def test_colliding_term_ids_add_up(spark):
    postings = spark.createDataFrame([("c", "a", 1.0), ("c", "b", 2.0), ("d", "b", 4.0), ("d", "z", 1.0)], "chunk_id string, term string, weight double")
    ids = {t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") for t in "abz"}
    got = {r.chunk_id: (r.indices, r["values"]) for r in vectors.bm25_doc_vectors(postings).collect()}
    want = {"c": {ids["a"]: 1.0, ids["b"]: 2.0}, "d": {ids["b"]: 4.0, ids["z"]: 1.0}}
    assert got == {k: (sorted(v), [v[i] for i in sorted(v)]) for k, v in want.items()}


def test_scan_equals_postings(spark):
    import random

    r = random.Random(5)
    rows = [(f"c{i}", [r.choice("abcdefgh") for _ in range(r.randint(0, 30))]) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, tokens array<string>").repartition(5)
    queries = vectors.bm25_query_weights(spark.createDataFrame([(i, [r.choice("abcdefghxyz") for _ in range(4)]) for i in range(9)], "query_id long, tokens array<string>"))
    postings = vectors.bm25_doc_weights(chunks)
    plain = sorted(map(tuple, vectors.sparse_topk(postings, queries, 7).select("query_id", "chunk_id", "rank", "score").collect()))
    assert sorted(map(tuple, vectors.sparse_topk_scan(chunks, queries, 7).select("query_id", "chunk_id", "rank", "score").collect())) == plain and len(plain) == 63
    idf = sorted(map(tuple, vectors.sparse_topk(postings, queries, 7, vectors.corpus_idf(postings, chunks)).select("query_id", "chunk_id", "rank").collect()))
    assert sorted(map(tuple, vectors.sparse_topk_scan(chunks, vectors.query_idf(chunks, queries), 7).select("query_id", "chunk_id", "rank").collect())) == idf


def test_similar_pairs_by_blocks(spark, monkeypatch):
    """Products of blocks give what the column functions give, also for equal, zero, null and shorter vectors."""
    import random

    r = random.Random(9)
    vector = lambda: [r.uniform(-3, 3) for _ in range(8)]
    rows = [(k, k % 3 if k % 20 else None, vector()) for k in range(120)] + [(200, 1, [0.0] * 8), (201, 1, None), (202, 1, [1.0, 2.0]), (203, 1, [1.0, None] * 4)]
    near = [x + 1e-4 for x in rows[1][2]]
    chunks = spark.createDataFrame([*rows, (204, 1, rows[1][2]), (205, 1, near)], "chunk_id long, kb_id int, embedding array<float>").repartition(3)
    queries = chunks.where("chunk_id % 7 = 1 or chunk_id >= 200").withColumnRenamed("chunk_id", "query_id")
    pairs = queries.withColumnRenamed("embedding", "e").join(chunks, "kb_id")
    metrics = ("dot", "cosine", "euclid")
    want = pairs.select("query_id", "chunk_id", *((F.round(vectors.vector_similarity(F.col("e"), F.col("embedding"), m), 6) + 0.0).alias(m) for m in metrics))
    monkeypatch.setattr(vectors, "QUERY_BLOCK_BYTES", 400)
    monkeypatch.setattr(vectors, "PAIRS_AT_ONCE", 7)
    found = vectors.similar_pairs(chunks, queries)
    key = lambda df: sorted((tuple(x) for x in df.select("query_id", "chunk_id", *((F.round(m, 6) + 0.0).alias(m) for m in metrics)).collect()), key=lambda x: x[:2])
    assert key(found) == key(want) and len(key(want)) > 700


def test_weights_without_a_shuffle(spark, tmp_path):
    """Terms are counted in their chunk's row; rows of one chunk_id and length count together."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [("c0", "b a b é a b".split()), ("c1", []), ("c2", None), ("c3", ["x"]), (None, ["a"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, tokens array<string>")
    chunks.write.parquet(str(tmp_path / "chunks"))
    weights = vectors.bm25_doc_weights(spark.read.parquet(str(tmp_path / "chunks")))
    assert "Exchange" not in plan(weights)
    assert {(r.chunk_id, r.term, r.tf) for r in weights.collect()} == {("c0", "a", 2), ("c0", "b", 3), ("c0", "é", 1), ("c3", "x", 1), (None, "a", 1)}
    twice = chunks.unionByName(spark.createDataFrame([("c3", ["x"]), ("c3", ["x", "y"])], chunks.schema))
    got = sorted((r.chunk_id or "", r.term, r.tf, round(r.weight, 6)) for r in vectors.bm25_doc_weights(twice).collect())
    weight = lambda tf, n: round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 300)), 6)
    assert got == sorted([("", "a", 1, weight(1, 1)), ("c0", "a", 2, weight(2, 6)), ("c0", "b", 3, weight(3, 6)), ("c0", "é", 1, weight(1, 6)), ("c3", "x", 2, weight(2, 1)), ("c3", "x", 1, weight(1, 2)), ("c3", "y", 1, weight(1, 2))])


def test_postings_search_in_tasks(spark):
    """Every task keeps its own k best, for every knowledge base; postings of one chunk and term add up."""
    import random

    r = random.Random(6)
    rows = sorted((f"c{r.randrange(400)}", r.choice("abcdefgh"), float(r.randint(1, 9))) for _ in range(3000))
    postings = spark.createDataFrame(rows, "chunk_id string, term string, weight double").repartition(7)
    wanted = [(q, t, float(q % 3 + 1)) for q in range(12) for t in r.sample("abcdefghz", 3)]
    queries = spark.createDataFrame(wanted, "query_id long, term string, weight double")
    kbs = [(f"c{i}", kb) for i in range(400) for kb in ("xy" if i % 5 == 0 else "xyz"[i % 3])]
    scores = {}
    for q, t, w in wanted:
        for c, term, v in rows:
            if term == t:
                scores[q, c] = scores.get((q, c), 0) + w * v
    best = lambda names: {(q, c, s) for q in range(12) for c, s in sorted(((c, s) for (p, c), s in scores.items() if p == q and c in names), key=lambda x: (-x[1], x[0]))[:5]}
    found = vectors.sparse_topk(postings, queries, 5)
    assert {(x.query_id, x.chunk_id, x.score) for x in found.collect()} == best({c for c, _ in kbs})
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    grouped = vectors.sparse_topk(postings, queries, 5, chunk_kb=spark.createDataFrame(kbs, "chunk_id string, kb_id string"))
    assert {(x.kb_id, x.query_id, x.chunk_id, x.score) for x in grouped.collect()} == {(kb, *x) for kb in "xyz" for x in best({c for c, k in kbs if k == kb})}


def test_similarities(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    get = lambda m: [r.s for r in rows.select(vectors.vector_similarity(F.col("a"), F.col("b"), m).alias("s")).collect()]
    assert get("dot") == [3.0, 0.0] and get("cosine") == [pytest.approx(0.6), 0.0] and get("euclid")[0] == pytest.approx(-(20**0.5))


def test_dense_topk_metrics(spark):
    chunks = spark.createDataFrame([(i, "k", [float(i), 1.0]) for i in range(6)] + [(9, "other", [9.0, 9.0])], "chunk_id long, kb_id string, embedding array<float>")
    queries = spark.createDataFrame([(0, "k", [2.0, 1.0])], "query_id long, kb_id string, embedding array<float>")
    ids = lambda m: [r.chunk_id for r in vectors.dense_topk(chunks, queries, 2, m).orderBy("rank").collect()]
    assert ids("dot") == [5, 4] and ids("euclid") == [2, 1] and ids("cosine") == [2, 3]


HIT = "request_id string, kb_pos int, query_pos int, rank int, chunk_id string, doc_id string, page_ids array<string>, score double"


def test_dedup_keeps_the_first(spark):
    hits = spark.createDataFrame([("r", 1, 0, 1, "a", "d", ["p"], 0.9), ("r", 0, 0, 2, "a", "d", ["p"], 0.1)], HIT)
    assert [r.score for r in retrieval.dedup_chunks(hits).collect()] == [0.1]


def test_failed_searches_are_dropped(spark):
    hits = spark.createDataFrame([("r", kb, q, 1, f"c{kb}{q}", "d", ["p"], 0.9) for kb in (0, 1) for q in (0, 1)], HIT)
    failed = spark.createDataFrame([("r", 1, 0), ("r", 1, 0), ("other", 0, 0)], "request_id string, kb_pos int, query_pos int")
    assert {r.chunk_id for r in retrieval.without_failed(hits, failed).collect()} == {"c00", "c01", "c11"}


def test_page_dedup(spark):
    hits = spark.createDataFrame([("r", 0, 0, i, f"chunk_{i}", "d", pages, 1.0 - i / 10) for i, pages in enumerate([["p1"], ["p1"], ["p2"], ["p1", "p2"], ["p2", "p3"], None], 1)], HIT)
    ids = lambda n: [r.chunk_id for r in retrieval.page_dedup(retrieval.rank_by_score(hits), n).orderBy("final_rank").collect()]
    assert ids(2) == ["chunk_1", "chunk_3"] and ids(9) == ["chunk_1", "chunk_3", "chunk_5", "chunk_6"]


def test_synonyms(spark):
    rows = spark.createDataFrame([("m-rag is awesome",), ("m-ragged",), (None,)], "query string")
    words = [("m-rag", ["modular rag", "모듈형 rag"]), ("", ["x"]), ("rag", [])]
    assert [r.expanded for r in query.synonym_expand(rows, words).collect()] == ["m-rag (modular rag, 모듈형 rag) is awesome", "m-ragged", None]
    ko = spark.createDataFrame([("m-rag은 xm-rag",)], "query string")
    accents = spark.createDataFrame([(0, "ñla la LA laè la_b ÉTÉ"), (1, "lala été")], "id long, query string")
    assert [r.expanded for r in query.synonym_expand(accents, [("la", ["le"])]).orderBy("id").collect()] == ["ñla (le) la (le) la (le) la (le)è la_b ÉTÉ", "lala été"]
    assert query.synonym_expand(ko, words[:1], "ko").first().expanded == "m-rag (modular rag, 모듈형 rag)은 xm-rag"


KB_CASES = [([], None, "READY"), (["COMPLETED"], None, "COMPLETED"), (["COMPLETED", "READY"], None, "READY"), (["FAILED", "COMPLETED"], None, "FAILED"), (["FAILED", "PARSING"], None, "RUNNING"), (["DELETING"], None, "RUNNING"), (["COMPLETED"], "DELETING", "DELETING"), (["READY"], None, "READY"), *(([s], None, "RUNNING") for s in bookkeeping.RUNNING)]


def test_kb_status_table(spark):
    kbs = spark.createDataFrame([(str(i), now) for i, (_, now, _) in enumerate(KB_CASES)], "kb_id string, status string")
    docs = spark.createDataFrame([(str(i), s) for i, (statuses, _, _) in enumerate(KB_CASES) for s in statuses], "kb_id string, status string")
    got = {r.kb_id: r.status for r in bookkeeping.kb_status(kbs, docs).collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(KB_CASES)}


def test_overview_and_counts(spark):
    kbs = spark.createDataFrame([("READY", "m"), ("COMPLETED", "n"), ("RUNNING", "m"), ("FAILED", ""), ("READY", None)], "status string, model string")
    assert tuple(bookkeeping.kb_overview(kbs).first()) == (5, 3, 2)
    docs = spark.createDataFrame([("k", s, '{"size_bytes": 3}') for s in ("QUEUED", "PARSING", "CHUNKING", "EMBEDDING", "DELETING", "FAILED", "COMPLETED", "READY")], "kb_id string, status string, info string")
    row = bookkeeping.kb_stats(docs).first()
    assert (row.documents, row.completed, row.processing, row.failed, row.total_bytes) == (8, 1, 3, 1, 24)


def test_judges_read_a_bounded_context(spark):
    rows = spark.createDataFrame([(["a" * 4000, "b" * 4000],), ([],), (None,)], "c array<string>")
    got = [r.t for r in rows.select(evaluate.judge_context(F.col("c")).alias("t")).collect()]
    assert got == ["a" * 4000 + "\n\n" + "b" * 1998, "(no context retrieved)", "(no context retrieved)"]


def test_upsert_actions(spark):
    current = spark.createDataFrame([("k", "a", "1", "COMPLETED"), ("k", "b", "1", "FAILED"), ("k", "c", "1", "COMPLETED"), ("k", "d", "1", "READY")], "kb_id string, name string, file_hash string, status string")
    incoming = spark.createDataFrame([("k", "a", "1"), ("k", "b", "1"), ("k", "c", "2"), ("k", "e", "1")], "kb_id string, name string, file_hash string")
    got = {r.name: (r.action, r.status, r.cleanup_hash) for r in intake.versioned_upsert(current, incoming).collect()}
    assert got == {"a": ("keep", "COMPLETED", None), "b": ("requeue", "QUEUED", None), "c": ("overwrite", "QUEUED", "1"), "d": ("untouched", "READY", None), "e": ("insert", "QUEUED", None)}


def test_context_packing():
    assert context.pack_sections(["a" * 10, "b. " + "c" * 20], 20, False) == "a" * 10 + "\n\nb. ccccccc"
    assert context.pack_sections(["one two three. four five"], 18, False) == "one two three."
    assert context.pack_sections(["a" * 10, "b" * 10], 12, True) == "a" * 10 and context.pack_sections(["a" * 10, "b" * 10], 12, False).endswith("bb")


def test_contexts_are_packed_on_the_jvm(spark):
    """As pack_sections packs them, and no list of texts goes to Python."""
    import random

    r = random.Random(8)
    texts = ["".join(r.choices(["a", "é", "😀", ".", "\n", " ", "\u2003", "\x1c"], [5, 2, 1, 1, 1, 2, 1, 1], k=r.randrange(40))) for _ in range(300)]
    rows = [(k // 5, k % 5, t, 0.5) for k, t in enumerate(texts)]
    hits = spark.createDataFrame(rows, "request_id int, final_rank int, content string, score double").selectExpr("*", "'kb' kb_id", "'d' doc_id", "'c' chunk_id", "cast(null as double) rerank_score", *(f"cast(null as string) {c}" for c in ("source", "page", "page_content")))
    head = lambda i: f"[{i + 1}] kb=kb doc=d chunk=c score=0.5000\n"
    for limit in (20, 45, 60, 110, 150, 10_000):
        for separator in (False, True):
            found = context.format_context(hits, limit, separator)
            assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
            assert dict(map(tuple, found.collect())) == {q: context.pack_sections([head(i) + texts[5 * q + i] for i in range(5)], limit, separator) for q in range(60)}


def test_tree_reduce(spark):
    long = [(1, i, f"sentence {i} of the text. more words here to fill it up") for i in range(60)] + [(2, 0, "short one. two")]
    texts = spark.createDataFrame(long, "doc_id long, order int, content string")
    got = {r.doc_id: r for r in context.tree_reduce(texts, 60, lambda t: t[:20]).collect()}
    assert got["2"].summary == "short one. two" and got["1"].summary and got["1"].depth >= 1
    assert {(r.summary, r.depth, r.error) for r in context.tree_reduce(texts.where("doc_id = 1"), 60, lambda t: t + t).collect()} == {(None, 0, "summaries do not shrink")}
    assert {(r.summary, r.depth, r.error) for r in context.tree_reduce(texts.where("doc_id = 1"), 60, lambda t: t[:-1], max_depth=1).collect()} == {(None, 1, "too many levels")}
    assert {r.error for r in got.values()} == {None}


def test_results_of_many_keys_leave_together(spark):
    """Keys that span batches are whole, and a task makes few frames however many keys it has."""
    from corpusloom.functions.ordered import ordered_fold

    rows = spark.range(3000).selectExpr("cast(id % 300 as string) k", "cast(id as int) o", "cast(id as string) v").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = ordered_fold(rows, "k", "o", "v", lambda k, values: [(k, len(values), ",".join(values))], "k string, n int, v string", {"n": "int32"})
        assert {tuple(r) for r in found.collect()} == {(str(k), 10, ",".join(str(k + 300 * j) for j in range(10))) for k in range(300)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_compress_fallbacks(spark):
    rows = spark.createDataFrame([("r", 0, 0.3, ["a", "b"], ["x", "y"])], "request_id string, batch int, target_ratio double, ids array<string>, contents array<string>")

    def fails(texts, ratio):
        raise RuntimeError

    out = lambda f: [(r.chunk_id, r.content, r.original_chunks) for r in context.compress_apply(rows, f).collect()]
    assert out(fails) == [("a", "x", None), ("b", "y", None)] and out(lambda t, r: ["xy"]) == [("a", "xy", ["a", "b"])] and out(lambda t, r: [s * 2 for s in t]) == [("a", "xx", None), ("b", "yy", None)]


def test_model_fallback(spark):
    def fails(prompts):
        raise RuntimeError

    rows = spark.createDataFrame([(1, "p")], "i int, t string")
    assert model.model_map(rows, "t", fails).first().reply == "p" and model.model_map(rows, "t", fails, fallback="TARGETED_RAG").first().reply == "TARGETED_RAG"


def test_model_json(spark):
    replies = ['```json\n{"question": "q", "answer": "a", "answerable": true}\n```', 'x {"question": " ", "answer": "a", "answerable": true}', "none", '{"question": "q", "answer": "b", "answerable": false}', None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    assert [(r.i, r.question, r.answer) for r in evaluate.parse_model_json(rows).collect()] == [(0, "q", "a")]
    scores = spark.createDataFrame([('{"score": 1.7}',), ('{"score": "bad"}',), ("x",), ('{"score": -1}',), ('{"score": 0.25}',)], "reply string")
    assert [r.s for r in scores.select(evaluate.judge_score(F.col("reply")).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.25]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.md").write_bytes("é".encode())
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x" * 50)
    taken, rejected = files.read_files(spark, str(tmp_path), 40)
    assert {r["name"]: r.text for r in taken.collect()} == {"a.TXT": "é", "b.md": "é"}
    assert {r["name"]: r.reason for r in rejected.collect()} == {"c.exe": "extension", "d.txt": "size"}
    (tmp_path / "cases.json").write_text('{"name": "n",\n "cases": [{"question": "q", "ground_truth": "g", "metadata": {"source_doc": "d", "source_pages": [1]}}]}')
    row = files.read_eval_cases(spark, str(tmp_path / "cases.json")).first()
    assert (row.dataset, row.case_id, row.question, row.metadata.source_pages) == ("n", 0, "q", [1])


def test_ordered_fold_holds_groups_across_batches(spark):
    from corpusloom.functions.ordered import ordered_fold

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(200).select((F.col("id") % 9).alias("k"), F.col("id").alias("o"))
        got = ordered_fold(rows, "k", "o", lambda f: pd.DataFrame({"k": [f["k"].iloc[0]], "n": [len(f)], "sorted": [f["o"].is_monotonic_increasing]}), "k long, n long, sorted boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in got) == [(k, 23 if k < 2 else 22) for k in range(9)] and all(r.sorted for r in got)


def test_numbers_of_one_large_group(spark):
    from corpusloom.functions.ranking import numbered

    rows = spark.range(1000).select((F.col("id") % 97 == 0).alias("small"), (F.col("id") * 7919 % 1000).alias("o"))
    got = numbered(rows, ["small"], ["o"]).toPandas()
    for _, own in got.groupby("small"):
        own = own.sort_values("o")
        assert list(own["row_number"]) == list(range(1, len(own) + 1))


def test_query_sets_in_several_blocks(spark, monkeypatch):
    """Blocks of queries and of passages give what one block gives, with ties, repeated passages and queries without hits."""
    from corpusloom.operators import sweep, vectors

    pick = random.Random(4)
    texts = [" ".join(pick.choices("a b c d e f g h i j".split(), k=pick.randrange(1, 12))) for _ in range(300)]
    chunks = spark.createDataFrame([(f"c{k:03d}", t.split(), "xy"[k % 2]) for k, t in enumerate(texts)], "chunk_id string, tokens array<string>, config string").repartition(3)
    questions = spark.createDataFrame([(q, w, float(q % 3 + 1), g) for g in "xy" for q in range(25) for w in {"abcdefghij"[q % 10], "abcdefghij"[q * 7 % 10], "zz"}], "query_id long, term string, weight double, config string")
    one = questions.where("config = 'x'").drop("config")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want, grouped = rows(vectors.sparse_topk_scan(chunks, one, 3)), rows(vectors.sparse_topk_scan(chunks, questions, 3, group="config"))
    assert want == rows(vectors.sparse_topk(vectors.bm25_doc_weights(chunks), one, 3).select("query_id", "chunk_id", "score", "rank"))
    by_group = [(g, *r) for g in "xy" for r in rows(vectors.sparse_topk_scan(chunks.where(f"config = '{g}'"), one, 3))]
    assert grouped == sorted(by_group)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (7, None)], "doc_id long, text string")
    cases = spark.createDataFrame([(k, t[2:9]) for k, t in enumerate(texts[::10])] + [(90, "no such"), (91, ""), (92, texts[20][2:9])], "case_id long, passage string")
    gold = {(c.case_id, min(k for k, t in enumerate(texts) if c.passage in t)) for c in cases.collect() if c.passage and any(c.passage in t for t in texts)}
    assert set(rows(sweep.gold_documents(docs, cases))) == gold
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(vectors, "CHUNKS_AT_ONCE", 16)
    monkeypatch.setattr(sweep, "PASSAGE_CHARS", 50)
    assert rows(vectors.sparse_topk_scan(chunks, one, 3)) == want and rows(vectors.sparse_topk_scan(chunks, questions, 3, group="config")) == grouped
    assert set(rows(sweep.gold_documents(docs, cases))) == gold


def _index_files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet") if "_rewrites" not in str(f)}


def test_points_leave_only_their_files(spark, tmp_path, monkeypatch):
    """Untouched files keep their names, a second call changes nothing, and a call that was stopped is finished or has changed nothing."""
    points = spark.range(200).selectExpr("id as chunk_id", "cast(id div 10 as string) as doc_id", "id % 2 as kb", "'now' as cfg")
    path = tmp_path / "my index"
    for cfg in ("now", "before", "other"):
        files.write_index(points.repartitionByRange(4, "chunk_id").withColumn("cfg", F.lit(cfg)), str(path))
    old = _index_files(path)
    gone = spark.createDataFrame([("3",), ("3",), (None,), ("no such",)], "doc_id string")
    rows = lambda: sorted((r.cfg, r.chunk_id) for r in spark.read.parquet(str(path)).collect())
    want = sorted((cfg, k) for cfg in ("now", "before", "other") for k in range(200) if cfg == "other" or k // 10 != 3)
    finish, calls = files._finish_rewrite, []
    monkeypatch.setattr(files, "_finish_rewrite", lambda *a: calls.append(a))  # stopped before a file is replaced
    assert files.delete_points(spark, str(path), gone, ["doc_id"], ["now", "before"]) == 4
    assert _index_files(path) == old and len(rows()) == 600
    monkeypatch.setattr(files, "_finish_rewrite", finish)
    assert files.delete_points(spark, str(path), gone, ["doc_id"], ["now", "before"]) == 0  # the stopped call is finished first
    new = _index_files(path)
    assert rows() == want and len(old - new) == 4 and all(name.split("cfg=")[1].split("/")[0] in ("now", "before") for name in old - new)
    assert files.delete_points(spark, str(path), gone, ["doc_id"], ["now", "before"]) == 0 and _index_files(path) == new
    assert files.delete_points(spark, str(path), spark.createDataFrame([(1,)], "kb int"), ["kb"], ["now"]) > 0
    assert rows() == [r for r in want if r[0] != "now" or r[1] % 2 == 0]
    (path / "_rewrites" / "half").mkdir(parents=True)  # stopped before its list was written
    assert files.delete_points(spark, str(path), gone, ["doc_id"], ["now"]) == 0 and not (path / "_rewrites" / "half").exists()


def test_enriched_pages_are_filtered_first(spark):
    """Texts of pages that no hit names are neither gathered nor moved: the filter stands under the aggregate of the pages' elements."""
    rows = [(str(d), f"p{k}", k, f"text {d} {k}", False) for d in range(30) for k in range(20)]
    pages = parse.page_text(spark.createDataFrame(rows, "doc_id string, page_id string, order int, content string, ignored boolean")).withColumnRenamed("text", "content")
    hits = spark.createDataFrame([(1, "c1", "4", ["p3", "p5"]), (1, "c2", "99", ["p7"]), (2, "c1", "4", ["p5"]), (2, "c3", "4", [])], "request_id int, chunk_id string, doc_id string, page_ids array<string>")
    got = {(r.request_id, r.chunk_id): r.page_content for r in retrieval.page_enrich(hits, pages).collect()}
    assert got == {(1, "c1"): "text 4 3\n\ntext 4 5", (1, "c2"): "text 0 7", (2, "c1"): "text 4 5", (2, "c3"): None}
    wanted = F.broadcast(hits.select(F.explode("page_ids").alias("page_id")).distinct())
    plan = pages.join(wanted, "page_id", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


@pytest.mark.parametrize("folded_rows", [50_000, 0, 12])
def test_greedy_groups(spark, folded_rows):
    """Folded arrays and pointer doubling give what a loop gives: empty rows, rows over the limit, a key that holds most rows, repeated sizes, a null key."""
    from corpusloom.functions.packing import greedy_groups

    pick = random.Random(6)
    sizes = {"hot": [pick.choice([0, 0, 1, 3, 7, 9, 10, 11, 40]) for _ in range(400)], "zeros": [0] * 15, "large": [50, 60, 0, 0, 70], "lead": [0, 0, 11, 0, 12, 1], "one": [5], None: [9, 1, 1], "even": [5] * 21}
    for k in range(20):
        sizes[f"d{k}"] = [pick.randrange(0, 12) for _ in range(pick.randrange(1, 40))]
    want = set()
    for key, row in sizes.items():
        group, filled = 1, 0
        for at, n in enumerate(row):
            if filled and filled + n > 10:
                group, filled = group + 1, 0
            filled += n
            want.add((key, at * 3, group))
    rows = spark.createDataFrame([(key, at * 3, n) for key, row in sizes.items() for at, n in enumerate(row)], "doc string, at int, n int").repartition(5)
    got = greedy_groups(rows, "doc", "at", "n", 10, "page", folded_rows)
    assert got.count() == len(want) and set(map(tuple, got.collect())) == want
    assert greedy_groups(rows.limit(0), "doc", "at", "n", 10, "page", folded_rows).count() == 0


def test_merging_by_plain_loops(spark):
    """Runs of small blocks against the rules one after the other: pages that are missing, white space of all kinds at the ends, limits met exactly."""
    pick = random.Random(12)
    rows, want = [], []
    for doc in range(60):
        at = 0
        for _ in range(pick.randrange(1, 25)):
            at += pick.randrange(1, 3)
            raw = pick.choice(["", " ", "\n", "\u3000"]) + pick.choice(["a", "bb", "c" * 20, "d" * 7, ""]) + pick.choice(["", "", "\t", "\x1c"])
            crumb = pick.choice([["h"], ["h"], ["h"], []])
            rows.append((str(doc), f"e{at}", at, pick.choice(["list_item", "list_item", "caption", "paragraph"]), pick.choice([None, None, None, 1]), pick.choice([None, "", "p1", "p1", "p1", "p2"]), crumb, raw, ": ".join([*crumb, raw])))
    for doc in {r[0] for r in rows}:
        out, first, page = [], None, None
        for _, ident, order, kind, level, page_id, crumb, raw, text in sorted((r for r in rows if r[0] == doc), key=lambda r: r[2]):
            small = ("list", "list_item", "caption", "footnote")
            if out and first[0] in small and kind in small and first[1:] == (crumb, level) and (not page or not page_id or page == page_id) and len(out[-1][0]) + 1 + len(raw) <= 30:
                out[-1][0] = out[-1][0].rstrip() + "\n" + raw.strip()
                out[-1][1] = "merged"
                out[-1][3].append(ident)
                out[-1][4] += [page_id] if page_id and page_id not in out[-1][4] else []
                page = page_id or page
            else:
                out.append([text, kind, crumb, [ident], [page_id] if page_id else []])
                first, page = (kind, crumb, level), page_id
        want += [(doc, k, *x) for k, x in enumerate(out)]
    blocks = spark.createDataFrame(rows, "doc_id string, element_id string, order int, type string, level int, page_id string, breadcrumb array<string>, raw_text string, text string").repartition(4)
    got = chunk.merge_micro(blocks, chunk.ChunkConfig(merge_max_chars=30))
    assert sorted((r.doc_id, r.block, r.text, r.type, r.breadcrumb, r.element_ids, r.page_ids) for r in got.collect()) == sorted(want)
    assert any(x[3] == "merged" for x in want)


def test_headings_of_a_document_in_every_partition(spark, monkeypatch):
    """One document over all range partitions has the breadcrumbs and parents that one pass gives; so have its neighbours."""
    from corpusloom.functions import ranking

    pick = random.Random(9)
    rows = [("big", f"e{k}", k, pick.choice(["heading", "paragraph", "paragraph"]), "text", f"h{k}", pick.choice([1, 2, 3, 4]), pick.random() < 0.1, None, None) for k in range(600)]
    rows += [(f"d{d}", f"e{k}", k, pick.choice(["heading", "paragraph"]), "text", f"h{k}", pick.choice([1, 2]), False, None, None) for d in range(9) for k in range(8)]
    table = spark.createDataFrame(rows, ELEMENT).repartition(6)
    found = lambda: (sorted((r.doc_id, r.order, r.breadcrumb) for r in chunk.breadcrumb(table).collect()), sorted((r.doc_id, r.element_id, r.parent_id) for r in parse.heading_tree(table).collect()))
    want = found()
    spread = []
    stored = ranking.stored
    monkeypatch.setattr(ranking.last_upto, "__defaults__", (100,))
    monkeypatch.setattr(ranking, "stored", lambda df, name: spread.append((name, stored(df, name))) or spread[-1][1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found() == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = [df for name, df in spread if name == "ranges"]
    assert ranges and all(df.where("doc_id = 'big'").select("_part").distinct().count() == 4 for df in ranges)


def test_pages_by_keys_are_the_whole_listing(spark, tmp_path):
    """Pages joined equal the listing, each filtered by a range of its first column that the scan takes; ties of that column do not split or repeat rows."""
    pick = random.Random(3)
    rows = [(k, pick.randrange(12), f"n{k}") for k in range(157)]
    spark.createDataFrame(rows, "id int, at int, name string").repartition(5).write.parquet(str(tmp_path / "rows"))
    table, order = spark.read.parquet(str(tmp_path / "rows")), {"at": False, "id": True}
    directory = bookkeeping.page_directory(table, order, 20).cache()
    assert directory.count() == 8
    pages = [[tuple(r) for r in bookkeeping.listing_page(table, directory, order, n).collect()] for n in range(9)]
    assert [len(p) for p in pages] == [20] * 7 + [17, 0]
    assert [r for p in pages for r in p] == sorted(rows, key=lambda r: (-r[1], r[0]))
    plan = bookkeeping.listing_page(table, directory, order, 3)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(at" in plan
    assert bookkeeping.page_directory(table.limit(0), order, 20).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_within_the_row(spark):
    """Pages of plain text are those of a fold over its elements, without a shuffle."""
    text = lambda *sizes: "\n\n".join("x" * n for n in sizes)
    docs = spark.createDataFrame([(1, text(30, 30, 20, 90, 1)), (2, text(*[69, 2] * 700)), (3, " \n\n "), (4, None), (None, "lost"), (5, text(200))], "doc_id long, text string")
    got = parse.plain_text_pages(docs, 70)
    want = parse.with_pages(parse.parse_plain_text(docs), 70)
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())
    assert max(r.page_no for r in got.where("doc_id = 2").collect()) == 1400 and exchanges(got) == 0


def test_chunks_are_moved_once(spark):
    """Chunks are numbered in the pass that cuts them: elements go to their documents and nothing is moved after that."""
    docs = spark.createDataFrame([(d, "\n\n".join("word " * (30 + 70 * ((d + k) % 3)) for k in range(9))) for d in range(40)], "doc_id long, text string")
    elements = parse.plain_text_pages(docs).repartition(3)
    chunks = chunk.semantic_chunk(elements)
    assert exchanges(chunks) == 1
    rows = sorted((int(r.doc_id), r.order, r.orders[0], r.part_index, r.chunk_id) for r in chunks.collect())
    assert [r[1] for r in rows if r[0] == 7] == list(range(1, sum(r[0] == 7 for r in rows) + 1))
    assert [r[2:4] for r in rows if r[0] == 7] == sorted(r[2:4] for r in rows if r[0] == 7)
    assert all(r[4] == f"{r[0]}:chunk:{r[1]:04d}" for r in rows) and len({r[4] for r in rows}) == len(rows)


def test_paragraphs_are_split_once(spark):
    """Texts are split and trimmed in one place of the plan, not in a filter before it again; spaces go at their ends alone."""
    docs = spark.createDataFrame([(1, " one \r\n\r\n\ttwo\x0b\n \n\x0cthree \n\n \t\n\nfour\t\x85"), (2, " \n\n "), (3, None)], "doc_id long, text string")
    pages = parse.plain_text_pages(docs)
    assert pages._jdf.queryExecution().executedPlan().toString().count("split(") == 1
    assert [(r.doc_id, r.order, r.content) for r in pages.orderBy("order").collect()] == [("1", 0, "one"), ("1", 1, "two"), ("1", 2, "three"), ("1", 3, "four\t\x85")]


def test_plain_chunks_move_no_text(spark):
    """Chunks of plain text are those of the general way, cut in the pass that makes the paragraphs; rows that share an id are still one document."""
    rng = random.Random(7)
    texts = ["\n\n".join(" ".join(rng.choice(["alpha", "beta. ", "![a](b.png)", "\n", "é" * 30]) for _ in range(rng.randrange(1, 160))) for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    rows = [*enumerate(texts), (40, None), (41, " \n\n "), (42, "x" * 1500), (None, "lost")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    columns = ["chunk_id", "doc_id", "order", "page_content", "page_ids"]
    general = lambda docs: chunk.semantic_chunk(parse.plain_text_pages(docs).repartition(5)).select(columns)
    got = chunk.plain_text_chunks(frame(rows))
    assert exchanges(got) == 0 and got.columns == columns
    assert sorted(got.collect()) == sorted(general(frame(rows)).collect()) and got.count() > 100
    twice = frame([*rows, (3, "more of three"), (3, "and more"), (None, "lost too")])
    got, want = chunk.plain_text_chunks(twice).collect(), general(twice).collect()
    assert sorted(r.chunk_id for r in got) == sorted(r.chunk_id for r in want) and len({r.chunk_id for r in got}) == len(got)
    assert sorted((r.doc_id, r.page_content) for r in got) == sorted((r.doc_id, r.page_content) for r in want)


def test_page_texts_go_by_document(spark):
    """Hits meet the texts of their pages at their document, and pages that it lacks there too: no text is moved for a single hit or gathered by a page id that many share."""
    texts = {(f"d{d}", f"p{p}"): f"text {d} {p}" for d in range(4) for p in range(d + 1)}
    pages = spark.createDataFrame([(d, p, t) for (d, p), t in texts.items()] + [(None, "p0", "lost"), ("d3", "p9", None)], "doc_id string, page_id string, content string")
    hits = [(r, f"c{c}", None if c == 5 else f"d{(r + c) % 5}", [f"p{c % 4}", f"p{r % 3}", None, "nowhere"] if c else []) for r in range(6) for c in range(6)] + [(9, "none", "d1", None), (9, "empty", "d3", ["p9"])]
    found = retrieval.page_enrich(spark.createDataFrame(hits, "request_id long, chunk_id string, doc_id string, page_ids array<string>"), pages)
    assert "hashpartitioning(request_id" not in found._jdf.queryExecution().executedPlan().toString()
    alone = {p: min((d, t) for (d, q), t in texts.items() if q == p)[1] for _, p in texts}
    want = {(r, c): "\n\n".join(t for p in ids or [] if (t := texts.get((d, p), alone.get(p)))) or None for r, c, d, ids in hits}
    assert {(r.request_id, r.chunk_id): r.page_content for r in found.collect()} == want


def test_chunks_are_read_once(spark):
    """However often chunks are counted, weighted and searched, they are made once."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def watched(texts):
        seen.add(len(texts))
        return texts

    rng = random.Random(5)
    rows = [("ab"[k % 2], f"c{k:03d}", " ".join(rng.choices("one two three four five six seven".split(), k=1 + k % 9))) for k in range(60)]
    chunks = spark.createDataFrame(rows, "config string, chunk_id string, text string").withColumn("tokens", F.split(watched("text"), " ")).drop("text")
    questions = {1: "one two two", 2: "seven", 3: "absent five"}
    found = sweep.search_configurations(chunks, spark.createDataFrame([(q, t.split()) for q, t in questions.items()], "case_id long, tokens array<string>"), 4).collect()
    assert seen.value == len(rows)
    want = set()
    for config in "ab":
        own = {c: t.split() for g, c, t in rows if g == config}
        idf = lambda t: math.log((len(own) - (n := sum(t in x for x in own.values())) + 0.5) / (n + 0.5) + 1)  # noqa: B023, E731
        for q, text in questions.items():
            scores = {c: round(sum(x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / 300)) * idf(t) for t in sorted(set(text.split())) if t in x), 9) for c, x in own.items()}
            best = sorted((c for c in scores if scores[c] > 0), key=lambda c: (-scores[c], c))[:4]
            want |= {(config, q, c, k) for k, c in enumerate(best, 1)}
    assert {(r.config, r.case_id, r.chunk_id, r["rank"]) for r in found} == want


def test_sums_and_products_agree(monkeypatch):
    """Scores of chunks are the same by sums over sparse terms and by products of dense matrices."""
    rng = random.Random(2)
    part = pd.DataFrame([(q, f"t{t:02d}", rng.random()) for q in range(9) for t in rng.sample(range(30), 7)], columns=["query_id", "term", "weight"])
    scores = vectors._TermScores(part, 3)
    postings = [(c, t, rng.random()) for c in range(12) for t in sorted(rng.sample(range(len(scores)), rng.randrange(9)))]
    chunk_, term, weight = (np.array(x) for x in zip(*postings))
    want = np.zeros((12, len(scores.matrix)))
    want[chunk_, term] = weight
    for products in (0, 10**9):
        monkeypatch.setattr(vectors, "PRODUCTS_A_SUM", products)
        assert np.allclose(scores._products(chunk_, term, weight, 12), want @ scores.matrix, atol=1e-12)
