"""Queries of parsing, rendering and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import split, tokens
from corpusloom.operators import chunk, parse, render

from .projections import ELEMENTS, LINES, elements, lines
from .registry import query, table


def _para_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"), "lang")


PARAS = "paras AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, ord, content FROM lines_)"


@query("parse_plain_text", f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || '_el_' || ord AS element_id, CAST(ord AS INT) AS \"order\", 'paragraph' AS type, 'text' AS format, content, CAST(NULL AS INT) AS level, false AS ignored FROM lines_")
def parse_plain_text(spark, sf_dir):
    return parse.parse_plain_text(_para_docs(spark, sf_dir))


@query("parse_html")
def parse_html(spark, sf_dir):
    return parse.parse_html(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"))


@query("parse_markdown")
def parse_markdown(spark, sf_dir):
    mark = F.when(F.col("order") % 10 == 0, F.lit("## ")).when(F.col("order") % 10 == 3, F.lit("- ")).otherwise(F.lit(""))
    rows = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", F.concat(mark, "content").alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return parse.parse_markdown(rows)


@query("normalize_page_json", f"""WITH {LINES}, p AS (SELECT doc_id, ord, content, CASE WHEN doc_id % 3 = 0 THEN ord + 1 ELSE row_number() OVER (PARTITION BY doc_id ORDER BY ord) END AS page_no FROM lines_),
b AS (SELECT doc_id, page_no, 0 AS k, 'heading' AS type, trim(substr(content, 1, 20)) AS content, 1 AS level FROM p UNION ALL SELECT doc_id, page_no, 1, 'paragraph', trim(substr(content, 21)), NULL FROM p)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k) - 1 AS INT) AS "order", doc_id || '_page_' || page_no AS page_id, type, content, level FROM b WHERE content <> ''""")
def normalize_page_json(spark, sf_dir):
    """Each line is a page; its boxes, a heading of 20 characters and a text for the rest, cover the whole of it."""
    box = lambda kind, low, high: F.struct(F.lit(kind).alias("class"), F.array(low, high).alias("pos"), F.array(*map(F.lit, (0.0, 0.0, 9.0, 9.0))).alias("bbox"))
    boxes = F.array(box("section-header", F.lit(0), F.lit(20)), box("text", F.lit(20), F.greatest(F.length("content"), F.lit(20))))
    page = F.struct((F.col("order") + 1).alias("page_no"), F.col("content").alias("text"), boxes.alias("page_boxes"))
    ordered = F.array_sort(F.collect_list(F.struct("order", page.alias("p"))))
    pages = F.transform(ordered, lambda x: x["p"])
    # a third of the documents arrive with their pages reversed
    docs = lines(spark, sf_dir).groupBy("doc_id").agg(pages.alias("pages")).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.reverse("pages")).otherwise(F.col("pages")).alias("pages"))
    return parse.normalize_page_json(docs).select("doc_id", "order", "page_id", "type", "content", "level")


@query("normalize_layout_json", f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || '_el_' || ord AS element_id, CAST(ord AS INT) AS "order", CASE WHEN ord % 10 = 0 THEN 'heading' WHEN ord % 10 = 9 THEN 'page_footer' ELSE 'paragraph' END AS type,
  content, CASE WHEN ord % 10 = 0 THEN 1 END AS level, ord % 10 = 9 AS ignored, CASE WHEN ord % 10 = 0 THEN 'sectionHeading' WHEN ord % 10 = 9 THEN 'pageFooter' END AS role, CAST(ord + 1 AS INT) AS page_no, CAST(100 - ord AS DOUBLE) AS top FROM lines_""")
def normalize_layout_json(spark, sf_dir):
    item = F.struct(F.when(F.col("order") % 10 == 0, "section_header").when(F.col("order") % 10 == 9, "page_footer").otherwise("text").alias("label"), F.col("content").alias("text"), F.lit(1).alias("level"), F.array(F.struct((F.col("order") + 1).alias("page_no"), F.struct(F.lit(1.0).alias("l"), (100 - F.col("order")).alias("t"), F.lit(2.0).alias("r"), F.lit(0.0).alias("b")).alias("bbox"))).alias("prov"))
    rows = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", item.alias("i")))).alias("rows"))
    refs = F.transform("rows", lambda x: F.create_map(F.lit("$ref"), F.concat(F.lit("#/texts/"), x["order"].cast("string"))))
    found = parse.normalize_layout_json(rows.select("doc_id", F.to_json(F.struct(F.transform("rows", lambda x: x["i"]).alias("texts"), F.struct(refs.alias("children")).alias("body"))).alias("json")))
    return found.select("doc_id", "element_id", "order", "type", "content", "level", "ignored", "role", "page_no", F.col("bbox")[1].alias("top"))


@query("bbox_to_topleft", """
WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS "left", CAST(l_partkey % 700 AS DOUBLE) AS "top", CAST(l_quantity + 10 AS DOUBLE) AS "right", CAST(l_suppkey % 700 AS DOUBLE) AS "bottom",
                  CASE WHEN l_linenumber % 2 = 0 THEN 'BOTTOMLEFT' ELSE 'TOPLEFT' END AS o, CASE WHEN l_orderkey % 3 <> 0 THEN 800.0::DOUBLE END AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, "left", CASE WHEN o = 'BOTTOMLEFT' THEN least(coalesce(h - "top", "top"), coalesce(h - "bottom", "bottom")) ELSE "top" END AS "top", "right",
       CASE WHEN o = 'BOTTOMLEFT' THEN greatest(coalesce(h - "top", "top"), coalesce(h - "bottom", "bottom")) ELSE "bottom" END AS "bottom", 'TOPLEFT' AS coord_origin FROM b""")
def bbox_to_topleft(spark, sf_dir):
    d = lambda e: F.expr(e).cast("double")
    origin = F.when(F.col("l_linenumber") % 2 == 0, "BOTTOMLEFT").otherwise("TOPLEFT")
    box = F.struct(d("l_quantity").alias("left"), d("l_partkey % 700").alias("top"), d("l_quantity + 10").alias("right"), d("l_suppkey % 700").alias("bottom"), origin.alias("coord_origin"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"), F.when(F.col("l_orderkey") % 3 != 0, F.lit(800.0)).alias("h"))
    return rows.select("l_orderkey", "l_linenumber", parse.bbox_to_topleft(F.col("box"), F.col("h")).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("group_bbox_union", """SELECT l_orderkey AS group_id, l_linenumber % 2 AS page_no, CAST(min(l_quantity) AS DOUBLE) AS "left", CAST(min(l_partkey % 700) AS DOUBLE) AS "top", CAST(max(l_quantity + 10) AS DOUBLE) AS "right",
  CAST(max(l_suppkey % 700) AS DOUBLE) AS "bottom", min(l_partkey) AS span_start, max(l_partkey + 5) AS span_end FROM lineitem GROUP BY l_orderkey, l_linenumber % 2""")
def group_bbox_union(spark, sf_dir):
    d = lambda e: F.expr(e).cast("double")
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.expr("l_linenumber % 2").alias("page_no"), d("l_quantity").alias("left"), d("l_partkey % 700").alias("top"), d("l_quantity + 10").alias("right"), d("l_suppkey % 700").alias("bottom"), F.col("l_partkey").alias("span_start"), F.expr("l_partkey + 5").alias("span_end"))
    return parse.group_bbox_union(parts)


GRID = """cells AS (SELECT l_orderkey AS table_id, 4 AS n_rows, 3 AS n_cols, CAST((l_linenumber - 1) // 2 AS INT) AS r, CAST((l_linenumber - 1) % 2 AS INT) AS c, 1 AS row_span,
  CASE WHEN l_linenumber = 2 THEN 2 ELSE 1 END AS col_span, l_linenumber <= 2 AS header, max(l_returnflag) || ' & <' || l_linenumber || '>' AS text FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query("table_grid_html", f"""WITH {GRID}, t AS (SELECT table_id, bool_or(col_span > 1) AS is_complex, bool_or(r = 0 AND c = 1) AS wide FROM cells GROUP BY table_id),
g AS (SELECT table_id, is_complex, r, c FROM t, range(4) x(r), range(3) y(c) WHERE NOT (wide AND r = 0 AND c = 2)),
h AS (SELECT g.*, coalesce('<' || CASE WHEN header THEN 'th' ELSE 'td' END || CASE WHEN col_span > 1 THEN ' colspan="2"' ELSE '' END || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || CASE WHEN header THEN 'th' ELSE 'td' END || '>', '<td></td>') AS cell
      FROM g LEFT JOIN cells USING (table_id, r, c)), rows_ AS (SELECT table_id, is_complex, r, '  <tr>' || string_agg(cell, '' ORDER BY c) || '</tr>' AS line FROM h GROUP BY ALL)
SELECT table_id, is_complex, '<table>' || chr(10) || string_agg(line, chr(10) ORDER BY r) || chr(10) || '</table>' AS html FROM rows_ GROUP BY ALL""")
def table_grid_html(spark, sf_dir):
    n = F.col("l_linenumber")
    places = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    cells = places.select(
        F.col("l_orderkey").alias("table_id"), F.lit(4).alias("n_rows"), F.lit(3).alias("n_cols"), F.floor((n - 1) / 2).cast("int").alias("row"), ((n - 1) % 2).cast("int").alias("col"), F.lit(1).alias("row_span"),
        F.when(n == 2, 2).otherwise(1).alias("col_span"), (n <= 2).alias("header"), F.concat("l_returnflag", F.lit(" & <"), n.cast("string"), F.lit(">")).alias("text"),
    )
    return parse.table_grid_html(cells)


@query("ensure_elements", f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n, string_agg(content, '|' ORDER BY ord) AS text FROM lines_ GROUP BY doc_id""")
def ensure_elements(spark, sf_dir):
    docs = _para_docs(spark, sf_dir)
    have = parse.parse_plain_text(docs.where("doc_id % 2 = 0"))
    third = F.col("doc_id") % 4
    rest = docs.select("doc_id", F.lit(None).cast("string").alias("markdown"), F.when(third == 1, F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p>"))).alias("html"), F.when(third != 1, F.col("text")).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("order", "content"))), lambda x: x["content"])
    return parse.ensure_elements(rest, have).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(texts, "|").alias("text"))


PAGES_WALK = f"""RECURSIVE {LINES}, walk AS (
  SELECT doc_id, ord, length(content) AS filled, 1 AS page_no FROM lines_ WHERE ord = 0
  UNION ALL
  SELECT l.doc_id, l.ord, CASE WHEN w.filled > 0 AND w.filled + length(l.content) > 2000 THEN length(l.content) ELSE w.filled + length(l.content) END,
         CASE WHEN w.filled > 0 AND w.filled + length(l.content) > 2000 THEN w.page_no + 1 ELSE w.page_no END
  FROM walk w JOIN lines_ l ON l.doc_id = w.doc_id AND l.ord = w.ord + 1)"""


@query("assign_pages", f'WITH {PAGES_WALK} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(ord AS INT) AS "order", page_no FROM walk')
def assign_pages(spark, sf_dir):
    return parse.assign_pages(lines(spark, sf_dir))


HEADS = (
    ELEMENTS
    + """, heads AS (
  SELECT *, """
    + ", ".join(f"last_value(CASE WHEN type = 'heading' AND level = {k} THEN {{'o': ord, 'c': content, 'id': element_id}} END IGNORE NULLS) OVER w AS h{k}" for k in (1, 2, 3))
    + """ FROM elements_ WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
open_ AS (SELECT * EXCLUDE (h1, h2, h3), h1, CASE WHEN h2.o > coalesce(h1.o, -1) THEN h2 END AS h2, CASE WHEN h3.o > greatest(coalesce(h1.o, -1), coalesce(h2.o, -1)) THEN h3 END AS h3 FROM heads)"""
)


@query("heading_tree", f"""WITH {HEADS}, nodes AS (SELECT doc_id, element_id, ord, CASE WHEN type = 'heading' THEN CASE level WHEN 1 THEN NULL WHEN 2 THEN h1.id ELSE coalesce(h2.id, h1.id) END ELSE coalesce(h3.id, h2.id, h1.id) END AS parent_id FROM open_ WHERE NOT ignored)
SELECT n.doc_id, n.element_id, n.parent_id, coalesce(string_agg(c.element_id, ',' ORDER BY c.ord), '') AS children_ids FROM nodes n LEFT JOIN nodes c ON c.doc_id = n.doc_id AND c.parent_id = n.element_id GROUP BY ALL""")
def heading_tree(spark, sf_dir):
    return parse.heading_tree(elements(spark, sf_dir)).withColumn("children_ids", F.array_join("children_ids", ","))


@query("page_text", f"WITH {ELEMENTS} SELECT doc_id, page_id, string_agg(content, chr(10) || chr(10) ORDER BY ord) AS text FROM elements_ WHERE NOT ignored GROUP BY ALL")
def page_text(spark, sf_dir):
    return parse.page_text(elements(spark, sf_dir))


@query("html_to_text")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", render.html_to_text("html").alias("text"))


@query("render_markdown", f"""WITH {ELEMENTS} SELECT doc_id, string_agg(CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || content WHEN 'list_item' THEN '- ' || content ELSE content END, chr(10) || chr(10) ORDER BY ord) AS markdown
FROM elements_ WHERE NOT ignored GROUP BY doc_id""")
def render_markdown(spark, sf_dir):
    return render.render_markdown(elements(spark, sf_dir).withColumn("format", F.lit("text")))


ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query("render_html", f"""WITH {ELEMENTS} SELECT doc_id, string_agg(CASE type WHEN 'heading' THEN '<h' || level || '>' || {ESCAPED.format("content")} || '</h' || level || '>'
  WHEN 'list_item' THEN '<ul><li>' || {ESCAPED.format("content")} || '</li></ul>' ELSE '<p>' || {ESCAPED.format("content")} || '</p>' END, chr(10) ORDER BY ord) AS html FROM elements_ WHERE NOT ignored GROUP BY doc_id""")
def render_html(spark, sf_dir):
    return render.render_html(elements(spark, sf_dir).withColumn("format", F.lit("text")))


@query("dq_structure", f"""WITH {ELEMENTS}, n AS (SELECT doc_id, count(*) AS n FROM elements_ GROUP BY doc_id)
SELECT doc_id, n > 1 AND doc_id % 4 = 1 AS repeated_ids, n > 2 AND doc_id % 5 = 2 AS order_gap, count_if(page_id IN ('page_3', 'page_4') AND NOT (doc_id % 5 = 2 AND ord = 1 AND n > 2))::BIGINT AS unknown_pages FROM elements_ JOIN n USING (doc_id) GROUP BY doc_id, n""")
def dq_structure(spark, sf_dir):
    """Some documents repeat an id, some lack their second element, and pages 3 and 4 are unknown."""
    rows = elements(spark, sf_dir)
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    bad = rows.join(n, "doc_id").where(~((F.col("doc_id") % 5 == 2) & (F.col("order") == 1) & (F.col("n") > 2)))
    first = F.concat(F.col("doc_id").cast("string"), F.lit("_el_0"))
    bad = bad.withColumn("element_id", F.when((F.col("doc_id") % 4 == 1) & (F.col("order") == F.col("n") - 1), first).otherwise(F.col("element_id")))
    return parse.dq_structure(bad, rows.where("page_id not in ('page_3', 'page_4')").select("doc_id", "page_id"))


@query("dq_types_and_links", f"""WITH {HEADS}, nodes AS (SELECT doc_id, element_id, ord, ignored, CASE WHEN ignored THEN NULL WHEN type = 'heading' THEN CASE level WHEN 1 THEN NULL WHEN 2 THEN h1.id ELSE coalesce(h2.id, h1.id) END ELSE coalesce(h3.id, h2.id, h1.id) END AS parent_id FROM open_)
SELECT doc_id, element_id, ord % 10 = 7 AS unknown_type, doc_id % 3 = 1 AND parent_id IS NOT NULL AS unlisted FROM nodes""")
def dq_types_and_links(spark, sf_dir):
    """Every tenth element has no type, and a third of the documents have lost their lists of children."""
    rows = elements(spark, sf_dir)
    tree = parse.heading_tree(rows).withColumn("children_ids", F.when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>")).otherwise(F.col("children_ids")))
    return parse.dq_types_and_links(rows.withColumn("type", F.when(F.col("order") % 10 == 7, "unknown").otherwise(F.col("type"))), tree)


@query("dq_completeness", """WITH s AS (SELECT doc_id, substr(text, 5, 40) || CASE WHEN doc_id % 9 = 0 THEN '#missing' ELSE '' END AS snippet FROM documents)
SELECT doc_id, snippet, contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(snippet, '\\s+', ' ', 'g'))) AS present FROM s JOIN documents USING (doc_id)""")
def dq_completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = docs.select("doc_id", F.concat(F.substring("text", 5, 40), F.when(F.col("doc_id") % 9 == 0, "#missing").otherwise("")).alias("snippet"))
    return parse.dq_completeness(docs, wanted)


CRUMBS = HEADS + """, blocks AS (SELECT doc_id, element_id, ord, type, page_id, content AS raw_text, list_filter([h1.c, h2.c, h3.c], lambda x: x IS NOT NULL) AS crumb FROM open_ WHERE NOT ignored AND type <> 'heading'),
texts AS (SELECT *, CASE WHEN len(crumb) > 0 THEN array_to_string(crumb, ' > ') || ': ' ELSE '' END || raw_text AS text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM blocks)"""


@query("breadcrumb", f'WITH {CRUMBS} SELECT doc_id, element_id, ord AS "order", type, array_to_string(crumb, \'|\') AS breadcrumb, text FROM texts')
def breadcrumb(spark, sf_dir):
    return chunk.breadcrumb(elements(spark, sf_dir)).select("doc_id", "element_id", F.col("order").cast("long").alias("order"), "type", F.array_join("breadcrumb", "|").alias("breadcrumb"), "text")


MERGE_WALK = f"""RECURSIVE {CRUMBS}, walk AS (
  SELECT doc_id, n, 0 AS block, type AS kind, crumb, page_id, text, element_id AS ids FROM texts WHERE n = 1
  UNION ALL
  SELECT t.doc_id, t.n, CASE WHEN m THEN w.block ELSE w.block + 1 END, t.type, t.crumb, t.page_id, CASE WHEN m THEN w.text || chr(10) || t.raw_text ELSE t.text END, CASE WHEN m THEN w.ids || ',' || t.element_id ELSE t.element_id END
  FROM (SELECT w.*, t.n AS tn, w.kind = 'list_item' AND t.type = 'list_item' AND w.crumb = t.crumb AND w.page_id = t.page_id AND length(w.text) + 1 + length(t.raw_text) <= 300 AS m FROM walk w JOIN texts t ON t.doc_id = w.doc_id AND t.n = w.n + 1) w
  JOIN texts t ON t.doc_id = w.doc_id AND t.n = w.tn)"""


@query("merge_micro", f"WITH {MERGE_WALK} SELECT CAST(doc_id AS VARCHAR) AS doc_id, block, arg_max(text, n) AS text, arg_max(ids, n) AS element_ids FROM walk GROUP BY doc_id, block")
def merge_micro(spark, sf_dir):
    return chunk.merge_micro(chunk.breadcrumb(elements(spark, sf_dir))).select("doc_id", "block", "text", F.array_join("element_ids", ",").alias("element_ids"))


@query("recursive_split")
def recursive_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.recursive_split(F.col("text"))).alias("part_index", "part"))


SUMMARY = "CASE WHEN doc_id % 2 = 0 THEN text ELSE split_part(text, chr(10), 1) END"


@query("summary_prefix", f"""WITH s AS (SELECT doc_id, {SUMMARY} AS summary FROM documents), p AS (SELECT doc_id, '[Document Summary: ' || substr(summary, 1, 225) || CASE WHEN length(summary) > 225 THEN '...' ELSE '' END || ']' || chr(10) || chr(10) AS prefix FROM s)
SELECT doc_id, prefix, CAST(greatest(100, 450 - length(prefix)) AS INT) AS budget FROM p""")
def summary_prefix(spark, sf_dir):
    return chunk.summary_prefix(table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("summary")))


def _chunks(spark, sf_dir):
    return chunk.semantic_chunk(elements(spark, sf_dir))


@query("semantic_chunk")
def semantic_chunk(spark, sf_dir):
    return _chunks(spark, sf_dir)


SIMPLE_CHUNKS = ELEMENTS + """, chunks AS (SELECT doc_id, doc_id || ':chunk:' || lpad(CAST(ord + 1 AS VARCHAR), 4, '0') AS chunk_id, ord + 1 AS ord, content AS page_content, [page_id, 'page_' || (1 + (ord + 1) // 7)] AS pages, ord % 10 AS t FROM elements_)"""


def _simple_chunks(spark, sf_dir):
    """A chunk for each element that also touches the page of its successor."""
    after = F.concat(F.lit("page_"), (1 + F.floor((F.col("order") + 1) / 7)).cast("string"))
    return elements(spark, sf_dir).select("doc_id", F.format_string("%s:chunk:%04d", F.col("doc_id").cast("string"), F.col("order") + 1).alias("chunk_id"), (F.col("order") + 1).alias("order"), F.col("content").alias("page_content"), F.array_distinct(F.array("page_id", after)).alias("page_ids"), F.array("order", F.col("order") + 2).alias("orders"), F.array("type", "type").alias("types"))


@query("chunk_navigation", f"""WITH {SIMPLE_CHUNKS}, places AS (SELECT doc_id, chunk_id, ord, unnest(list_distinct(pages)) AS page_id FROM chunks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY ord) AS i, count(*) OVER (PARTITION BY doc_id, page_id) AS c FROM places), flags AS (SELECT doc_id, chunk_id, bool_or(i = 1) AS first_on_page, bool_or(i = c) AS last_on_page, CAST(sum(c) AS BIGINT) AS neighbours FROM ranked GROUP BY ALL)
SELECT doc_id, chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id, first_on_page, last_on_page, neighbours FROM chunks JOIN flags USING (doc_id, chunk_id) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")
def chunk_navigation(spark, sf_dir):
    total = F.aggregate("page_positions", F.lit(0).cast("long"), lambda s, x: s + x["count"])
    return chunk.chunk_navigation(_simple_chunks(spark, sf_dir)).select("doc_id", "chunk_id", "previous_chunk_id", "next_chunk_id", "first_on_page", "last_on_page", total.alias("neighbours"))


@query("chunk_metadata", f"WITH {ELEMENTS} SELECT doc_id, doc_id || ':chunk:' || lpad(CAST(ord + 1 AS VARCHAR), 4, '0') AS chunk_id, CAST(ord AS INT) AS element_order_start, CAST(ord + 2 AS INT) AS element_order_end, CASE WHEN ord % 7 = 6 THEN 2 ELSE 1 END AS n_pages, type AS source_types FROM elements_")
def chunk_metadata(spark, sf_dir):
    return chunk.chunk_metadata(_simple_chunks(spark, sf_dir)).select("doc_id", "chunk_id", "element_order_start", "element_order_end", F.size("page_numbers").alias("n_pages"), F.array_join("source_types", ",").alias("source_types"))


@query("page_chunk", f"""WITH {ELEMENTS}, p AS (SELECT doc_id, page_id, CAST(substr(page_id, 6) AS INT) AS page_no, string_agg(content, chr(10) || chr(10) ORDER BY ord) FILTER (NOT ignored) AS text FROM elements_ GROUP BY ALL)
SELECT doc_id || ':vchunk:' || lpad(CAST(page_no - 1 AS VARCHAR), 4, '0') AS chunk_id, doc_id, page_no - 1 AS "order", page_id, page_no, 'img/' || page_id AS image_path, coalesce(text, '') AS page_content FROM p WHERE page_no % 2 = 1""")
def page_chunk(spark, sf_dir):
    rows = elements(spark, sf_dir)
    number = F.substring("page_id", 6, 9).cast("int")
    pages = rows.select("doc_id", "page_id").distinct().withColumns({"page_no": number, "image_path": F.when(number % 2 == 1, F.concat(F.lit("img/"), "page_id"))})
    return chunk.page_chunk(pages, rows)


@query("chunk_stats", f"WITH {SIMPLE_CHUNKS} SELECT doc_id, count(*) AS n_chunks, avg(length(page_content)) AS mean_chars FROM chunks GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    return chunk.chunk_stats(_simple_chunks(spark, sf_dir), ["doc_id"])


#: Every second document is Korean, its vowels being Hangul syllables.
MIXED = "mixed AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeiou', '가나다라힣') ELSE text END AS text, CASE WHEN doc_id % 2 = 0 THEN 'ko' ELSE 'en' END AS lang FROM documents)"


def _mixed(spark, sf_dir):
    korean = F.col("doc_id") % 2 == 0
    return table(spark, sf_dir, "documents").select("doc_id", F.when(korean, F.translate("text", "aeiou", "가나다라힣")).otherwise(F.col("text")).alias("text"), F.when(korean, "ko").otherwise("en").alias("lang"))


@query("token_count", f"""WITH {MIXED} SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 WHEN lang = 'ko' THEN floor(h * 1.5 + (length(text) - h) * 0.25) ELSE greatest(1, floor(length(text) * 0.25)) END AS INT) AS n_tokens
FROM (SELECT *, length(text) - length(regexp_replace(text, '[가-힣]', '', 'g')) AS h FROM mixed)""")
def token_count(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", tokens.token_count(F.col("text"), F.col("lang")).alias("n_tokens"))


@query("token_truncate", f"""WITH {MIXED}, c AS (SELECT doc_id, unnest(string_split(left(text, 80), '')) AS c, generate_subscripts(string_split(left(text, 80), ''), 1) AS k FROM mixed),
costs AS (SELECT doc_id, k, sum(CASE WHEN regexp_matches(c, '[가-힣]') THEN 1.5 ELSE 0.25 END) OVER (PARTITION BY doc_id ORDER BY k) AS cost FROM c), n AS (SELECT doc_id, max(k) FILTER (cost <= 20) AS n FROM costs GROUP BY doc_id)
SELECT doc_id, CASE WHEN lang = 'ko' THEN left(text, coalesce(n, 0)) ELSE left(text, 80) END AS text FROM mixed LEFT JOIN n USING (doc_id)""")
def token_truncate(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", tokens.token_truncate(F.col("text"), F.col("lang"), 20).alias("text"))

