"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, exact_dedup, fill_in_middle, language_id, packing, quality_cnn, quality_rules, secret_scan, simhash, substring_dedup, toxicity, warc
from .staging import materialize


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def _label_split(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Labels that may be learnt from; of several rows for a document the least label counts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~_held_out(3, 1))
    return labels.groupBy("doc_id").agg(F.min(label).alias("label"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs, docs.where(~_held_out(4, 2)).select("doc_id", F.col("lang").alias("label")))
    return language_id.identify(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, _label_split(spark, sf_dir, "toxic")))
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of one ledger: half of the paths come first, then all of them, of which only blobs not seen yet are scanned."""
    versions = _documents(spark, sf_dir).select("doc_id", F.lit(1).alias("version"), F.col("text").alias("content"))
    early = versions.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    ledger = materialize(secret_scan.scan_new(early, None), "secret-ledger")
    found, _ = secret_scan.scan_versions(versions, ["doc_id"], ledger)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secret_scan.BASE_RULES]))
    return found.select(
        "doc_id", *(count(r.kind) for r in secret_scan.BASE_RULES), F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"), secret_scan.spans_text(F.col("findings")).alias("spans")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = quality_cnn.score(docs, quality_cnn.train(docs, _label_split(spark, sf_dir, "quality")))
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return found.withColumn("headers", F.array_join(pairs, ";"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir)).drop("lang", "digest")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.digests(conversations, conversation_repair.Repair(conversation_repair.damaged(conversations)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(_documents(spark, sf_dir))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


WARC_SQL = """
WITH pages_ AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), urls AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', ''), '^www[.]', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') AS query
  FROM pages_
), base AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url,
         '"' || substr(digest, 1, 16) || '"' AS tag, 'day ' || (page_id % 365) AS day,
         TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 1 MINUTE AS crawled
  FROM urls
), responses AS (
  SELECT page_id * 3 AS response_id, canonical_url, crawled AS ts, tag, day, digest, length(html) AS size FROM base
), revisits AS (
  SELECT page_id * 3 + 1 AS record_id, canonical_url, crawled + INTERVAL 1800 SECOND AS ts, page_id % 3 = 0 AS by_date,
         CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || tag END AS tag, day FROM base
  UNION ALL
  SELECT page_id * 3 + 2, canonical_url, crawled + INTERVAL 90000 SECOND, page_id % 3 = 0, tag, day FROM base
), found AS (
  SELECT v.*, r.response_id, r.tag AS old_tag, r.day AS old_day, r.digest, r.size,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.response_id DESC) AS k
  FROM revisits v LEFT JOIN responses r ON v.canonical_url = r.canonical_url AND r.ts <= v.ts
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no-response'
                 WHEN by_date THEN CASE WHEN day = old_day THEN 'resolved' ELSE 'validators-differ' END
                 WHEN regexp_replace(tag, '^W/', '') = old_tag THEN 'resolved' ELSE 'validators-differ' END AS verdict
  FROM found WHERE k = 1
)
SELECT record_id, canonical_url, ts, response_id, verdict, CASE WHEN verdict = 'resolved' THEN digest END AS payload_digest,
       CASE WHEN verdict = 'resolved' THEN CASE WHEN by_date
         THEN 'content-length=' || size || ';etag=' || old_tag || ';last-modified=' || day || ';server=b'
         ELSE 'content-length=' || size || ';date=' || day || ';etag=' || tag || ';last-modified=' || old_day || ';server=a' END END AS headers,
       CASE WHEN verdict = 'resolved' THEN 200 END AS status
FROM judged
"""


EXACT_DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""

def _conversation_repair_sql() -> str:
    """The grammar's four states row by row; a state is its least cost in six digits with the audit behind it, so that the least string is the best."""
    add = lambda state, cost, op: f"lpad((left({state}, 6)::BIGINT + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || {op}"
    put = lambda state, letter, before="": add(state, f"CASE WHEN must_go THEN NULL ELSE stay + (initial <> '{letter}')::BIGINT + {5 * len(before)} END", f"CASE WHEN initial = '{letter}' THEN '{before}K' ELSE '{before}R' END")
    drop = lambda state: add(state, 2, "'D'")
    return rf"""
WITH RECURSIVE src AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS rn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS kind
  FROM src
), damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, rn, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc WHERE kind <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), rn, copy) AS pos FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault
  FROM placed
), turns AS (
  SELECT *, fault IN (1, 2) AS must_go, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS stay,
         coalesce(lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM judged
), states AS (
  SELECT conv, 0::BIGINT AS pos, '000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM (SELECT DISTINCT conv FROM src)
  UNION ALL
  SELECT s.conv, t.pos, {drop("s0")}, least({drop("s1")}, CASE WHEN initial = 's' THEN {put("s0", "s")} END),
         least({drop("s2")}, {put("s0", "u")}, {put("s1", "u")}, {put("s3", "u")}, {put("s2", "u", "I")}),
         least({drop("s3")}, {put("s2", "a")}, {put("s0", "a", "I")}, {put("s1", "a", "I")}, {put("s3", "a", "I")})
  FROM states s JOIN turns t ON t.conv = s.conv AND t.pos = s.pos + 1
), ended AS (
  SELECT conv, least(s0, s3, {add("s2", 5, "'I'")}, {add("s1", 10, "'II'")}) AS best FROM states QUALIFY row_number() OVER (PARTITION BY conv ORDER BY pos DESC) = 1
), audits AS (SELECT conv, left(best, 6)::BIGINT AS cost, substr(best, 7) AS audit FROM ended),
ops AS (SELECT conv, audit, unnest(string_split(audit, '')) AS op, generate_subscripts(string_split(audit, ''), 1) AS place FROM audits WHERE audit <> ''),
numbered AS (
  SELECT *, count(*) FILTER (op <> 'I') OVER w AS pos, count(*) FILTER (op <> 'D') OVER (PARTITION BY conv) - count(*) FILTER (op <> 'D') OVER w AS behind
  FROM ops WINDOW w AS (PARTITION BY conv ORDER BY place)
), repaired AS (
  SELECT n.conv, string_agg(CASE WHEN op = 'K' THEN t.role WHEN behind % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY place) AS body
  FROM numbered n LEFT JOIN turns t ON t.conv = n.conv AND t.pos = n.pos WHERE op <> 'D' GROUP BY n.conv
), sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM turns GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) o JOIN audits USING (conv) LEFT JOIN sums USING (conv) LEFT JOIN repaired USING (conv)
"""


FILL_IN_MIDDLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), k AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc_revisits": WARC_SQL, "op11_exact_dedup": EXACT_DEDUP_SQL, "op12_conversation_repair": _conversation_repair_sql(), "op13_fill_in_middle": FILL_IN_MIDDLE_SQL}
