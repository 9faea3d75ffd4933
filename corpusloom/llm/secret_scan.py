"""Secret scans through an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every version of every path is a row (path, version, content). Its blob is the SHA-256 of the content. The ledger holds a
row for each blob and rule version already scanned, findings or not; ``scan_versions`` scans only unseen pairs, whatever
number of paths carries the blob, and joins findings back to all paths and versions.

Null contents count as empty. Findings are code-point spans of the whole match; ties in the start are ordered as the rules are. Repeated
rows get a row each. Contents of any length are handled, in time that grows with the power 1.5 of their number of matches. Empty tables give no rows.
Masking keeps all columns, whatever their names; scanning returns the named keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import materialize


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost first; those whose group ``group`` is under ``at_least`` characters are dropped."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    at_least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Maximal runs of a class need no length filter, so those rules carry their length in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, at_least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: A private key from BEGIN to the matching END. Without one it ends with its header lines and lines of base64; line breaks may
#: be escaped, and on one line runs of 16 and more count.
_BREAK = r"(?:[\r\n]|\\[rn])"
_PEM = (
    r"-----BEGIN ([A-Z ]{0,30}PRIVATE KEY)-----"
    r"(?:(?:[^-]|-(?!----))*+-----END \1-----"
    rf"|(?:{_BREAK}++\x20*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+"
    rf"(?:(?:\s|\\[rn])++[A-Za-z0-9+/]{{16,}}+=*+|{_BREAK}(?:\s|\\[rn])*+[A-Za-z0-9+/]++=*+[\x20\t]*+(?={_BREAK}|$))*+)"
)
MORE_RULES = (
    Rule("pem", _PEM, version=2),
    Rule("bearer", r"(?:ghp_|gho_|xoxb-|xoxp-|glpat-)[A-Za-z0-9_-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER_SCHEMA = "blob string, rule string, findings array<struct<kind:string,start:long,end:long>>"


def blob_of(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(v: Column) -> Column:
    """The array ``v`` in slices of about the square root of its size."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda k: F.slice(v, k * size + 1, size))


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the long ``values`` those before it, reduced from 0 by ``op``: in groups of about the square root of their number,
    since a fold copies what it has gathered at every step."""
    zero = F.lit(0).cast("long")
    grown = lambda xs, start: F.aggregate(xs, F.array(start), lambda found, x: F.concat(found, F.array(op(F.element_at(found, -1), x))))
    bases = lambda groups: grown(F.transform(groups, lambda g: F.aggregate(g, zero, op)), zero)
    inside = lambda groups: F.zip_with(groups, F.slice(bases(groups), F.lit(1), F.size(groups)), lambda g, base: grown(F.slice(g, F.lit(1), F.size(g) - 1), base))
    none = F.array().cast("array<bigint>")
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(_cut(v), lambda groups: F.flatten(inside(groups)))).otherwise(none))


def find_spans(content: Column, rule: Rule) -> Column:
    """Spans of a rule's matches, from the lengths of the matches and of the gaps between them."""
    sizes = lambda texts: F.transform(texts, lambda x: F.length(x).cast("long"))
    matches = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    gaps = sizes(F.split(content, rule.pattern, -1))  # one more than matches
    kept = sizes(F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group))) if rule.at_least > 1 else F.lit(None).cast("array<bigint>")
    span = lambda a, n: F.struct(F.lit(rule.kind).alias("kind"), a.alias("start"), (a + n).alias("end"))

    def spans(p: Column) -> Column:
        pairs = F.zip_with(p["lengths"], F.slice(p["gaps"], F.lit(1), F.size(p["lengths"])), lambda n, g: g + n)
        starts = F.zip_with(_before(pairs, lambda a, b: a + b), F.slice(p["gaps"], F.lit(1), F.size(p["lengths"])), lambda a, g: a + g)
        found = F.zip_with(starts, p["lengths"], span)
        return _let(found, lambda x: F.filter(x, lambda _, k: F.get(p["kept"], k) >= rule.at_least)) if rule.at_least > 1 else found

    kind = "array<struct<kind:string,start:long,end:long>>"
    found = _let(F.struct(sizes(matches).alias("lengths"), gaps.alias("gaps"), kept.alias("kept")), spans)
    return F.when(content.rlike(rule.pattern), found.cast(kind)).otherwise(F.array().cast(kind))


def scan_new(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``versions`` that the ledger lacks. Each blob is scanned once."""
    content = F.coalesce("content", F.lit(""))
    rows = versions.select(blob_of(F.col("content")).alias("blob"), content.alias("content"))
    blobs = rows.groupBy("blob").agg(F.first("content").alias("content"))
    keys = [r.key for r in rules]
    if ledger is None:
        todo = blobs.withColumn("todo", F.array(*map(F.lit, keys)))
    else:
        seen = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most one for each rule
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    scans = [F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), find_spans(F.col("content"), r).alias("findings"))) for r in rules]
    return todo.select("blob", F.explode(F.filter(F.array(*scans), lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.findings")


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings): all findings of a blob under the current rule versions, ordered by start and then by rule.

    It is written out, so that a join with paths has plain exchanges on both sides and Spark can split a blob that a third of all
    paths carry.
    """
    current = ledger.where(F.col("rule").isin([r.key for r in rules]))
    found = current.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("found"))  # a row for each rule of the blob
    rank = F.map_from_arrays(F.array(*(F.lit(r.kind) for r in rules)), F.array(*(F.lit(i) for i in range(len(rules)))))
    ordered = F.transform(F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return materialize(found.select("blob", ordered.alias("findings")), "secret-findings")


def scan_versions(versions: DataFrame, keys: list[str], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(keys, blob and findings of every version; new ledger rows). Append the second to the stored ledger."""
    new = materialize(scan_new(versions, ledger, rules), "secret-ledger")
    known = new if ledger is None else ledger.select("blob", "rule", "findings").unionByName(new)
    paths = versions.select(*keys, blob_of(F.col("content")).alias("blob"))
    return paths.join(findings_by_blob(known, rules), "blob", "left"), new


def mask_column(docs: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the findings in ``column`` masked. Each distinct text is scanned once; texts join their findings by blob."""
    new = materialize(scan_new(docs.select(F.col(column).alias("content")), None, rules), "secret-ledger")
    hits = materialize(findings_by_blob(new, rules).where(F.size("findings") > 0), "secret-hits").toDF("scanned_blob", "scanned_findings")
    # a merge join at every size: few hits now need not stay few
    joined = docs.join(hits.hint("merge"), blob_of(docs[column]) == hits["scanned_blob"], "left")
    masked = F.when(hits["scanned_blob"].isNotNull(), redact(docs[column], hits["scanned_findings"])).otherwise(docs[column])
    return joined.select(*((masked.alias(c) if c == column else docs[c]) for c in docs.columns))


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(content: Column, findings: Column, mask: str = "[SECRET]") -> Column:
    """``content`` with every span masked; overlapping spans are masked as one."""
    ends = F.transform(findings, lambda x: x["end"])
    part = lambda text, low, high: F.substring(text, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    places = F.zip_with(findings, _before(ends, lambda a, b: F.greatest(a, b)), lambda x, seen: F.struct(seen.alias("seen"), x["start"].alias("start")))

    def stretch(group: Column) -> Column:  # of the content, so that no place is sought from its very start
        base = F.get(group, F.lit(0))["seen"]
        own = F.struct(base.alias("base"), part(content, base, F.element_at(group, -1)["start"]).alias("text"))
        one = lambda c, x: F.when(x["start"] >= x["seen"], F.concat(part(c["text"], x["seen"] - c["base"], x["start"] - c["base"]), F.lit(mask))).otherwise("")
        return _let(own, lambda c: F.array_join(F.transform(group, lambda x: one(c, x)), ""))

    parts = _let(places, lambda p: F.transform(_cut(p), stretch))
    masked = F.concat(F.array_join(parts, ""), F.substring(content, (F.array_max(ends) + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(findings) > 0, masked).otherwise(content)
