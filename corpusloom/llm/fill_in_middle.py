"""Fill-in-the-middle texts: a text is cut at two of its word bounds and its middle is moved to the end.

``regexp_count`` counts the units of a text: a word with the white space before it, or white space that no word follows. A pattern made
for each row, ``unit{a}``, ``unit{b-a}`` and the rest, captures prefix, middle and suffix in one match, and the replacement
of that match puts them in their new order. Its quantifiers are possessive: counted ones run as loops over the units, without a stack that grows
with the text, and nothing is tried twice. The choice of cuts and of the form comes from a salted hash of doc_id, so runs agree on any cluster.

Everything is one projection over a scan of doc_id and text: no shuffle and no Python. A task holds one text and its units.

Odd rows: null and empty texts are plain, as are texts that hold a marker already. A null doc_id hashes like an empty one. Repeated rows each
get the same result. An empty table gives no rows. Other columns pass through ``transform``, unless the result has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
MARKER = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
#: Of 100 texts so many are cut, and of 100 cut ones so many begin with the suffix.
CUT, SUFFIX_FIRST = 50, 80


def _hashed(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the salted hash of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n (units), form (plain, spm, psm) and output, and the lengths of prefix and middle in code points (null if plain)."""
    new = ("n", "form", "output", "prefix_chars", "middle_chars")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    text = F.coalesce(F.col("text"), F.lit(""))
    cuts = docs.select(*own, F.array(*_hashed(F.col("doc_id"), seed)).alias("_h"), text.alias("_text"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"))
    h, n = F.col("_h"), F.col("n")
    plain = (F.col("_text") == "") | F.col("_text").rlike(MARKER) | (h[2] % 100 >= cut)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    cuts = cuts.select(*own, "_text", "n", form.alias("form"), F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("_a"), F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("_b"))
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), F.col("_a"), F.lit(rf"}}+)({UNIT}{{"), F.col("_b") - F.col("_a"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace(F.col("_text"), pattern, order))
    made = cuts.select(*own, "n", "form", output.alias("output"))
    prefix, middle, _ = pieces(F.col("output"), F.col("form"))
    return made.select("*", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"))


def pieces(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of a transformed text; null for plain ones. A cut text held no marker, so each is there once."""
    parts = F.when(form != "plain", F.split(output, MARKER, -1))
    spm = form == "spm"
    return F.when(spm, parts[2]).otherwise(parts[1]), parts[3], F.when(spm, parts[1]).otherwise(parts[2])


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from."""
    return F.when(form == "plain", output).otherwise(F.concat(*pieces(output, form)))
