"""Token estimates and truncation without a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = "[가-힣]"


def token_count(text: Column, lang: Column) -> Column:
    """A quarter token a character, at least one; Korean syllables count one and a half. Empty and null texts count 0."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    hangul = n - F.length(F.regexp_replace(text, HANGUL, ""))
    ko = F.floor(hangul * 1.5 + (n - hangul) * 0.25)
    en = F.greatest(F.lit(1), F.floor(n * 0.25))
    return F.when(n == 0, 0).when(lang == "ko", ko).otherwise(en).cast("int")


def token_truncate(text: Column, lang: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` tokens."""
    head = F.substring(text, 1, 4 * limit)
    costs = F.transform(F.filter(F.split(head, ""), lambda c: c != ""), lambda c: F.when(c.rlike(HANGUL), 1.5).otherwise(0.25))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(s: Column, cost: Column) -> Column:
        fits = s["on"] & (s["cost"] + cost <= limit)
        return F.struct(F.when(fits, s["cost"] + cost).otherwise(s["cost"]).alias("cost"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("on"))

    return F.when(lang == "ko", F.substring(head, F.lit(1), F.aggregate(costs, start, step, lambda s: s["n"]))).otherwise(head)
