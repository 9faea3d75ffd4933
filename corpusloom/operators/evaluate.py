"""Evaluation: case generation, ranks, judged scores, scorecards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
MIN_CHARS, MIN_ALNUM = 200, 120
JUDGED_CHARS = 6000


def substantive_chunks(chunks: DataFrame) -> DataFrame:
    text = F.regexp_replace("page_content", r"^\s+|\s+$", "")
    return chunks.where((F.length(text) >= MIN_CHARS) & (F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= MIN_ALNUM))


def even_sample(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """``k`` rows of every key, spread evenly over its order; all if there are no more than k."""
    per = Window.partitionBy(key)
    numbered = rows.withColumns({"_i": F.row_number().over(per.orderBy(order)) - 1, "_n": F.count("*").over(per)})
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") / k)))
    return numbered.where((F.col("_n") <= k) | F.array_contains(picked, F.col("_i").cast("long"))).drop("_i", "_n")


def parse_model_json(replies: DataFrame) -> DataFrame:
    """question and answer of the replies that hold a JSON object, fenced or bare, and are answerable."""
    fenced = F.regexp_extract("reply", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    body = F.from_json(F.when(fenced != "", fenced).otherwise(bare), "question string, answer string, answerable boolean")
    rows = replies.withColumn("_b", body).withColumns({"question": F.trim("_b.question"), "answer": F.trim("_b.answer")})
    return rows.where(F.col("_b.answerable") & (F.col("question") != "") & (F.col("answer") != "")).drop("_b", "reply")


def doc_rank(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """cases with the 1-based rank of the first hit from their gold document, null if none. hits: config, case_id, rank, doc_id."""
    gold = hits.join(cases.select("case_id", "gold_doc"), "case_id").where(F.col("doc_id") == F.col("gold_doc")).groupBy("config", "case_id").agg(F.min("rank").alias("gold_rank"))
    return hits.select("config").distinct().join(cases, how="cross").join(gold, ["config", "case_id"], "left")  # a row for each configuration and case


def _hit(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def hit_at_k(ranked: DataFrame, rank: str = "gold_rank") -> DataFrame:
    """hit_1, hit_3, hit_5 and mrr of every configuration."""
    r = F.col(rank)
    return ranked.groupBy("config").agg(*(_hit(r, k).alias(f"hit_{k}") for k in (1, 3, 5)), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), F.count("*").alias("n_cases"))


def judge_context(contexts: Column, limit: int = JUDGED_CHARS) -> Column:
    """What a judge of faithfulness reads: the contexts up to ``limit`` characters."""
    joined = F.array_join(contexts, "\n\n")
    return F.substring(F.when(F.coalesce(joined, F.lit("")) == "", "(no context retrieved)").otherwise(joined), 1, limit)


def judge_score(reply: Column) -> Column:
    """Score of a judge's JSON reply between 0 and 1; 0 where it has none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.score").try_cast("double"), F.lit(0.0))))


def sweep_scorecard(configs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per configuration with all its columns (such as its ingest seconds); those without results are error rows. results: config, gold_rank, correctness, faithfulness, latency_sec."""
    r = F.col("gold_rank")
    agg = results.groupBy("config").agg(*(_hit(r, k).alias(f"hit_{k}") for k in (1, 3, 5)), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), F.avg("correctness").alias("correctness"), F.avg("faithfulness").alias("faithfulness"), F.avg("latency_sec").alias("mean_latency_sec"))
    return configs.join(agg, "config", "left").withColumn("error", F.when(F.col("mrr").isNull(), "no results"))


def metric_summary(results: DataFrame) -> DataFrame:
    """Mean of each metric over successful cases; a missing score counts 0. results: success, metrics array<struct<name,score>>."""
    rows = results.where("success").select(F.explode("metrics").alias("m")).select(F.col("m.name").alias("name"), F.coalesce(F.nanvl("m.score", F.lit(0.0)), F.lit(0.0)).alias("score"))
    return rows.groupBy("name").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def normalize_answers(rows: DataFrame) -> DataFrame:
    """answer and contexts of pipeline rows with answer, response, contexts, references and error."""
    texts = F.transform("references", lambda r: F.coalesce(r["content"], r["page_content"], F.lit("")))
    failed = F.col("error").isNotNull()
    none = F.array().cast("array<string>")
    return rows.select(
        "case_id", F.when(failed, F.concat(F.lit("ERROR: "), "error")).otherwise(F.coalesce("answer", "response", F.lit(""))).alias("answer"),
        F.when(failed, none).otherwise(F.coalesce("contexts", texts, none)).alias("contexts"), (~failed).alias("success"),
    )


def evaluate_cases(cases: DataFrame, evaluator: Callable[[str, list[str], str], list[tuple[str, float]]]) -> DataFrame:
    """(case_id, name, score): metrics of every case (case_id, answer, contexts, ground_truth) by a pluggable evaluator."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.case_id, name, float(score)) for r in f.itertuples() for name, score in evaluator(r.answer, list(r.contexts), r.ground_truth)]
            yield pd.DataFrame(rows, columns=["case_id", "name", "score"]).astype({"case_id": "int64", "score": float})

    return cases.select(F.col("case_id").cast("long").alias("case_id"), "answer", "contexts", "ground_truth").mapInPandas(run, "case_id long, name string, score double")


def length_metrics(answer: str, contexts: list[str], ground_truth: str) -> list[tuple[str, float]]:
    """A deterministic stand-in for an evaluator."""
    return [("answer_ratio", len(answer) / max(len(ground_truth), 1)), ("n_contexts", len(contexts))]
