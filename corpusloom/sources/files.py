"""Uploads, evaluation cases, artifacts and vector tables as sources and sinks."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.intake import ALLOWED_EXTENSIONS, MAX_FILE_BYTES, extension


def judge_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``reason`` why a file (name, length) is rejected; null if it is taken."""
    return files.withColumn("reason", F.when(~F.coalesce(extension(F.col("name")), F.lit("")).isin(*ALLOWED_EXTENSIONS), "extension").when(F.col("length") > max_bytes, "size"))


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files with name, content and text; rejects with their reason). Contents of rejects are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    judged = judge_files(raw, max_bytes)
    return judged.where("reason is null").select("name", "length", "content", decode_text(F.col("content")).alias("text")), judged.where("reason is not null").select("name", "length", "reason")


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of ``{name, cases: [...]}`` files."""
    raw = spark.read.option("multiLine", True).schema("name string, cases array<struct<question:string,ground_truth:string,metadata:struct<source_doc:string,source_pages:array<int>,source_chunk_preview:string>>>").json(path)
    return raw.select(F.col("name").alias("dataset"), F.posexplode("cases").alias("case_id", "c")).select("dataset", "case_id", "c.*")


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Parsed or chunked artifacts, a folder per config hash; rows carry content_hash."""
    artifacts.write.mode("append").partitionBy("config_hash").parquet(path)


def write_index(points: DataFrame, path: str) -> None:
    """Chunks with vectors, a folder per config hash and knowledge base; the folders that are written are replaced."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cfg", "kb").parquet(path)


def _finish_rewrite(spark: SparkSession, path: str, staged: str) -> None:
    """Put staged files in the place of those they replace. Old files go first, so rows are never there twice; what was done already is passed over."""
    store, root = FileSystem.from_uri(path)
    staged_root = f"{root}/{staged}"
    for r in spark.read.parquet(f"{path}/{staged}/replaced").toLocalIterator():
        name = f"{root}/{r.file}"
        if store.get_file_info(name).type == FileType.File:
            store.delete_file(name)
    for f in store.get_file_info(FileSelector(f"{staged_root}/rows", recursive=True)):
        if f.type == FileType.File and f.base_name.endswith(".parquet"):
            name = root + f.path[len(f"{staged_root}/rows") :]
            store.create_dir(name.rpartition("/")[0], recursive=True)
            store.move(f.path, name)
    store.delete_dir(staged_root)


def delete_points(spark: SparkSession, path: str, gone: DataFrame, keys: list[str], configs: list[str]) -> int:
    """Remove the points with ``keys`` of ``gone`` from the index, in the folders of ``configs`` (the current and the one before); the number of files that were rewritten.

    Only files that hold such a point are read whole and written anew, all others stay as they are; a second call finds nothing to do. The rest of those
    files is staged first with the list of what it replaces: a call that was stopped later than that is finished by the next one, one that was stopped earlier has changed nothing.
    The names of the files that hold a key reach the driver, no row does.
    """
    store, root = FileSystem.from_uri(path)
    for f in store.get_file_info(FileSelector(f"{root}/_rewrites", allow_not_found=True)):
        if store.get_file_info(f"{f.path}/replaced/_SUCCESS").type == FileType.File:
            _finish_rewrite(spark, path, f"_rewrites/{f.base_name}")
        else:
            store.delete_dir(f.path)
    gone = gone.select(*keys).distinct()
    points = spark.read.parquet(path).where(F.col("cfg").isin(configs))
    holders = points.select("*", F.col("_metadata.file_path").alias("_file")).join(gone, keys, "left_semi").select("_file").distinct()
    names = sorted(unquote(r["_file"]) for r in holders.collect())
    if not names:
        return 0
    staged = f"_rewrites/{uuid.uuid4().hex}"
    rest = spark.read.option("basePath", path).parquet(*names).join(gone, keys, "left_anti")
    rest.write.partitionBy("cfg", "kb").parquet(f"{path}/{staged}/rows")
    inside = [(n[n.index(root) + len(root) + 1 :],) for n in names]
    spark.createDataFrame(inside, "file string").coalesce(1).write.parquet(f"{path}/{staged}/replaced")
    _finish_rewrite(spark, path, staged)
    return len(names)


def without_keys(points: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Points that are left when those of some documents or knowledge bases go."""
    return points.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_eval_results(cases: DataFrame, summary: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(f"{path}/cases")
    summary.write.mode("overwrite").json(f"{path}/summary")
