"""A corpus pipeline of five stages: quality, near duplicates, contamination, secrets, packing.

Each stage works on what the one before it kept and is written as Parquet between them, in a folder that all machines
share. ``run`` applies them to the table documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, near_dup, packing, quality_pu, secrets
from plumbline.llm.common import counted, delete, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject: score at least 0.5.

    Null and empty texts are scored like any other; repeated rows get the same verdict; an empty table stays empty.
    Columns that clash with the classifier's own are carried unchanged.
    """
    model = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    return quality_pu.scored(docs, model, least=0.5)


def row_key(docs: DataFrame) -> Column:
    """What tells a row: whether its id is null, the id, and 128 bits of all its columns. Only equal rows share it.

    Compared in this order, so rows with an id come first, by their id.
    """
    parts = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``keys`` (column key__); keys are broadcast only if their size allows."""
    return docs.withColumn("key__", row_key(docs)).join(counted(keys), "key__", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id (without ids: the smallest key); of equal rows one.

    Rows are told by all their columns, so different texts under one id, and rows without an id, are judged each by
    itself. Null texts are in no class and all stay; equal empty texts are copies. An empty table stays empty, extra
    columns are carried.
    """
    told = near_dup.near_duplicates(docs.select(row_key(docs).alias("key__"), "text"), id_col="key__")
    rest = without(docs, told.where("key__ <> class_id").select("key__").distinct())
    again = told.where("key__ = class_id and n_copies > 1").groupBy("key__").count().where("count > 1").select("key__")
    if again.isEmpty():
        return rest
    again = counted(again)
    keyed = rest.withColumn("key__", row_key(rest))
    return keyed.join(again, "key__", "left_anti").union(keyed.join(again, "key__", "left_semi").dropDuplicates(["key__"])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item; rows are told by all their columns, not by their ids.

    Null and empty texts hold none and stay, and so do all rows if the benchmark is empty. Extra columns are carried.
    """
    found = decontaminate.contamination(docs.select(row_key(docs).alias("key__"), "text"), table(spark, sf_dir, "benchmark"), id_col="key__")
    return without(docs, found.where("contaminated").select("key__").distinct())


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret replaced by a mark and, where there is such a column, n_chars counted anew.

    Null and empty texts stay as they are; n_chars of a null text stays what it was. Extra columns are carried.
    """
    out = secrets.redact(docs, secrets.train(secrets.default_samples(spark)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences; null and empty texts are one id long.

    Repeated rows and null ids are packed like others, an empty table gives no rows, other columns are not looked at.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_removal),
    ("packing", pack),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
