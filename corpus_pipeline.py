"""Training corpus in five stages, each written as Parquet and read again as the next one's documents.

language_id      documents whose text fits no learnt language go
near_duplicates  one document of each group of similar shingle sets stays
substring_dedup  word windows that also start earlier are cut out of the texts
mixing           sources are brought to their weights; documents are dropped, repeated or cut for it
packing          what is left is packed into sequences; returns their pieces

Stages 1 to 4 return the columns of ``documents``; columns that a caller adds to them pass through whatever their
names.  A text that loses all its words stays as an empty text until mixing, which takes nothing of it but whole
repetitions.  A stage begins by deleting the stage tables its predecessors worked on: their results are written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlab.llm import stages
from meterlab.llm.jaccard import one_per_group
from meterlab.llm.langid import keep_identified
from meterlab.llm.mixing import mix
from meterlab.llm.packing import pack
from meterlab.llm.queries import vocabulary
from meterlab.llm.substrings import remove_repeats

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _apply(operator: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """The operator's rows with the columns of ``docs``; columns of the caller's own travel under other names."""
    stages.clear(docs.sparkSession)
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
    done = operator(docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns]))
    return done.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apply(keep_identified, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apply(one_per_group, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apply(lambda d: remove_repeats(d).withColumn("n_chars", F.length("text").cast("bigint")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apply(mix, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stages.clear(spark)
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup),
          ("mixing", mixing), ("packing", packing)]

#: The language models of the first stage and the tokenizer of the last can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = stages.stage_path(spark)  # not among the tables that the next stage deletes
        made = stage(spark, docs, sf_dir)
        made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            stages.drop(spark, before)
        before = path
    return docs
