"""A corpus from `documents` to packed sequences, in five stages; each one's rows are written and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's rows are to be
written before the next stage is asked for, which deletes what the one before stored on its way, unless docs itself reads that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from partloom.llm import mixing, ngram_join, packing, quality, secrets
from partloom.llm.common import drop_folders, drop_stash, read_by, stash, stashes, table
from partloom.llm.queries import tokenizer_path


_left: dict[str, list[str]] = {}  # by tables: the folders that the stage before has left


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {path.rsplit("/", 1)[1] for path in read_by(docs)}
        kept = [p for p in _left.get(sf_dir, []) if p.rsplit("/", 1)[1] in names]
        drop_folders(spark, [p for p in _left.pop(sf_dir, []) if p not in kept])
        with stashes() as made:
            out = f(spark, docs, sf_dir)
        _left[sf_dir] = kept + made
        return out

    return run_stage


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_mixture(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixture", mixture), ("packed", packed)]

#: Models, groups by similarity and token ids: not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES[:-1]):
        before, docs = docs, stash(step(spark, docs, sf_dir))
        if k:
            drop_stash(before)
    return STAGES[-1][1](spark, docs, sf_dir)
