"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again.

Quality rules drop what they reject, near-dedup keeps one document of each near-duplicate group, substring dedup
cuts passages that an earlier document holds, the mix draws documents towards the sources' targets, and packing
lays all tokens in sequences of 2048. What a stage has put on disk for itself is deleted when the next one begins,
as its rows are written by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from vellumite.llm import mixing, packing, quality, simhash, substring
from vellumite.llm._common import made, release, remove_path, shared_root, written_at

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the stage called last has made. The first stage leaves those of a run before alone,
#: and no stage deletes what its documents are still read from.
_LEFT: list[str] = []


def _after(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage.__name__ != "quality_rules":
            read = docs.inputFiles()
            release(spark, [folder for folder in _LEFT if not any(f"{folder.rsplit('/', 1)[-1]}/" in file for file in read)])
        before = set(made())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [folder for folder in made() if folder not in before]
        return out

    return run_stage


@_after
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified on the labelled ones."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_after
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of pairs of similarity 0.8 over five-word shingles."""
    return simhash.keep_one(docs, shingle=5)


@_after
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id holds."""
    return substring.without_repeats(docs)


@_after
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, up to twice."""
    return mixing.mixed_documents(docs)


@_after
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Shingle sets, chunk digests and the tokenizer are not SQL; tests compare run() with a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES[:-1]:
        before, path = path, f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
        docs = written_at(stage(spark, docs, sf_dir), path)
        if before:
            remove_path(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
