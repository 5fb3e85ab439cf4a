"""The corpus pipeline: documents in, packed training sequences out.

Quality rules reject junk, one document of each group of near copies stays,
secrets give way to placeholders, sources are mixed to their target weights,
and what remains is tokenized and packed. Each stage works on all rows of its
predecessor, written as Parquet and read again.

A stage's own intermediate tables go when the next stage of the same folder
begins, except those that its input still reads; ``run`` also removes each
stage's result when the next one is written. Whatever is left lies in the
application's folder under ``spark.checkpoint.dir``.

Null texts and texts of few words fall at the first stage; null doc_ids,
languages and sources are carried, repeated rows leave one at the second stage.
Ties fall as the stages say. Very long texts go through whole. Columns beside those of documents stay as
they are up to packing, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mergeloom.llm import mixing, packing, quality_rules, secrets, simhash
from mergeloom.llm.common import remove, scratch_path, scratch_scope

#: By application and folder: intermediate tables of the stage before.
_left: dict[tuple[str, str], list[str]] = {}


def _stage(apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _left.setdefault((spark.sparkContext.applicationId, sf_dir), [])
        if before:
            read = docs.inputFiles()
            remove(spark, before, lambda path: not any(path.split("://")[-1] in f for f in read))
        with scratch_scope() as paths:
            out = apply(docs)
        before.extend(paths)
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", _stage(quality_rules.passing)),
    ("SimHash near-dedup", _stage(simhash.without_copies)),
    ("secret scans", _stage(secrets.redact)),
    ("mixing sources to target weights", _stage(mixing.mix_documents)),
    ("packing", _stage(packing.pack)),
]

#: Fingerprints, sketches and tokenizers are beyond SQL: tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, written)
        written.append(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
