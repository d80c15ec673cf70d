"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing,
token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and hands the next stage what it reads
back.  All but the last return the columns of ``documents``.

Defined results: empty tables give empty results at every stage; null texts
are not toxic, have no near duplicates, hold no benchmark passage, have size 0
in the mix and become the end id alone; a null id is an id like any other;
columns beside those of ``documents`` are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import read, written
from strata.llm.decontaminate import remove_documents
from strata.llm.jaccard_join import keep_one_each
from strata.llm.mixing import mixed_documents
from strata.llm.token_files import token_digests, tokenizer_path, write_token_files
from strata.llm.toxicity import drop_toxic

#: Fixed value: pieces that a Python worker of the last stage keeps (about 30 MB).
KEPT_PIECES = 200_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the model rejects go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group one document stays, that with the smallest id.

    Shingles of five words, a similarity of 0.8 or more.
    """
    return keep_one_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark window go."""
    return remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token files; what they hold of each document.

    The executors' heaps are grown by the stages before, so that the tables of
    known pieces are smaller here than where the operator runs alone.
    """
    return token_digests(write_token_files(docs, tokenizer_path(), kept=KEPT_PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The stages rest on a fitted model and on a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
