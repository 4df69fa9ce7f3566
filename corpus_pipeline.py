"""A pipeline over documents, one operator after another; every stage is written and reread.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``, with all their
columns; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import session
from provena.llm import bpe, common, decontamination, jaccard, langid, quality
from provena.llm.common import query


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised with enough confidence."""
    common.prepare(spark)
    return docs.where(~langid.identify(F.col("text"), langid.fit(docs))["rejected"])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of good quality."""
    common.prepare(spark)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= 0.7)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id."""
    common.prepare(spark)
    return jaccard.first_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no item of the benchmark."""
    common.prepare(spark)
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids, with the digests of the ids and of what they decode to."""
    common.prepare(spark)
    ranks = common.resource(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    both = bpe.encode(docs, ranks, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("quality", good), ("near copies", different), ("benchmark", unseen), ("encoding", encoded)]

#: Trained stages have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
