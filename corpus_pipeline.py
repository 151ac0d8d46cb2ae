"""A training corpus from raw documents, in five stages.

Each stage takes what the one before kept, and all but the last return the columns
of `documents`. The last gives (doc_id, n_tokens, ids_sha256, decoded_sha256, ids).

Null and empty texts fail the quality rules for having too few words; a stage that gets
them all the same leaves them as they are, and the last one encodes them as the end id
alone. A null doc_id stays null, and comes last where one of a group stays; a null source
counts for no site. Of rows with equal doc_id and text one stays. Of copies the one with
the smallest doc_id stays. An empty table gives an empty one. Further columns keep their
values in all stages but the last, which drops them, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.batches import documents
from tracewell.llm.boilerplate_lines import without_widespread
from tracewell.llm.decontaminate import drop_contaminated
from tracewell.llm.minhash_dedup import Scheme, keep_one
from tracewell.llm.quality import keep_good
from tracewell.llm.sentence_pieces import encoded_digests
from tracewell.sources.workspace import materialise

#: Near copies share four of five shingles of five words.
SCHEME = Scheme(shingle=5, similarity=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Copies are left to the next stage: they neither make a line widespread nor lose their text.
    return without_widespread(docs, copies=True, whole=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, scheme=SCHEME)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("pieces", pieces),
]

#: SQL cannot express the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
